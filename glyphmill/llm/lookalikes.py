"""Problem 6: text that looks the same but is written with other characters.

A text is brought to one form in this order: compatibility forms of letters and
digits become plain ones, ignorable characters go, spaces become plain, accents
and syllables are composed. Then every word whose letters come from several
alphabets, or which consists of look-alikes amid words of another alphabet,
becomes a lattice: each letter may stand for itself or for the letters of other
alphabets that look like it. A Viterbi search finds, for each alphabet that can
spell the whole word, the best path under that alphabet's character bigrams, and
the best alphabet wins.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a letter costs less in the alphabet of the words around.
HOME = 2.0

# Letters that look alike, Latin above Cyrillic and Latin above Greek.
LATIN_C = "ABCEHIJKMOPSTXYaceijopsxyhdqwl"
CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁԛԝӏ"
LATIN_G = "ABEZHIKMNOPTYXov"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"
#: Letters of another alphabet that writers put for a look-alike without its exact shape.
LOOSE_LATIN, LOOSE_CYRILLIC = "bkmhtnurgYyI", "вкмнтпигдУуІ"
LOOSE_LATIN_G, LOOSE_GREEK = "aiuypktnwx", "αιυγρκτηωχ"

_ALPHABETS = {
    "latin": "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ",
    "cyrillic": "Ѐ-ԯ",
    "greek": "Ͱ-Ͽἀ-῿",
    "armenian": "Ա-և",
    "cherokee": "Ꭰ-ᏽꭰ-ꮿ",
}
# Spaces other than the plain one, ignorable characters, and compatibility forms of letters and digits.
_SPACES = "   -   　"
_IGNORED = "­؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e007f\U000e0100-\U000e01ef"
_SINGLE = "０-９Ａ-Ｚａ-ｚﬀ-ﬆﬓ-ﬗיִ-ﭏĲĳǄ-ǌǱ-ǳ\U0001d400-\U0001d7ff"
_ODD = re.compile(f"[{_SPACES}{_IGNORED}{_SINGLE}ｦ-ﾟﾡ-ￜㄱ-ㆎ]")
_IGNORABLE, _SPACE = re.compile(f"[{_IGNORED}]"), re.compile(f"[{_SPACES}]")
_FORMS = re.compile(f"[{_SINGLE}]|[ｦ-ﾟ]+|[ﾡ-ￜㄱ-ㆎ]")
_latin, _other = re.compile(f"[{_ALPHABETS['latin']}]"), re.compile("[" + "".join(v for k, v in _ALPHABETS.items() if k != "latin") + "]")
_word = re.compile("(?<![<&\\\\%#/])(?:[" + "".join(_ALPHABETS.values()) + "]['’]?)+")
_of = {k: re.compile(f"[{v}]") for k, v in _ALPHABETS.items()}
_ABBREVIATED = re.compile(r"\.\s*\d")
_near_digit = re.compile(r"[\d\-]")


def _options() -> dict[str, dict[str, list[str]]]:
    """For each letter and alphabet, the letters of the alphabet that it may stand for."""
    out: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    pairs = [*zip(LATIN_C, CYRILLIC), *zip(LATIN_G, GREEK), *zip(LOOSE_LATIN, LOOSE_CYRILLIC), *zip(LOOSE_LATIN_G, LOOSE_GREEK)]
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            s = alphabet(y)
            if s and alphabet(x) != s and y not in out[x][s]:
                out[x][s].append(y)
    for g, latin in zip(GREEK + LOOSE_GREEK, LATIN_G + LOOSE_LATIN_G):
        for c in out[latin].get("cyrillic", []):
            if c not in out[g]["cyrillic"]:
                out[g]["cyrillic"].append(c)
    return out


def alphabet(ch: str) -> str | None:
    """The alphabet of a letter, if it is one whose letters have look-alikes in others."""
    return next((k for k, p in _of.items() if p.match(ch)), None)


_OPTIONS = _options()
_EXACT = {x for pair in (*zip(LATIN_C, CYRILLIC), *zip(LATIN_G, GREEK)) for x in pair}


def plain_forms(text: str) -> str:
    """The text without compatibility forms, ignorable characters, odd spaces and decomposed letters."""
    if _ODD.search(text):
        text = _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
        text = _SPACE.sub(" ", _IGNORABLE.sub("", text))
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


class Bigrams:
    """Character bigrams of the words of each alphabet."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.count: dict[str, Counter] = {k: Counter() for k in _ALPHABETS}
        self.total: dict[str, Counter] = {k: Counter() for k in _ALPHABETS}
        for (k, a, b), n in counts.items():
            self.count[k][a, b] += n
            self.total[k][a] += n
        self.seen = {k: sum(c.values()) for k, c in self.total.items()}

    @staticmethod
    def counts(texts: Iterable[str]) -> Counter[tuple[str, str, str]]:
        """How often each alphabet's words have each pair of neighbouring letters."""
        out: Counter[tuple[str, str, str]] = Counter()
        for w, n in Counter(w.rstrip("'’") for t in texts for w in _word.findall(plain_forms(t))).items():
            own = {alphabet(c) for c in w if c not in "'’"}
            if len(own) == 1:
                (k,) = own
                # a word of look-alikes alone may be a disguised one, however often it occurs, and tells nothing
                if any(c not in _EXACT for c in w if c not in "'’"):
                    chain = f"^{w.lower()}$"
                    for a, b in zip(chain, chain[1:]):
                        out[k, a, b] += n
        return out

    def cost(self, k: str, a: str, b: str) -> float:
        return -log((self.count[k][a, b] + 0.05) / (self.total[k][a] + 3.0)) + (0.0 if self.seen[k] else 3.0)

    def best(self, word: str, k: str) -> tuple[float, str] | None:
        """Cost per letter and spelling of the best path through the word's lattice in one alphabet."""
        layer: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for c in word:
            if c in "'’":
                layer = {a: (x, s + c) for a, (x, s) in layer.items()}
                continue
            choices = [c] if alphabet(c) == k else _OPTIONS.get(c, {}).get(k, [])
            if not choices:
                return None
            fresh = {}
            for o in choices:
                low = o.lower()
                cost, spelt = min((x + self.cost(k, a, low), s + o) for a, (x, s) in layer.items())
                # an approximate shape costs a little, so that the exact one wins a tie
                fresh[low] = (cost + (0 if o == c or o in _EXACT else 1.0), spelt)
            layer = fresh
        cost, spelt = min((x + self.cost(k, a, "$"), s) for a, (x, s) in layer.items())
        return cost / (len(word) + 1), spelt

    def spell(self, word: str, home: str | None = None) -> str:
        """The word in the alphabet that spells it best; ``home`` is the alphabet of its neighbours."""
        found = {k: b for k in ("latin", "cyrillic", "greek") if (b := self.best(word, k))}
        if not found:
            return word
        k = min(found, key=lambda x: found[x][0] - (HOME if x == home else 0.0))
        return found[k][1]


class Canon:
    """Brings texts to one form and tells which had another."""

    def __init__(self, texts: list[str], counts: dict[tuple[str, str, str], int] | None = None):
        self.bigrams = Bigrams(Bigrams.counts(texts) if counts is None else counts)
        self.memo: dict[tuple[str, str | None], str] = {}

    def _spell(self, word: str, home: str | None) -> str:
        key = (word, home)
        if key not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[key] = self.bigrams.spell(word, home)
        return self.memo[key]

    def text(self, raw: str) -> tuple[str, bool]:
        """The text in its one form, and whether it was a case."""
        text = plain_forms(raw)
        case = text != raw
        if not (_other.search(text) and (_latin.search(text) or re.search(r"[\u0370-\u03ff\u0531-\u0587\u13a0-\u13fd]", text))) and not re.search(r"[\u0370-\u03ff\u0531-\u0587\u13a0-\u13fd]", text):
            return text, case
        words = [(m.start(), m.end(), m[0]) for m in _word.finditer(text)]
        own = [{alphabet(c) for c in w if c not in "'’"} for *_, w in words]
        # words that no other alphabet can spell tell the alphabet of the place
        sure = [next(iter(s)) if len(s) == 1 and any(c not in _EXACT for c in w if c not in "'’") else None for s, (*_, w) in zip(own, words)]
        before, after, last = [], [None] * len(words), None
        for s in sure:
            before.append(last)
            last = s or last
        last = None
        for k in range(len(words) - 1, -1, -1):
            after[k] = last
            last = sure[k] or last
        out, at = [], 0
        for k, (a, b, w) in enumerate(words):
            new = w
            if len(own[k]) > 1:
                home = before[k] if before[k] == after[k] else None
                new = self._spell(w, home)
                case = True
            elif not sure[k]:
                (mine,) = own[k]
                home = before[k] or after[k]
                amid = home and home != mine and (before[k] in (home, None)) and (after[k] in (home, None))
                code = a and _near_digit.match(text[a - 1]) or b < len(text) and _near_digit.match(text[b])
                if amid and not (code and mine == "latin") and not (len(w) == 1 and _ABBREVIATED.match(text, b)):
                    spelt = self._spell(w, home)
                    if spelt != w:
                        new, case = spelt, True
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), case


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[tuple[str, str, str]] = Counter()
    for b in batches:
        total.update(Bigrams.counts(t for t in b.column(0).to_pylist() if t is not None))
    columns = [pa.array([x[k] for x in total], pa.string()) for k in range(3)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(list(total.values()), pa.int64())], names=["alphabet", "a", "b", "n"])


def fit(tables: list[tuple[DataFrame, str]]) -> Canon:
    """A canon whose bigrams are counted over all different texts of each table; tasks add up their own, so only pairs of letters are sent."""
    counts: Counter[tuple[str, str, str]] = Counter()
    for df, col in tables:
        texts = df.select(F.col(col).alias("t")).where(F.col(col).isNotNull()).distinct()
        for *pair, n in texts.mapInArrow(_count, "alphabet string, a string, b string, n long").groupBy("alphabet", "a", "b").agg(F.sum("n").alias("n")).collect():
            counts[tuple(pair)] += n
    return Canon([], counts)


def canonical(df: DataFrame, canon: Canon, id_col: str, text_col: str) -> DataFrame:
    """``(row_id, text, is_case)`` of every row: the text's one form; null stays null and is no case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, False) if t is None else canon.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([c for _, c in done], pa.bool_())], names=["row_id", "text", "is_case"])

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "row_id long, text string, is_case boolean")
