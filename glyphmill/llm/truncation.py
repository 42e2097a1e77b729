"""Problem 4: texts cut off by field limits or in transfer.

Intact values are cut artificially, at limits seen in the data and anywhere, with
and without the remains that cuts leave (dots, half an escape, replacement
characters). A hashed logistic regression learns from the closing characters, the
punctuation, the last word and the length's distance to a limit, and then scores
every record. Lengths, words and the regression come from all different texts:
words and lengths are counted over all of them, each part of them, chosen by
hash, fits a regression, and the weights are averaged.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.linear import HashedLikelihood, HashedLogistic, merged
from glyphmill.session import materialize

#: Texts of one part, which fits a regression of its own; no text is left out.
PART_TEXTS = 12_000
#: Occurrences from which a word is as well known as can be told.
WELL_KNOWN = 6
#: Artificial cuts of an intact text.
CUTS = 4

# What cuts leave behind, and what writers put after a whole word.
REMAINS = ["�", "��", "���", "%D0%", "%E3%8", "%C3", "&am", "&#10", "&#", "&qu", "<b", "</", "<br", "\\x", "\\u", "\\u04", "\\"]
DOTS = ["…", "...", " [...]", " […]", "..", "……", " ..."]
TRAILS = ["...", "…", " …", "……", "♪", " ♪", " (~)", "~", "〜", "!!", "?!", "☆", "—", "”", '"', "」", "*", ")", "»", " !", " ..."]

_STOP = re.compile(r"[.!?。！？]$")
_INNER_STOP = re.compile(r"[.!?。！？]\s*\S")
_TAIL = re.compile(r"[^\w�]*$")
_BROKEN = re.compile(r"(?:�+|%[0-9A-F]{1,2}(?:%[0-9A-F]{0,2})*%?|&#?\w{0,4}|</?\w{0,3}|\\(?:[xu]\w{0,3})?)$")
_token = re.compile(r"[^\W_]+")
_FIELDS = re.compile(r"(?:[^\W\d_]{1,8}\.? ?[:=]? ?\d+(?:/\d+)?\W*){2,}$")
_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_LABEL = re.compile(r"\s*(?:[^\W\d_][\w'’\-]*\s+){1,4}\d+\s*$")
_ENDED = re.compile(r"(?:[^.]\.|[!?。！？])$")
_BLANKS = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")


def is_page(text: str) -> bool:
    """Whether the text is set in lines that break inside sentences, as scanned pages are."""
    if text.count("\n") < 3:
        return False
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    inside = sum(not re.search(r"[.!?。！？…:：\d]$", x) for x in lines[:-1])
    return len(lines) >= 4 and inside >= 0.4 * (len(lines) - 1)


def sorted_out(sample: Iterable[str]) -> tuple[set[str], set[str], set[str]]:
    """The different texts that are no pages, and those of them that are intact, and labels."""
    texts = {t.strip() for t in sample if t and t.strip() and not is_page(t)}
    intact = {t for t in texts if _STOP.search(t) and len(t) >= 20 and not _BROKEN.search(t) and not re.search(r"\.\.$", t)}
    labels = {t for t in texts if not _INNER_STOP.search(t) and len(t) <= 90 and re.search(r"\d\W*$", t) and "\n" not in t and not re.search(r"[.!?。！？,，、:：]\s", t[:-1].replace(": ", " ", 1) if _FIELDS.search(t) else t)}
    return texts, intact, labels


def inner_words(text: str) -> list[str]:
    """The words of an intact text but its last one."""
    return [w for w in _token.findall(text.rstrip(".!?"))[:-1] if not _WIDE.search(w)]


def field_limits(odd: Counter[int], even: Counter[int]) -> set[int]:
    """The lengths that unusually many texts without a stop have; ``odd`` counts those, ``even`` all texts."""
    return {n for n, k in odd.items() if k >= 4 and k > 0.25 * even[n] and k > 3 * (odd[n - 5] + odd[n + 5] + odd[n + 7] + 1) / 3}


class TruncationModel:
    """Scores texts; positive margins are cut."""

    learner = HashedLogistic

    def __init__(self, sample: list[str], seed: int = 11):
        texts, intact, labels = sorted_out(sample)
        self.words = Counter(w for t in intact for w in inner_words(t))
        odd = Counter(len(t) for t in texts if not _STOP.search(t) and t not in labels)
        self.limits = field_limits(odd, Counter(len(t) for t in texts))
        self.model = self.learner_of(sample, seed)

    @classmethod
    def of(cls, words: dict[str, int], limits: set[int]) -> TruncationModel:
        """A model with words and limits that were counted, without a regression yet."""
        out = cls.__new__(cls)
        out.words, out.limits, out.model = words, limits, None
        return out

    def examples(self, sample: list[str], seed: int = 11) -> tuple[list[str], list[str]]:
        """Whole texts and artificially cut ones."""
        rng = random.Random(seed)
        texts, intact, labels = sorted_out(sample)
        texts = sorted(texts)
        rng.shuffle(texts)
        intact, labels = [t for t in texts if t in intact], [t for t in texts if t in labels]
        limits = sorted(self.limits)
        good, bad = [*intact, *labels, *labels], []
        for t in intact:
            body = re.sub(r"\s*[.!?。！？]+$", "", t)
            good += [body + rng.choice(TRAILS) for _ in range(2)]
            for _ in range(CUTS):
                fit = [n for n in limits if 6 <= n < len(body)]
                at = rng.choice(fit) if fit and rng.random() < 0.6 else rng.randint(min(6, len(body) - 1), len(body) - 1)
                head = t[:at]
                if not head.strip() or _STOP.search(head.strip()):
                    continue
                half = head[-1:].isalnum() and t[at : at + 1].isalnum()
                kind = rng.random()
                if kind < 0.25 and half:
                    head += rng.choice(DOTS[:4] if kind < 0.2 else DOTS)
                elif kind < 0.45:
                    head += rng.choice(REMAINS)
                bad.append(head)
        return good, bad

    def learner_of(self, sample: list[str], seed: int = 11) -> HashedLogistic | None:
        """The regression of some texts, under the model's words and limits; None where they hold no example of a kind."""
        good, bad = self.examples(sample, seed)
        if not good or not bad:
            return None
        label = np.concatenate((np.zeros(len(good)), np.ones(len(bad))))
        return self.learner().fit([self.features(t) for t in good + bad], label)

    def features(self, text: str) -> list[int]:
        """Hashed features of the text's end."""
        size = len(text)
        near = "at" if size in self.limits else "near" if any(n in self.limits for n in range(size, size + 4)) else "off"
        # the end in one form: compatibility forms, composed accents, no invisible characters
        bare = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text[-160:]))
        bare, blank = bare.rstrip(), "b" if bare[-1:].isspace() else ""
        label = size <= 40 and len(_token.findall(bare)) <= 5 and bare[-1:].isdigit() and not _INNER_STOP.search(bare)
        broken = _BROKEN.search(bare)
        tail = _TAIL.search(bare)[0].strip()
        body = bare[: broken.start()] if broken else bare[: len(bare) - len(_TAIL.search(bare)[0])]
        mark = "broken" if broken else tail[-6:]
        last = _token.findall(body[-40:])
        word = last[-1] if last else ""
        wide = bool(_WIDE.search(word[-1:]))
        seen = self.words.get(word, 0)
        level = "w" if wide else "d" if word.isdigit() else "0" if not seen else "1" if seen < 2 else "2" if seen < 6 else "3"
        flow = "flow" if _INNER_STOP.search(bare) else "fields" if _FIELDS.search(bare) else "many" if size > 60 else "few"
        prior = last[-2] if len(last) > 1 else ""
        names = [
            "bias", f"label{label}", f"label{label}|{near}", f"m{mark}", f"m{mark[-1:]}", f"l{level}|{mark}", f"f{flow}|{mark}", f"f{flow}|{level}|{mark[-1:]}|{blank}", f"n{near}|{mark}", f"n{near}|{level}", f"b{blank}|{mark}|{level}",
            f"w{word.lower()}|{mark[-1:]}", f"p{prior.lower()}|{word.lower()}|{mark[-1:]}", f"q{min(len(word), 8)}|{level}|{mark[-1:]}",
            *(f"s{body[-k:].lower()}|{mark[-1:]}" for k in (1, 2, 3, 4, 6, 8)), *(f"t{body[-k:].lower()}" for k in (2, 4, 6)),
        ]
        return [zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in names]

    def cut(self, texts: list[str]) -> np.ndarray:
        """Whether each text is cut; never for blank texts, labels, scanned pages and texts that end in a single stop."""
        if self.model is None:
            return np.zeros(len(texts), dtype=bool)
        whole = np.array([not t.strip() or is_page(t) or bool(_LABEL.match(t)) or bool(_ENDED.search(t)) for t in texts], dtype=bool)
        return (self.model.margin([self.features(t) for t in texts]) > 0) & ~whole


class EndLikelihood(TruncationModel):
    """The same ends, judged by the likelihood ratio of their n-grams between cut and whole texts."""

    learner = HashedLikelihood


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of intact texts, of the lengths of texts that don't end, and of all lengths."""
    for b in batches:
        texts, intact, labels = sorted_out(b.column(0).to_pylist())
        words = Counter(w for t in intact for w in inner_words(t))
        odd, even = Counter(len(t) for t in texts if not _STOP.search(t) and t not in labels), Counter(map(len, texts))
        rows = [*(("w", w, n) for w, n in words.items()), *(("o", str(k), n) for k, n in odd.items()), *(("e", str(k), n) for k, n in even.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], names=["kind", "item", "n"])


def fit(tables: list[tuple[DataFrame, str]], part_texts: int = PART_TEXTS) -> TruncationModel:
    """A model of all different texts of some tables."""
    texts = None
    for df, col in tables:
        own = df.select(F.btrim(F.col(col), F.lit(_BLANKS)).alias("t")).where("t <> ''")
        texts = own if texts is None else texts.unionByName(own)
    texts = materialize(texts.distinct())
    told = texts.mapInArrow(_tell, "kind string, item string, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    words, lengths = {}, {"o": Counter(), "e": Counter()}
    for kind, item, n in told.select("kind", "item", F.when(F.col("kind") == "w", F.least("n", F.lit(WELL_KNOWN))).otherwise(F.col("n")).alias("n")).toLocalIterator():
        if kind == "w":
            words[item] = n
        else:
            lengths[kind][int(item)] = n
    bare = TruncationModel.of(words, field_limits(lengths["o"], lengths["e"]))
    parts = max(1, round(texts.count() / part_texts))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [t for b in batches for t in b.column(0).to_pylist()]
        good, bad = bare.examples(part)
        if good and bad:
            flat, sizes = TruncationModel.learner().slots([bare.features(t) for t in good + bad])
            fitted = TruncationModel.learner().fit_slots(flat, sizes, np.concatenate((np.zeros(len(good)), np.ones(len(bad)))))
            count = np.bincount(flat, minlength=len(fitted.weight))
            slots = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(fitted.weight[slots].astype(np.float64) * count[slots]), pa.array(count[slots])], names=["slot", "weight", "n"])

    spread = texts.repartition(parts, F.xxhash64("t")).sortWithinPartitions("t")
    learnt = spread.mapInArrow(learn, "slot long, weight double, n long").groupBy("slot").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).toArrow()
    if learnt.num_rows:
        bare.model = merged(*(learnt.column(k).to_numpy() for k in range(3)))
    return bare


def score(df: DataFrame, model: TruncationModel, id_col: str, text_col: str, source: Column | None = None) -> DataFrame:
    """``(row_id, origin, is_cut)`` of every row; a null text is no case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2).dictionary_encode()
            flags = model.cut([t or "" for t in column.dictionary.to_pylist()])
            codes = column.indices.to_numpy(zero_copy_only=False)
            known = ~np.isnan(codes.astype(np.float64))
            out = np.zeros(b.num_rows, dtype=bool)
            out[known] = flags[codes[known].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["row_id", "origin", "is_cut"])

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), (F.lit(None).cast("string") if source is None else source).alias("origin"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "row_id long, origin string, is_cut boolean")


def shares(scored: DataFrame) -> DataFrame:
    """``(origin, n_rows, n_cut)`` of each source."""
    return scored.groupBy("origin").agg(F.count("*").alias("n_rows"), F.count_if("is_cut").alias("n_cut"))
