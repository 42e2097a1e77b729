"""Problem 2: texts read from scanned pages.

Per page (a text set in at least four lines) the layout tells edge lines and
split words: page numbers by their form, running headers by words that stand in
edge lines far more often than in running text. Misread words come from SQL
joins over the whole vocabulary: every word has an anagram hash, the sum of the
fifth powers of its characters, so that a confusion of one shape with another
changes the hash by a constant. Adding the constants of one or two confusions to
the hashes of the rare words of pages, and joining the frequent words on the
result, gives the candidates; those that fold to the same shapes and are far
more frequent are ranked, and the best one is the correction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import materialize

#: Lines from which a text may be a page; lines from which its shape alone tells, and the share of its lines that must be full.
LEAST_LINES, SHAPED_LINES, FULL = 2, 4, 0.5
#: Letters of the longest word whose anagram hash fits.
LONGEST_WORD = 1000
#: A correction's frequency, and how many times more frequent it must be than the misread word.
LEAST_COUNT, RATIO = 10, 15
CODE_RANGE = 1289
#: Texts in whose edge lines a word must stand to be a header word, at any size of the corpus.
HEADER_TEXTS = 3

# Shapes that are misread (left) and what they should be (right).
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("|", "l"), ("|", "i"), ("5", "s"), ("7", "t"), ("9", "g"), ("6", "b"), ("8", "b"), ("4", "a"), ("3", "e"), ("c", "e"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("m", "rn"), ("vv", "w"),
    ("b", "h"), ("h", "b"), ("li", "h"), ("q", "g"),
    ("0", "о"), ("3", "з"), ("4", "ч"), ("6", "б"), ("8", "в"), ("9", "д"), ("и", "н"), ("н", "и"), ("л", "п"), ("п", "л"), ("ь1", "ы"), ("с", "е"), ("е", "с"), ("ш", "щ"), ("щ", "ш"), ("ii", "п"),
]
# Words that stand before or after a page number.
_PAGE_WORDS = "p|pp|pg|page|pages|seite|s|стр|страница|с|pág|pag|página|págs"
_OF = "of|von|sur|de|из|/|\\|"
PAGE_NUMBER = re.compile(
    rf"^(?:[\W_]*\d{{1,4}}[\W_]*|(?:{_PAGE_WORDS})\.?\s*\d{{1,4}}(?:\s*(?:{_OF})\s*\d{{1,4}})?\.?|\d{{1,4}}\s*[|]\s*\d{{1,4}}|\W*第?\s*\d{{1,4}}\s*(?:ページ|頁|页|쪽|페이지)\W*)$", re.I
)
_COUNTER = re.compile(r"\d\s*/\s*\d")
_MARGIN = re.compile(r"^\d{1,4}\s{2,}(?=\S)|(?<=\S)\s{2,}\d{1,4}$")
_LINE = re.compile(r"\r\n|[\n\f\r]")
_ENDED = re.compile(r"[.!?。！？…][\"”»」)*]*$")
_SPLIT = re.compile(r"[^\W\d_][-¬‐\u00ad]\s*$")
_TOKEN = re.compile(r"[ァ-ヶー]+|[ぁ-ん]+|[一-龥々]+|[가-힣]+|[^\W\d_]+")
_KANA = re.compile(r"[ァ-ヶー]")
_WIDE = re.compile(r"[ぁ-ヿ一-龥々、。！？「」『』：；，]")
_LABELS = re.compile(r"^(?:[^\W\d_]{1,4} ?\d+(?:/\d+)?\W*)+(?:\d+/\d+)?$")
#: Words of the vocabulary: letters of two alphabets with what misreading puts between them.
WORD = r"[!|]?[\p{IsLatin}\p{IsCyrillic}0-9]+(?:[!|][\p{IsLatin}\p{IsCyrillic}0-9]+)*"


class Layout:
    """Lines of a text and what they are."""

    def __init__(self, text: str):
        self.lines = [x.strip() for x in _LINE.split(text) if x.strip()]
        n = len(self.lines)
        self.number = [bool(PAGE_NUMBER.match(x)) and not _COUNTER.search(x) for x in self.lines]
        self.margin = [bool(_MARGIN.search(x)) for x in self.lines]
        body = [k for k in range(n) if not self.number[k] and not self.margin[k]]
        self.width = max((len(self.lines[k]) for k in body), default=0)
        self.edge = [False] * n
        for j, k in enumerate(body):
            x = self.lines[k]
            short = j + 1 == len(body) or len(x) + self._first(self.lines[body[j + 1]]) < self.width - 2
            self.edge[k] = len(x) <= 60 and not _ENDED.search(x) and not _LABELS.match(x) and (short or k == 0 or k == n - 1)
        for k in range(n):
            if self.margin[k]:
                self.edge[k] = len(self.lines[k]) <= 70 and not _ENDED.search(self.lines[k])
        self.header = [False] * n
        # a number without any ornament amid short lines is a broken-up text's, not a page's
        for k in range(1, n - 1):
            if self.number[k] and self.lines[k].isdigit() and min(len(self.lines[k - 1]), len(self.lines[k + 1])) < 0.5 * self.width:
                self.number[k] = False

    @staticmethod
    def _first(line: str) -> int:
        """Room that the next line's first word, or character, would have taken."""
        return 1 if _WIDE.match(line) else 1 + len(line.split(" ", 1)[0])

    def is_page(self) -> bool:
        """Whether the running lines are broken by width, as a page's are; two or three lines need a split word or a page number besides."""
        run = [x for k, x in enumerate(self.lines) if not (self.number[k] or self.margin[k] or self.header[k])]
        if len(self.lines) < LEAST_LINES or self.width < 16:
            return False
        if len(self.lines) < SHAPED_LINES:
            return self._is_short_page(run)
        if len(run) < 3:
            return False
        width = sorted(map(len, run))[int(0.9 * (len(run) - 1))]
        if sum(bool(_ENDED.search(x)) for x in run[:-1]) > 0.5 * (len(run) - 1):
            return False
        full = sum(bool(_SPLIT.search(a)) or len(a) + self._first(b) >= width - 3 for a, b in zip(run, run[1:]))
        return full >= FULL * (len(run) - 1)

    def _is_short_page(self, run: list[str]) -> bool:
        split = any(_SPLIT.search(a) and b[:1].islower() for a, b in zip(run, run[1:]))
        numbered = (self.number[0] or self.number[-1]) and len(run) >= 2 and len(run[0]) + self._first(run[1]) >= self.width - 3 and not _ENDED.search(run[0])
        return split or numbered

    def words(self, k: int) -> list[str]:
        return _TOKEN.findall(_MARGIN.sub("", self.lines[k]))

    def find_headers(self, known: frozenset[str]) -> None:
        for k in range(len(self.lines)):
            if self.margin[k] and self.edge[k]:
                self.header[k] = True
            elif self._may_head(k):
                words = self.words(k)
                sure = [w for w in words if w.lower() in known]
                rest = [w for w in words if w.lower() not in known]
                self.header[k] = bool(sure) and len(rest) <= 4 and all(len(w) <= 3 or w[0].isupper() or _KANA.match(w) for w in rest)

    def _may_head(self, k: int) -> bool:
        return not self.number[k] and len(self.lines[k]) <= 60 and not _ENDED.search(self.lines[k]) and not _LABELS.match(self.lines[k])

    def header_candidates(self) -> set[str]:
        """Words by which a line of the text may turn out to be a header."""
        return {w.lower() for k in range(len(self.lines)) if self._may_head(k) for w in self.words(k)}

    def flow(self) -> tuple[list[str], bool]:
        """The running lines, and whether a word is split at one of their ends."""
        run = [x for k, x in enumerate(self.lines) if not (self.number[k] or self.header[k])]
        return run, any(_SPLIT.search(a) and b[:1].isalpha() for a, b in zip(run, run[1:]))

    def furniture(self) -> bool:
        return any(self.number) or any(self.header)


def join_lines(lines: list[str], keep: frozenset[str] = frozenset()) -> str:
    """Running lines as one paragraph; a split word is joined unless its joint is in ``keep``."""
    out = ""
    for x in lines:
        if not out:
            out = x
        elif _SPLIT.search(out) and x[:1].isalpha():
            left, right = re.search(r"[^\W\d_]+$", out.rstrip()[:-1]), re.match(r"[^\W\d_]+", x)
            whole = f"{left[0] if left else ''}-{right[0]}".lower()
            out = out.rstrip()[:-1] + ("-" if whole in keep else "") + x
        elif _WIDE.search(out[-1:]) or _WIDE.match(x) or (x[0] in "。、！？」" and _WIDE.search(out[-2:])):
            out += x
        else:
            out += " " + x
    return out


def _joints(lines: list[str]) -> list[str]:
    out = []
    for a, b in zip(lines, lines[1:]):
        left, right = re.search(r"[^\W\d_]+(?=[-¬‐\u00ad]\s*$)", a), re.match(r"[^\W\d_]+", b)
        if left and right:
            out.append(f"{left[0]}-{right[0]}".lower())
    return out


def _header_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word the texts with it in edge lines and in running lines of pages; the empty word counts pages."""
    edge, other = Counter(), Counter()
    for b in batches:
        for t in b.column(2).to_pylist():
            page = Layout(t)
            if not page.is_page():
                continue
            edge[""] += 1
            out: tuple[set, set] = (set(), set())
            for k in range(len(page.lines)):
                if not page.number[k]:
                    out[not page.edge[k]].update(w.lower() for w in page.words(k))
            edge.update(out[0])
            other.update(out[1])
    words = sorted({*edge, *other})
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([edge[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], names=["word", "edge", "other"])


def header_words(pages: DataFrame) -> DataFrame:
    """``word``: words of running headers: more often in edge lines than in running lines, in HEADER_TEXTS pages or more."""
    counts = materialize(pages.mapInArrow(_header_counts, "word string, edge long, other long").groupBy("word").agg(F.sum("edge").alias("edge"), F.sum("other").alias("other")))
    return counts.where((F.col("edge") >= HEADER_TEXTS) & (F.col("edge") > 1.5 * F.col("other"))).select("word")


def _header_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [sorted(Layout(t).header_candidates()) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))], names=["tbl", "row_id", "words"])


def _lay_out():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            is_page, furniture, split, flow, joints = [], [], [], [], []
            for t, known in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                page = Layout(t)
                page.find_headers(frozenset(known or ()))
                is_page.append(page.is_page())
                lines, cut = page.flow() if is_page[-1] else ([t], False)
                furniture.append(is_page[-1] and page.furniture())
                split.append(cut)
                flow.append("\n".join(lines))
                joints.append(_joints(lines) if is_page[-1] else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(is_page, pa.bool_()), pa.array(furniture, pa.bool_()), pa.array(split, pa.bool_()), pa.array(flow, pa.string()), pa.array(joints, pa.list_(pa.string()))], names=["tbl", "row_id", "page", "furniture", "split", "flow", "joints"])

    return run


def _lined() -> Column:
    return F.size(F.split("text", "[\n\f\r]")) >= LEAST_LINES


def lay_out(texts: DataFrame) -> DataFrame:
    """``(tbl, row_id, page, furniture, split, flow, joints)`` of each text of enough lines; of one that is no page, ``flow`` is the text."""
    lined = texts.where(_lined()).select("tbl", "row_id", "text")
    own = lined.mapInArrow(_header_candidates, "tbl string, row_id long, words array<string>").select("tbl", "row_id", F.explode("words").alias("word"))
    known = own.join(header_words(lined), "word").groupBy(F.col("tbl").alias("_t"), F.col("row_id").alias("_r")).agg(F.collect_set("word").alias("known"))
    told = lined.join(known, F.col("tbl").eqNullSafe(F.col("_t")) & F.col("row_id").eqNullSafe(F.col("_r")), "left").select("tbl", "row_id", "text", "known")
    return told.mapInArrow(_lay_out(), "tbl string, row_id long, page boolean, furniture boolean, split boolean, flow string, joints array<string>")


def words_of(text: Column) -> Column:
    """Words of a text for the vocabulary, lower case, split ones joined."""
    joined = F.regexp_replace(F.lower(text), "(?<=\\p{L})[-¬‐\u00ad][ \t]*\r?\n[ \t]*", "")
    return F.regexp_extract_all(joined, F.lit(WORD), F.lit(0))


def anagram_hash(word: Column) -> Column:
    """Sum of the fifth powers of the code points, which are kept below CODE_RANGE so that the sum fits."""
    code = lambda c: F.ascii(c).cast("long") % CODE_RANGE
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", F.lit(0).cast("long")).otherwise(code(c) * code(c) * code(c) * code(c) * code(c)))


def _hash(s: str) -> int:
    return sum((ord(c) % CODE_RANGE) ** 5 for c in s)


def fold(word: Column) -> Column:
    """The word with all shapes that are confused with each other brought to one."""
    for a, b in (("ii", "u"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ь1", "ы")):
        word = F.replace(word, F.lit(a), F.lit(b))
    return F.translate(word, "0о1!|i5796843cbqнпщес", "oollllstgbbaeehgилшcc")


def vocabulary(texts: DataFrame, laid: DataFrame) -> DataFrame:
    """``(word, n, in_pages)``: how often each word occurs, in all texts and in pages. Only counts are shuffled."""
    plain = texts.where(~_lined()).select(F.explode(words_of(F.col("text"))).alias("word"), F.lit(0).alias("p"))
    lined = laid.select(F.explode(words_of(F.col("flow"))).alias("word"), F.col("page").cast("int").alias("p"))
    return plain.unionByName(lined).where(f"length(word) BETWEEN 2 AND {LONGEST_WORD} AND word RLIKE '[^0-9!|]'").groupBy("word").agg(F.count("*").alias("n"), F.sum("p").alias("in_pages"))


def corrections(words: DataFrame) -> DataFrame:
    """``(word, fix)`` of the misread words of pages."""
    steps = [((a,), _hash(b) - _hash(a)) for a, b in CONFUSIONS]
    steps += [((a, c), _hash(b) - _hash(a) + _hash(d) - _hash(c)) for (a, b), (c, d) in combinations_with_replacement(CONFUSIONS, 2)]
    changes = F.array(*(F.struct(F.lit(len(frm)).alias("steps"), F.lit(frm[0]).alias("one"), F.lit(frm[-1]).alias("two"), F.lit(d).cast("long").alias("d")) for frm, d in steps))
    rare = words.where("in_pages > 0").select("word", "n", anagram_hash(F.col("word")).alias("h"), F.explode(changes).alias("c"))
    rare = rare.where(F.col("word").contains(F.col("c.one")) & F.col("word").contains(F.col("c.two"))).select("word", "n", F.col("c.steps").alias("steps"), (F.col("h") + F.col("c.d")).alias("key"))
    frequent = words.where(f"n >= {LEAST_COUNT} AND NOT word RLIKE '[0-9!|]'").select(F.col("word").alias("fix"), F.col("n").alias("m"), anagram_hash(F.col("word")).alias("key"))
    found = rare.join(frequent, "key").where((F.col("m") >= RATIO * F.col("n")) & (fold(F.col("word")) == fold(F.col("fix"))))
    # letters alone must be many enough to tell a misread word from another word
    found = found.where(F.col("word").rlike("[0-9!|]") | (F.length("word") >= 4))
    best = Window.partitionBy("word").orderBy("steps", F.desc("m"), "fix")
    return found.withColumn("k", F.row_number().over(best)).where("k = 1").select("word", "fix")


class Scans:
    """The stages over some texts ``(tbl, row_id, text)``, null texts left out."""

    def __init__(self, texts: DataFrame):
        self.texts = texts.where("text IS NOT NULL")
        laid = materialize(lay_out(self.texts))
        self.pages = laid.where("page")
        self.words = materialize(vocabulary(self.texts, laid))
        self.fixes = materialize(corrections(self.words))

    def misread(self) -> DataFrame:
        """``(tbl, row_id, word, fix)`` of the misread words of each page."""
        tokens = self.pages.select("tbl", "row_id", F.explode(F.array_distinct(words_of(F.col("flow")))).alias("word"))
        return tokens.join(self.fixes, "word").select("tbl", "row_id", "word", "fix")

    def found(self) -> DataFrame:
        """``(tbl, row_id)`` of the pages with edge lines, split words or misread words."""
        layout = self.pages.where("furniture OR split").select("tbl", "row_id")
        return layout.unionByName(self.misread().select("tbl", "row_id")).distinct()

    def repaired(self) -> DataFrame:
        """``(tbl, row_id, text)`` of the found pages, as continuous paragraphs."""
        joints = self.pages.select("tbl", "row_id", F.explode("joints").alias("joint"))
        parts = F.split("joint", "-")
        counts = self.words.select("word", "n")
        known = lambda df, col, to: df.join(counts.select(F.col("word").alias(col), F.col("n").alias(to)), col, "left")
        joints = joints.select("tbl", "row_id", "joint", F.concat(parts[0], parts[1]).alias("_w"), parts[0].alias("_l"), parts[1].alias("_r"))
        joints = known(known(known(joints, "_w", "nw"), "_l", "nl"), "_r", "nr")
        keep = joints.where("coalesce(nw, 0) <= 1 AND nl >= 10 AND nr >= 10").groupBy("tbl", "row_id").agg(F.collect_set("joint").alias("keep"))
        fixes = self.misread().groupBy("tbl", "row_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "fix"))).alias("fixes"))
        rows = self.pages.join(self.found(), ["tbl", "row_id"]).join(keep, ["tbl", "row_id"], "left").join(fixes, ["tbl", "row_id"], "left")
        rows = rows.select("tbl", "row_id", "flow", F.coalesce("keep", F.array().cast("array<string>")).alias("keep"), F.coalesce(F.map_entries("fixes"), F.array().cast("array<struct<key:string,value:string>>")).alias("fixes"))
        return rows.mapInArrow(_repair, "tbl string, row_id long, text string")


def _like(fix: str, word: str) -> str:
    """The correction in the letter case of the misread word."""
    if word.isupper() and len(word) > 1:
        return fix.upper()
    return fix[:1].upper() + fix[1:] if word[:1].isupper() or (not word[:1].isalpha() and word[1:2].isupper()) else fix


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    token = re.compile(r"[!|]?[^\W_]+(?:[!|][^\W_]+)*")
    for b in batches:
        out = []
        for flow, keep, fixes in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            known = {f["key"]: f["value"] for f in fixes}
            text = join_lines(flow.split("\n"), frozenset(keep))
            out.append(token.sub(lambda m: _like(known[m[0].lower()], m[0]) if m[0].lower() in known else m[0], text))  # noqa: B023
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["tbl", "row_id", "text"])
