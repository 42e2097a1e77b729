"""Lines of two reads of a frame against each other: by place, by text, name beside body."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import boxes, gates, labels, text
from glyphmill.operators import tracking

# Limits of a name plate beside or above its body, in line heights or shares.
SIDE_GAP, SIDE_LEAST, SIDE_OVERLAP, ABOVE_GAP, ABOVE_MOST, BODY_LENGTH = 1.6, 24.0, 0.35, 1.6, 40.0, 28
SPOKEN_OVERLAP, DOUBLE_OVERLAP, ECHO_INSIDE, BAND = 0.28, 0.7, 0.8, 16

_marks = re.compile(r"[\s.,!?'\"—–-]+")


def _other(df: DataFrame, frame: list[str], names: dict[str, str]) -> DataFrame:
    return df.select(*frame, *(F.col(k).alias(v) for k, v in names.items()))


def without_overlapping(lines: DataFrame, others: DataFrame, frame: list[str], least: float = SPOKEN_OVERLAP) -> DataFrame:
    """Lines that no other line of their frame overlaps by ``least`` of the smaller box."""
    o = _other(others, frame, {"box": "_box"})
    return lines.join(o, [*(lines[c] == o[c] for c in frame), boxes.overlap_ratio(lines["box"], o["_box"]) >= least], "left_anti")


def merge_by_place(kept: DataFrame, fresh: DataFrame, frame: list[str]) -> DataFrame:
    """Fresh lines, and the kept ones that none of them may be."""
    f = _other(fresh, frame, {"box": "_box"})
    rest = kept.join(f, [*(kept[c] == f[c] for c in frame), boxes.may_be_same(kept["box"], f["_box"])], "left_anti")
    return fresh.unionByName(rest)


def drop_echoes(lines: DataFrame, paragraphs: DataFrame, frame: list[str], likeness: float = 0.85) -> DataFrame:
    """Lines that aren't a paragraph's line read again: inside its box and of like words."""
    p = _other(paragraphs, frame, {"box": "_box", "text": "_text"})
    x = lines.join(p, frame)
    inside = boxes.intersection_area(F.col("box"), F.col("_box")) >= ECHO_INSIDE * boxes.area(F.col("box"))
    a, b = text.words_form(F.col("text")), text.words_form(F.col("_text"))
    near = x.where(inside & (F.length(a) >= 8)).withColumn("_r", tracking.sequence_ratio(a, b)).where(F.col("_r") >= likeness).select(*frame, "id").distinct()
    return lines.join(near, [*frame, "id"], "left_anti")


def _start_key(t: str) -> str:
    return _marks.sub("", t).casefold()


def _share_start(a: str, b: str) -> bool:
    shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return bool(a and b) and shared >= max(12, int(min(len(a), len(b)) * 0.45))


def _lines_of(t: str, box: dict | None) -> list[tuple[float, float, str]]:
    """Top, bottom and key of each line of a block, whose height its lines share evenly."""
    if box is None or any(box[c] is None for c in ("x1", "y1", "x2", "y2")):
        return []
    parts = t.strip("\n").split("\n")
    step = (box["y2"] - box["y1"]) / len(parts)
    return [(box["y1"] + k * step, box["y1"] + (k + 1) * step, _start_key(p)) for k, p in enumerate(parts)]


def longest_reads(lines: DataFrame, frame: list[str], near: int = 4) -> DataFrame:
    """Of the reads of each paragraph the one that reached furthest.

    Reads with most lines, then the longest, come first. A read is dropped when
    its first line lies within ``near`` pixels of a kept one's and shares its
    start, or when it lies at a line of a kept one (8 pixels about it) and
    shares that line's start. One frame is compared at a time.
    """

    def greedy(part: pa.Table) -> pa.Table:
        texts = [t or "" for t in part["text"].to_pylist()]
        ids = part["id"].to_pylist()
        reads = [_lines_of(t, b) for t, b in zip(texts, part["box"].to_pylist())]
        kept: list[int] = []
        for k in sorted(range(len(texts)), key=lambda k: (-len(reads[k]), -len(texts[k]), ids[k] is None, ids[k])):
            own, key = reads[k], _start_key(texts[k])
            if not any(own and reads[j] and (_same_read(own, reads[j], near) or _covered(own[0][0], key, reads[j])) for j in kept):
                kept.append(k)
        return part.take(sorted(kept))

    return lines.groupBy(*frame).applyInArrow(greedy, lines.schema)


def _same_read(a: list[tuple], b: list[tuple], near: int) -> bool:
    return abs(a[0][0] - b[0][0]) <= near and _share_start(a[0][2], b[0][2])


def _covered(y: float, key: str, paragraph: list[tuple]) -> bool:
    top, bottom, best = min(paragraph, key=lambda p: abs(p[0] - y))
    return top - 8 <= y <= bottom + 8 and _share_start(key, best)


def union_of_halves(first: DataFrame, second: DataFrame, frame: list[str], cell: int = 4) -> DataFrame:
    """All lines of both halves of a frame, of those that start in one cell of pixels the first, the first half before the second."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(*frame, F.floor(F.col("box.x1") / cell), F.floor(F.col("box.y1") / cell)).orderBy("_p", "id")
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_p")


def best_in_band(primary: DataFrame, extra: DataFrame, frame: list[str], band: int = BAND) -> DataFrame:
    """Two reads of a frame in one: in each band and column of pixels the surer line, of equal ones the longer."""
    both = primary.withColumn("_p", F.lit(0)).unionByName(extra.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(*frame, F.floor(F.col("box.y1") / band), F.floor(F.col("box.x1") / (band * 8))).orderBy(F.desc_nulls_last("conf"), F.desc(F.length("text")), "_p", "id")
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_p")


def _plate(t: Column) -> Column:
    return F.length(F.trim(t)).between(2, 24) & ~t.rlike(r"[.!?。！？,:;]\s*$") & labels.gates.is_speaker_prefix(t)


def name_plates(lines: DataFrame, frame: list[str]) -> DataFrame:
    """``(frame, name_id, body_id, how)``: a short name beside its body, or right above it; each line in one pair, the closest first."""
    a = _other(lines, frame, {"id": "name_id", "text": "nt", "box": "nb"}).where(_plate(F.col("nt")))
    b = _other(lines, frame, {"id": "body_id", "text": "bt", "box": "bb"}).where((F.length("bt") >= BODY_LENGTH) | gates.is_spoken_line(F.col("bt")))
    n, m = F.col("nb"), F.col("bb")
    h = F.greatest(F.lit(12), boxes.height(n))
    rows = F.greatest(F.lit(0), F.least(n["y2"], m["y2"]) - F.greatest(n["y1"], m["y1"])) / F.greatest(F.lit(1), F.least(boxes.height(n), boxes.height(m)))
    gap, drop = m["x1"] - n["x2"], m["y1"] - n["y2"]
    side = (gap > F.greatest(F.lit(SIDE_LEAST), SIDE_GAP * h)) & (rows >= SIDE_OVERLAP) & (boxes.width(m) >= 1.1 * boxes.width(n))
    shared = F.least(n["x2"], m["x2"]) - F.greatest(n["x1"], m["x1"])
    above = (drop >= -4) & (drop <= F.greatest(F.lit(ABOVE_MOST), ABOVE_GAP * h)) & (((n["x1"] >= m["x1"] - 24) & (n["x2"] <= m["x2"] + 32)) | (shared >= F.greatest(F.lit(12), 0.4 * boxes.width(n)))) & (F.length("nt") < F.length("bt"))
    pairs = a.join(b, frame).where((F.col("name_id") != F.col("body_id")) & (side | above)).withColumn("how", F.when(side, "side").otherwise("above")).withColumn("d", boxes.distance(n, m))
    first = F.row_number().over(Window.partitionBy(*frame, "name_id").orderBy("d", "body_id"))
    second = F.row_number().over(Window.partitionBy(*frame, "body_id").orderBy("d", "name_id"))
    return pairs.withColumn("_i", first).where("_i = 1").withColumn("_j", second).where("_j = 1").select(*frame, "name_id", "body_id", "how")


def finish_frame(lines: DataFrame, frame: list[str], most: int = 80) -> DataFrame:
    """Distinct texts of a frame by their compare form, in reading order, at most ``most``."""
    first = Window.partitionBy(*frame, "_form").orderBy("box.y1", "box.x1", "id")
    place = Window.partitionBy(*frame).orderBy("box.y1", "box.x1", "id")
    kept = lines.withColumn("_form", text.compare_form(F.col("text"))).where("_form <> ''").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return kept.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= most).drop("_k", "_form")
