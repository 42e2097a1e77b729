"""Problem 9: texts in containers of fixed capacity.

Harmonic packing with refined classes. The lengths are partitioned at the
reciprocals of the capacity (capacity / j for j = 1, 2, ...) and at even steps
between them; a class is handled as if all its items had its upper bound. Only
the number of items in each class, a table of bounded size, goes to the driver,
which fills container patterns, each with a fixed number of items of certain
classes, from the largest class down. Every item then finds its container from
its class and its rank in the class, independently on every worker.

With ``mixed=False`` each container holds items of one reciprocal class only,
j items of the class up to capacity / j, as plain harmonic packing does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.bpe import TOKENIZER_DIR, count_tokens
from glyphmill.session import materialize

#: Even steps into which a capacity is divided besides its reciprocals.
STEPS = 1024
#: Items that the ranks of one hash bucket are about; more items make more buckets.
BUCKET_ITEMS = 50_000


def class_bounds(capacity: int, mixed: bool = True, steps: int = STEPS) -> np.ndarray:
    """Upper bounds of the length classes, ascending."""
    reciprocal = {capacity // j for j in range(1, capacity + 1)}
    even = {-(-capacity * k // steps) for k in range(1, steps + 1)} if mixed else set()
    return np.array(sorted(reciprocal | even), dtype=np.int64)


def plan_patterns(counts: dict[int, int], capacity: int, mixed: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Stretches ``(class bound, first rank, items per container, first container, containers)``.

    ``counts`` has the number of items of each class. The stretches of a class
    cover its ranks without gaps.
    """
    left = {u: n for u, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out, at = [], 0
    if not mixed:
        for u, n in sorted(left.items(), reverse=True):
            per = capacity // u
            out.append((u, 0, per, at, -(-n // per)))
            at += -(-n // per)
        return out
    order = sorted(left, reverse=True)
    while order:
        room, pattern = capacity, []
        for u in order:
            if u <= room:
                per = min(room // u, left[u])
                pattern.append((u, per))
                room -= u * per
                if not room:
                    break
        times = min(left[u] // per for u, per in pattern)
        for u, per in pattern:
            out.append((u, used[u], per, at, times))
            used[u] += per * times
            left[u] -= per * times
        at += times
        order = [u for u in order if left[u]]
    return out


def _place(plans: dict[str, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = np.array(b.column(0).to_pylist(), dtype=object)
            bound, rank = b.column(4).to_numpy(), b.column(5).to_numpy()
            out = np.zeros(b.num_rows, dtype=np.int64)
            for k in set(kind):
                mine = kind == k
                for u in np.unique(bound[mine]).tolist():
                    pick = mine & (bound == u)
                    start, per, first = plans[k][u]
                    s = np.searchsorted(start, rank[pick], side="right") - 1
                    out[pick] = first[s] + (rank[pick] - start[s]) // per[s]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], names=["kind", "doc_id", "piece", "n_tokens", "container_id"])

    return run


def pack(sizes: DataFrame, kinds: list[tuple[str, int]], mixed: bool = True) -> DataFrame:
    """``(kind, doc_id, piece, n_tokens, container_id)`` for every piece of every text and each kind.

    ``sizes`` has (doc_id, n_tokens). A text above the capacity is split into
    pieces of the capacity and a rest; no other text is split. A text without
    tokens needs no room: it has one row with 0 tokens and no container. Kinds
    without a positive capacity are left out.
    """
    kinds = [(k, c) for k, c in kinds if k is not None and c and c > 0]
    total = sizes.count()
    buckets = max(8, total // BUCKET_ITEMS)
    parts = []
    for k, c in kinds:
        piece = F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"cast((n_tokens + {c - 1}) div {c} as int)") - 1, F.lit(0)))).alias("piece")
        cut = sizes.select("doc_id", "n_tokens", piece).select(F.lit(k).alias("kind"), "doc_id", "piece", F.least(F.lit(c), F.col("n_tokens") - F.col("piece") * c).cast("int").alias("n_tokens"))
        parts.append(cut.withColumn("bound", F.when(F.col("n_tokens") > 0, _class_of(F.col("n_tokens"), c, mixed))))
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    items = materialize(items.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")))
    filled = items.where("bound IS NOT NULL")
    counts = filled.groupBy("kind", "bound", "bucket").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("offset", F.sum("n").over(Window.partitionBy("kind", "bound").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")))
    by_kind: dict[str, dict[int, int]] = {k: {} for k, _ in kinds}
    for r in counts.groupBy("kind", "bound").agg(F.sum("n").alias("n")).collect():
        by_kind[r["kind"]][r["bound"]] = r["n"]
    plans = {}
    for k, c in kinds:
        grouped: dict[int, list] = {}
        for u, start, per, first, _ in plan_patterns(by_kind[k], c, mixed):
            grouped.setdefault(u, []).append((start, per, first))
        plans[k] = {u: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for u, rows in grouped.items()}
    rank = F.row_number().over(Window.partitionBy("kind", "bound", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = filled.withColumn("r", rank).join(counts.select("kind", "bound", "bucket", "offset"), ["kind", "bound", "bucket"]).select("kind", "doc_id", "piece", "n_tokens", "bound", (F.col("r") + F.col("offset")).alias("rank"))
    placed = ranked.mapInArrow(_place(plans), "kind string, doc_id long, piece int, n_tokens int, container_id long")
    empty = items.where("bound IS NULL").select("kind", "doc_id", "piece", "n_tokens", F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(empty)


def _class_of(size: Column, capacity: int, mixed: bool) -> Column:
    """The class bound of a length, in closed form: the nearest reciprocal or even step above it."""
    reciprocal = F.expr(f"{capacity} div 1") if capacity == 1 else F.floor(F.lit(capacity) / F.floor(F.lit(capacity) / size))
    if not mixed:
        return reciprocal.cast("long")
    even = F.ceil(F.ceil(size * STEPS / F.lit(capacity)) * capacity / F.lit(STEPS))
    nearest = F.ceil(F.floor(size * STEPS / F.lit(capacity)) * capacity / F.lit(STEPS))
    return F.least(reciprocal, even, F.when(nearest >= size, nearest).otherwise(even)).cast("long")


def pack_texts(df: DataFrame, kinds: list[tuple[str, int]], id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, mixed: bool = True) -> DataFrame:
    """``pack`` for texts, measured in tokens of a public tokenizer."""
    sizes = materialize(count_tokens(df, id_col, text_col, vocabulary, tokenizer_dir).withColumnRenamed(id_col, "doc_id"))
    return pack(sizes, kinds, mixed)


def fill(packed: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """``(kind, n_containers, n_tokens, fill)``: how full the containers of each kind are."""
    room = F.create_map(*(F.lit(x) for k in kinds for x in k))
    sums = packed.where("container_id IS NOT NULL").groupBy("kind", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("kind").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return sums.withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * room[F.col("kind")]), 6))
