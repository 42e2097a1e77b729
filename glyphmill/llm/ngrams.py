"""Hashed character n-grams over many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the length of each text."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), sizes


def hashed(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n code points that end at each place; the first n - 1 places look past the array's start as zeros."""
    h = np.zeros(len(codes), dtype=np.uint32)
    for k in range(n):
        shifted = codes if k == 0 else np.concatenate((np.zeros(min(k, len(codes)), np.uint32), codes[:-k] if k < len(codes) else codes[:0]))
        h = (h ^ (shifted + np.uint32(0x9E37 * (k + 1)))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def log_table(texts: list[str], n: int, bits: int, blend: float = 0.02) -> np.ndarray:
    """Log probabilities of the hashed n-grams of some texts, blended with the uniform distribution.

    An n-gram that was never seen has the same probability under every table,
    however many texts the table was made of.
    """
    codes, _ = code_points(texts)
    return log_counts(np.bincount(hashed(codes, n, bits), minlength=1 << bits), blend)


def log_counts(count: np.ndarray, blend: float = 0.02) -> np.ndarray:
    """Log probabilities of hashed n-grams that were counted, blended as in ``log_table``."""
    return np.log((1 - blend) * count.astype(np.float64) / max(count.sum(), 1) + blend / len(count)).astype(np.float32)


def long_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each n neighbouring code points; n is a power of two."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    h, k = codes.astype(np.uint64) + np.uint64(1), 1
    while k < n:
        h = (h[:-k] * np.uint64(0x9E3779B97F4A7C15) ^ h[k:]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        k *= 2
    return h


def summed(df: DataFrame, step: Callable[[list[str]], np.ndarray], size: int, rows: int = 500) -> np.ndarray:
    """Sum over all texts of a one-column table of the counts, ``size`` of them, that ``step`` makes of some texts.

    Each task adds up its own counts, so their number bounds what is shuffled and sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                total += step(b.column(0).slice(at, rows).to_pylist())
        slots = np.flatnonzero(total)
        for at in range(0, len(slots), 100_000):
            part = slots[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])

    told = df.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[told.column("slot").to_numpy()] = told.column("n").to_numpy()
    return out


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of consecutive stretches of the given sizes; 0 for an empty stretch."""
    ends = np.cumsum(sizes)
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[ends] - total[ends - sizes]


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows with different keys, at most twice as many, and the same ones at every run.

    A row is in the sample when the hash of its key is below a level that the
    number of rows sets, so each task sends the driver its share only.
    """
    level = int(min(1.0, rows / max(df.count(), 1)) * (1 << 30))
    columns = F.struct(*df.columns)
    picked = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < level)
    return picked.groupBy(key.alias("_key")).agg(F.min(columns).alias("_row")).limit(2 * rows).select("_row.*")
