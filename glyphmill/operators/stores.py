"""Keyed stores as tables: upsert, versioned look-up, touch, eviction, deletion, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.scripts import text_or_empty
from glyphmill.functions.text import strip


def remember(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The memory after all remembered pairs: the last text and backend of each key, the number of uses, first and last time.

    Texts are trimmed; pairs with an empty side, and those that keep their
    source, are skipped. ``order`` breaks ties in time.
    """
    src, dst = strip(F.col("source_text")), strip(F.col("translated_text"))
    usable = events.withColumns({"source_text": src, "translated_text": dst}).where((src != "") & (dst != "") & (src != dst))
    last = F.struct(*order)
    return usable.groupBy(*keys).agg(
        F.max_by("translated_text", last).alias("translated_text"),
        F.max_by("backend_id", last).alias("backend_id"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("last_used_at"),
        F.count("*").alias("use_count"),
    )


def look_up(rows: DataFrame, memory: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the memory's ``translated_text`` by equality of the keys; ``memory`` has one row for each."""
    return rows.join(memory.select(*keys, F.col("translated_text").alias("remembered")), keys, "left")


def versioned_hits(cache: DataFrame, version: str, key: str = "cache_key") -> DataFrame:
    """Cache rows whose stored version is empty, missing or the given one."""
    stored = text_or_empty(F.col("glossary_version"))
    return cache.where(F.col(key).isNotNull() & ((stored == "") | (stored == version)))


def touch(cache: DataFrame, reads: DataFrame, key: str = "cache_key") -> DataFrame:
    """The cache with ``last_used_at`` raised to the latest read of each key (``read_at``)."""
    last = reads.groupBy(key).agg(F.max("read_at").alias("_read"))
    return cache.join(last, key, "left").withColumn("last_used_at", F.greatest("last_used_at", "_read")).drop("_read")


def evict(cache: DataFrame, most: int, partition: list[str], recency: list) -> DataFrame:
    """The ``most`` most recently used rows of each partition; the limit runs before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*recency))
    return cache.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def forget(store: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The store without the keys in ``gone``; null keys are never equal."""
    return store.join(gone.select(*keys).distinct(), keys, "left_anti")


def promote(pack: DataFrame, rows: DataFrame) -> DataFrame:
    """A dictionary pack (source, target) with further rows merged in; a new target replaces an old one."""
    new = rows.groupBy("source").agg(F.max("target").alias("_new"))
    return pack.join(new, "source", "full_outer").select("source", F.coalesce("_new", "target").alias("target"))


def recent(store: DataFrame, target_lang: str | None, most: int = 50) -> DataFrame:
    """The most recently used rows, newest first."""
    kept = store.where(F.col("target_lang") == target_lang) if target_lang else store
    return kept.orderBy(F.desc_nulls_last("last_used_at"), "memory_id").limit(most)
