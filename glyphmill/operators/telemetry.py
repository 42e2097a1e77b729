"""Timings and counters with exact percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timings(samples: DataFrame, name: str, ms: str, order: str) -> DataFrame:
    """Count, sum, maximum, last value and exact, linearly interpolated percentiles of each series; negative samples count as 0.

    ``percentile`` keeps a map of distinct values and their counts, merged on
    the map side; round the samples where that map would be too large.
    """
    v = F.greatest(F.lit(0.0), F.col(ms).cast("double"))
    return samples.where(F.col(ms).isNotNull()).groupBy(F.col(name).alias("name")).agg(
        F.count("*").alias("n"), F.sum(v).alias("total_ms"), F.max(v).alias("max_ms"), F.max_by(v, F.col(order)).alias("last_ms"), F.percentile(v, F.lit(0.5)).alias("p50"), F.percentile(v, F.lit(0.95)).alias("p95")
    )


def batch_counters(rows: DataFrame, group: str, hit: str) -> DataFrame:
    """Hits and misses of each group."""
    return rows.groupBy(group).agg(F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))
