"""Requests to a backend: distinct texts, caps, packed batches, and the call itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glyphmill.functions.text import blank_tokens

# Rows and tokens of a batch, distinct requests of a call, lines of a screen.
BATCH_ROWS, BATCH_TOKENS, CALL_CAP, SCREEN_LINES = 8, 512, 28, 120


def distinct_requests(rows: DataFrame, text: str, lang: str, ordinal: str) -> DataFrame:
    """``(text, lang, ordinal, copies)``: each request once, at its first place."""
    return rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").groupBy(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang")).agg(F.min(ordinal).alias("ordinal"), F.count("*").alias("copies"))


def cap_lines(lines: DataFrame, frame: list[str], most: int = SCREEN_LINES) -> DataFrame:
    """The lines of each frame that are most worth translating: sure ones first, then by words, length and place."""
    words = F.regexp_count("text", F.lit(r"\S+"))
    order = [F.when(F.col("conf") >= 0.8, 0).otherwise(1), F.desc(words), F.desc(F.length(F.trim("text"))), F.col("box.y1"), F.col("box.x1"), F.col("row_id")]
    return lines.withColumn("_k", F.row_number().over(Window.partitionBy(*frame).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def pack_batches(rows: DataFrame, call: list[str], ordinal: str, text: str, most_rows: int = BATCH_ROWS, most_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Adds ``batch``: sequential bins of at most 8 rows and 512 blank-separated tokens inside each call.

    A call holds at most CALL_CAP requests, so the ordered fold over one call
    works on a small array; a row above the token limit has its own bin.
    """
    entry = F.struct(F.col(ordinal).alias("o"), blank_tokens(F.col(text)).alias("n"), F.struct(*rows.columns).alias("row"))
    grouped = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in call]).agg(F.array_sort(F.collect_list(entry)).alias("xs"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("rows"), F.lit(0).alias("tokens"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        new = (s["rows"] > 0) & ((s["rows"] >= most_rows) | (s["tokens"] + x["n"] > most_tokens))
        batch = s["batch"] + F.when(new, 1).otherwise(0)
        return F.struct(batch.alias("batch"), (F.when(new, 0).otherwise(s["rows"]) + 1).alias("rows"), (F.when(new, 0).otherwise(s["tokens"]) + x["n"]).alias("tokens"), F.array_append(s["out"], batch).alias("out"))

    bins = F.aggregate("xs", start, step)["out"]
    return grouped.select(F.explode(F.arrays_zip("xs", bins.alias("bins"))).alias("z")).select("z.xs.row.*", F.col("z.bins").alias("batch"))


def run_backend(requests: DataFrame, backend: Callable[[list[str], str], list[str]]) -> DataFrame:
    """Adds ``answer`` to requests (text, lang, ...) by a vectorised backend, one language at a time."""
    schema = StructType([*requests.schema.fields, StructField("answer", StringType())])

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.assign(answer=None)
            for lang, own in part.groupby("lang", dropna=False):
                part.loc[own.index, "answer"] = backend(own["text"].tolist(), lang)
            yield part

    return requests.mapInPandas(call, schema)
