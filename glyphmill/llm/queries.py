"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, copies, languages, lookalikes, near_copies, oracles, packing, residue, responses, scans, truncation
from glyphmill.session import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    memory = load(spark, d, "memory")
    group = copies.memory_key(F.col("source_text"), F.col("source_lang"), F.col("target_lang"))
    pairs = near_copies.near_copy_pairs(memory, group)
    return pairs.select(F.col("a").alias("memory_id_a"), F.col("b").alias("memory_id_b"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    memory = load(spark, d, "memory")
    group = copies.memory_key(F.col("source_text"), F.col("source_lang"), F.col("target_lang"))
    return near_copies.NearCopies(memory, group).links()


def _scans(spark: SparkSession, d: str) -> scans.Scans:
    t, m = load(spark, d, "translations"), load(spark, d, "memory")
    one = t.select(F.lit("translations").alias("tbl"), F.col("entry_id").alias("row_id"), F.col("source_text").alias("text"))
    return scans.Scans(one.unionByName(m.select(F.lit("memory").alias("tbl"), F.col("memory_id").alias("row_id"), F.col("source_text").alias("text"))))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).found()


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).repaired()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.find_copies(copies.all_fingerprints(load(spark, d, "memory"), load(spark, d, "translations")))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(copies.all_fingerprints(load(spark, d, "memory"), load(spark, d, "translations")))


def p3_collisions(spark: SparkSession, d: str) -> DataFrame:
    return copies.collisions(copies.all_fingerprints(load(spark, d, "memory"), load(spark, d, "translations")))


def _scored_cuts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, b = load(spark, d, "translations"), load(spark, d, "tracked_block")
    model = truncation.fit([(t, "source_text"), (b, "text")])
    one = truncation.score(t, model, "entry_id", "source_text", F.col("backend_id"))
    two = truncation.score(b, model, "row_id", "text", F.col("engine"))
    return one, two


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    one, two = (x.where("is_cut") for x in _scored_cuts(spark, d))
    return one.select(F.lit("translations").alias("tbl"), "row_id").unionByName(two.select(F.lit("tracked_block").alias("tbl"), "row_id"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    one, two = _scored_cuts(spark, d)
    both = truncation.shares(one).select(F.lit("backend_id").alias("kind"), "*").unionByName(truncation.shares(two).select(F.lit("engine").alias("kind"), "*"))
    return both.withColumn("share", F.round(F.col("n_cut") / F.col("n_rows"), 6))


def _language_model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, languages.LanguageModel]:
    t, b = load(spark, d, "translations"), load(spark, d, "tracked_block")
    return t, b, languages.fit_model([(t, "source_lang", "source_text"), (b, "lang", "text")])


def _languages(spark: SparkSession, d: str) -> DataFrame:
    t, b, model = _language_model(spark, d)
    one = languages.detect(t, model, "entry_id", "source_lang", "source_text").select(F.lit("translations").alias("tbl"), "*")
    return one.unionByName(languages.detect(b, model, "row_id", "lang", "text").select(F.lit("tracked_block").alias("tbl"), "*"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).where("wrong").select("tbl", "row_id", "lang")


def p5_stretches(spark: SparkSession, d: str) -> DataFrame:
    t, b, model = _language_model(spark, d)
    one = languages.stretches(t, model, "entry_id", "source_text").select(F.lit("translations").alias("tbl"), "*")
    both = one.unionByName(languages.stretches(b, model, "row_id", "text").select(F.lit("tracked_block").alias("tbl"), "*"))
    return both.withColumns({c: F.round(c, 3) for c in ("confidence", "text_confidence")})


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    t, terms = load(spark, d, "translations"), load(spark, d, "terms")
    canon = lookalikes.fit([(t, "source_text"), (terms, "source")])
    one = lookalikes.canonical(t, canon, "entry_id", "source_text").select(F.lit("translations").alias("tbl"), "*")
    return one.unionByName(lookalikes.canonical(terms, canon, "ordinal", "source").select(F.lit("terms").alias("tbl"), "*"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).where("is_case").select("tbl", "row_id")


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("tbl", "row_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return responses.find_defects(load(spark, d, "translations"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_ids(load(spark, d, "documents"))


def _kinds(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r["kind"], r["capacity"]) for r in load(spark, d, "container_kind").orderBy("capacity", "kind").collect()]


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(load(spark, d, "documents"), _kinds(spark, d))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    kinds = _kinds(spark, d)
    return packing.fill(packing.pack_texts(load(spark, d, "documents"), kinds), kinds)


def p9_harmonic_fill(spark: SparkSession, d: str) -> DataFrame:
    """Fill of plain harmonic packing, whose containers hold one class each."""
    kinds = _kinds(spark, d)
    return packing.fill(packing.pack_texts(load(spark, d, "documents"), kinds, mixed=False), kinds)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(load(spark, d, "documents")).where("is_residue").select("doc_id")


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = residue.find_residue(load(spark, d, "documents"))
    return found.select("doc_id", F.round("coverage", 3).alias("coverage"), "placeholder", "is_residue")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_links, p2_found, p2_texts, p3_found, p3_records, p3_collisions, p4_found, p4_shares, p5_found, p5_stretches, p6_found, p6_texts, p7_found, p8_ids, p9_containers, p9_fill, p9_harmonic_fill, p10_found, p10_coverage)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
