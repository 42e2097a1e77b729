"""Queries over dictionary files, with SQL equivalents for DuckDB.

Each writes the files from a table into the shared folder, reads them with the
readers of ``sources.dictionaries``, and must give the table's rows again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import lexicon
from glyphmill.plans.catalogue import query
from glyphmill.session import load, shared_dir
from glyphmill.sources import dictionaries

_CLEAN = "NOT regexp_matches(coalesce(source, '') || coalesce(target, ''), '[\\t\\r\\n]')".replace("\\\\", "\\")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    f"""SELECT coalesce(source, '') AS source, coalesce(target, '') AS target, coalesce(nullif(scope, ''), 'global') AS scope, coalesce(priority, 0) AS priority, array_to_string(list_sort(list_distinct(list_filter(coalesce(flags, []), lambda f: f <> ''))), ',') AS flags, count(*) AS n
      FROM terms WHERE {_CLEAN} GROUP BY ALL"""
)
def terms_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC1, SNK1: the terms written as tab-separated files and read again; a null priority is 0."""
    path = _folder(spark, "terms")
    dictionaries.write_terms(load(spark, d, "terms"), path)
    rows = dictionaries.read_terms(spark, f"{path}/*.csv", "again")
    return rows.select("source", "target", "scope", "priority", F.array_join("flags", ",").alias("flags")).groupBy("source", "target", "scope", "priority", "flags").agg(F.count("*").alias("n"))


@query("SELECT trim(source) AS source, 60 AS priority, 'speaker' AS flag, count(*) AS n FROM terms WHERE trim(coalesce(source, '')) <> '' GROUP BY 1")
def speakers_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC2: the terms' sources written as JSON lines and read as speakers, between broken lines that are skipped."""
    path = _folder(spark, "speakers")
    rows = load(spark, d, "terms").select(F.to_json(F.struct(F.col("source").alias("surface"))).alias("value"))
    rows.unionByName(rows.select(F.lit("{broken").alias("value")).limit(1)).write.text(path)
    read = dictionaries.read_speakers(spark, f"{path}/*.txt", "again")
    return read.select("source", "priority", F.get("flags", F.lit(0)).alias("flag")).groupBy("source", "priority", "flag").agg(F.count("*").alias("n"))


def _pairs(spark: SparkSession, d: str, sign: str) -> DataFrame:
    """Lines of a foreign dictionary, numbered by the terms' load order."""
    return load(spark, d, "terms").select(F.col("ordinal").alias("line_no"), F.concat(F.coalesce("source", F.lit("")), F.lit(sign), F.coalesce("target", F.lit(""))).alias("value"))


_SRC, _DST = "coalesce(source, '')", "coalesce(target, '')"
_KIND = f"CASE WHEN {_SRC} <> '' AND {_DST} <> '' AND {_SRC} <> {_DST} THEN 'exact' ELSE 'skipped' END"


@query(
    f"""WITH v AS (SELECT ordinal AS line_no, {_SRC} || '=' || {_DST} AS value FROM terms), p AS (SELECT line_no, value, regexp_extract(value, '(?s)^(.+?)=(.*)$', 1) AS s, regexp_extract(value, '(?s)^(.+?)=(.*)$', 2) AS t FROM v WHERE NOT regexp_matches(value, '^(#|//)'))
    SELECT line_no, CASE WHEN s <> '' AND t <> '' AND s <> t THEN 'exact' ELSE 'skipped' END AS kind, CASE WHEN s <> '' AND t <> '' AND s <> t THEN s ELSE value END AS source FROM p"""
)
def foreign_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, SRC10, STR17: the terms as lines of a foreign dictionary with equals signs."""
    lines = _pairs(spark, d, "=")
    marked = lines.unionByName(spark.createDataFrame([(-1, "sr:^a$=b")], "line_no long, value string"))
    form = dictionaries.detect_format(marked)
    return dictionaries.parse_foreign(lines, form).select("line_no", "kind", "source")


@query(
    f"""SELECT ordinal AS line_no, {_KIND} AS kind, CASE WHEN {_KIND} = 'exact' THEN {_SRC} ELSE {_SRC} || chr(9) || {_DST} END AS source, CASE WHEN {_KIND} = 'exact' THEN {_DST} ELSE 'empty or equal sides' END AS target FROM terms WHERE NOT regexp_matches({_SRC}, '^(#|//)')"""
)
def plain_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SRC9, SRC10: the terms as lines of a plain dictionary with tabs."""
    lines = _pairs(spark, d, "\t")
    return dictionaries.parse_foreign(lines, dictionaries.detect_format(lines))


_RULE_LINES = ["pattern\treplacement\tscope\tpriority", "^(.+) (\\d+)$\t\\1 №\\2\tglobal\t10", "broken line", "(?i)lv\\.? ?(\\d+)\tLevel \\1\tglobal\tx", "^(.+) (\\d+)$\tagain\tglobal\t5"]


@query(r"SELECT ordinal, CASE WHEN regexp_matches(coalesce(source, ''), '^(.+) (\d+)$') THEN regexp_replace(source, '^(.+) (\d+)$', '\1 №\2') WHEN regexp_matches(coalesce(source, ''), '(?i)lv\.? ?(\d+)') THEN regexp_replace(source, '(?i)lv\.? ?(\d+)', 'Level \1', 'g') END AS rewritten FROM terms")
def rules_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC4, STR18, STR19, FLT41: rules read from a file, with a header, a broken line, a bad priority and a repeated pattern, and applied to the terms."""
    rules = dictionaries.parse_rules([dictionaries.flags_first(x) for x in _RULE_LINES], "core")
    return load(spark, d, "terms").select("ordinal", lexicon.rewrite(F.col("source"), rules).alias("rewritten"))


_GLOSSARY = {"ui": {"Back": "Назад", "Start": "Старт"}, "names": {"Back": "Бэк"}}


def _toml(sections: dict[str, dict[str, str]]) -> str:
    return "\n".join(f"[{s}]\n" + "\n".join(f'"{k}" = "{v}"' for k, v in entries.items()) for s, entries in sections.items())


@query("SELECT section, source, target FROM (VALUES ('ui', 'Back', 'Назад'), ('ui', 'Start', 'Старт'), ('names', 'Back', 'Бэк')) AS g(section, source, target)")
def glossary_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC5, SRC6: a sectioned glossary; its flat form lets the later section win."""
    rows = dictionaries.glossary_rows(spark, _toml(_GLOSSARY))
    flat = dictionaries.flat_glossary(_GLOSSARY)
    if flat != {"Back": "Бэк", "Start": "Старт"}:
        raise ValueError("the later section must win")
    return rows

