"""Readers and writers of dictionary files: term tables, speakers, rules, foreign dictionaries."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.operators.lexicon import Rule, check_pattern

_TERMS = "source string, target string, scope string, priority int, flags array<string>, pack string, ordinal long"


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)``: every file is small, so its lines are numbered inside it."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return whole.where(F.trim("value") != "")


def _flags(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(c, ","), lambda x: x != "")))


def _ordinal() -> Column:
    return F.row_number().over(Window.partitionBy("file").orderBy("line_no")).cast("long")


def read_terms(spark: SparkSession, path: str, pack: str) -> DataFrame:
    """Tab-separated terms: source, target, scope, priority, flags. A header, blank lines and lines with fewer fields are skipped; a bad priority is 0, an empty scope global."""
    lines = _numbered_lines(spark, path).where(~((F.col("line_no") == 0) & F.col("value").startswith("source\t")))
    p = F.split("value", "\t")
    rows = lines.where(F.size(p) >= 5).select(p[0].alias("source"), p[1].alias("target"), F.coalesce(F.nullif(p[2], F.lit("")), F.lit("global")).alias("scope"), F.coalesce(p[3].try_cast("int"), F.lit(0)).alias("priority"), _flags(p[4]).alias("flags"), F.lit(pack).alias("pack"), _ordinal().alias("ordinal"))
    return rows


def read_speakers(spark: SparkSession, path: str, pack: str) -> DataFrame:
    """JSON lines with a ``surface``: names that stay as they are. Malformed lines and empty names are skipped."""
    lines = _numbered_lines(spark, path).withColumn("surface", F.trim(F.get_json_object("value", "$.surface")))
    return lines.where("coalesce(surface, '') <> ''").select(F.col("surface").alias("source"), F.col("surface").alias("target"), F.lit("global").alias("scope"), F.lit(60).alias("priority"), F.array(F.lit("speaker")).alias("flags"), F.lit(pack).alias("pack"), _ordinal().alias("ordinal"))


def read_rules(path: str, pack: str) -> list[Rule]:
    """Tab-separated rules: pattern, replacement, scope, priority. A pattern that is refused fails the load."""
    return parse_rules(Path(path).read_text(encoding="utf-8").splitlines(), pack)


def parse_rules(lines: list[str], pack: str) -> list[Rule]:
    """The rules of a file's lines; a header and short lines are skipped, a bad priority is 0, a repeated pattern keeps its first rule."""
    out = []
    for k, line in enumerate(lines):
        parts = line.split("\t")
        if len(parts) < 4 or (k == 0 and parts[0].lower() == "pattern"):
            continue
        number = int(parts[3]) if re.fullmatch(r"\s*[+-]?\d+\s*", parts[3]) else 0
        out.append(Rule(check_pattern(parts[0]), java_replacement(parts[1]), parts[2] or "global", number, pack))
    seen: dict[tuple, Rule] = {}
    for r in out:
        seen.setdefault((r.pattern, r.scope, r.pack), r)
    return list(seen.values())


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """``(section, source, target)`` of a TOML file; an unreadable file has no rows."""
    try:
        return glossary_rows(spark, Path(path).read_text(encoding="utf-8"))
    except OSError:
        return glossary_rows(spark, "")


def glossary_rows(spark: SparkSession, content: str) -> DataFrame:
    """``(section, source, target)`` of a TOML text; a malformed one has no rows."""
    try:
        data = tomllib.loads(content)
    except tomllib.TOMLDecodeError:
        data = {}
    rows = [(s, k, str(v)) for s, entries in data.items() if isinstance(entries, dict) for k, v in entries.items()]
    return spark.createDataFrame(rows, "section string, source string, target string")


def flat_glossary(glossary: dict[str, dict[str, str]]) -> dict[str, str]:
    """All sections in one map; a later section replaces an earlier one."""
    return {k: v for entries in glossary.values() for k, v in entries.items()}


def java_replacement(text: str) -> str:
    r"""Group references in Java's form: ``\1`` becomes ``$1``."""
    return re.sub(r"\\(\d+)", r"$\1", text)


def flags_first(pattern: str) -> str:
    """Inline flags before an anchor: ``^(?i)`` becomes ``(?i)^``."""
    m = re.match(r"\^(\(\?[a-zA-Z]+\))", pattern)
    return f"{m[1]}^{pattern[m.end() :]}" if m else pattern


def unescape(c: Column) -> Column:
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\=", "=")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def detect_format(lines: DataFrame, hint: str | None = None) -> str:
    """xunity when a hint or a rule line says so, else plain."""
    if hint in ("xunity", "plain", "tenuki"):
        return "plain" if hint == "tenuki" else hint
    return "xunity" if lines.where(F.trim("value").rlike("^s?r:")).limit(1).count() else "plain"


def parse_foreign(lines: DataFrame, form: str) -> DataFrame:
    """``(line_no, kind, source, target)`` of a foreign dictionary: exact, rule, or skipped with a note in ``target``.

    Comments are left out; directives, empty sides, equal sides and lines
    without a separator are skipped with a note.
    """
    v = F.regexp_replace("value", "^\\ufeff", "")
    rule, pair, tab = r"(?s)^s?r:(.+?)=(.*)$", r"(?s)^(.+?)=(.*)$", r"(?s)^([^\t]*)\t([^\t]*)"
    x = form == "xunity"
    kind = F.when(v.rlike(r"^\[.*\]$") & F.lit(x), "directive").when(v.rlike(rule) & F.lit(x), "rule").when(v.contains("\t") & F.lit(not x), "tab").when(v.rlike(pair), "pair").otherwise("unparsed")
    rows = lines.where(~v.rlike("^(#|//)") & (v != "")).select("line_no", v.alias("v"), kind.alias("k"))
    get = lambda g: F.when(F.col("k") == "rule", F.regexp_extract("v", rule, g)).when(F.col("k") == "tab", F.regexp_extract("v", tab, g)).when(F.col("k") == "pair", F.regexp_extract("v", pair, g))
    src, dst = (unescape(get(g)) if x else get(g) for g in (1, 2))
    rows = rows.select("line_no", "v", "k", src.alias("s"), dst.alias("t"))
    good = F.col("k").isin("pair", "tab") & (F.col("s") != "") & (F.col("t") != "") & (F.col("s") != F.col("t"))
    out = F.when(good, "exact").when(F.col("k") == "rule", "rule").otherwise("skipped")
    note = F.when(F.col("k") == "directive", "directive").when(F.col("k") == "unparsed", "unparsed").otherwise("empty or equal sides")
    return rows.select("line_no", out.alias("kind"), F.when(out == "skipped", F.col("v")).otherwise(F.col("s")).alias("source"), F.when(out == "skipped", note).otherwise(F.col("t")).alias("target"))


def read_foreign(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    lines = _numbered_lines(spark, path)
    return parse_foreign(lines, detect_format(lines, hint))


def write_terms(terms: DataFrame, path: str) -> None:
    """Tab-separated terms with a header; rows with a tab or line break in a cell are left out."""
    clean = terms.where(~F.concat_ws("", "source", "target").rlike("[\t\r\n]"))
    clean.select("source", "target", "scope", F.col("priority").cast("string").alias("priority"), F.array_join("flags", ",").alias("flags")).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "\u0000").csv(path)
