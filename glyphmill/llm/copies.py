"""Problem 3: copies hidden by formatting.

Every record is brought to a canonical text with built-in Spark expressions
(no Python), hashed to 128 bits, and counted with map-side combining. A second,
independent 64-bit hash rides in the grouping key, so that two texts whose
128-bit hashes collide still fall into two groups, and collisions are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import materialize

#: Share of all rows from which a group is joined by broadcast.
HOT_SHARE = 1 / 1000

# The signs that may stand between the parts of a key, and what may stand in a language part.
_SIGN = r"\x1f|\|\||\||::|\t"
_LANG = r"(?:[A-Za-z]{2,3}(?:[-_][A-Za-z0-9]{2,4})?|auto|AUTO|unknown|UNKNOWN)?"
_TARGET = r"[A-Za-z]{2,3}(?:[-_][A-Za-z0-9]{2,4})?"
_PAD = r"[ \t\r\n]*"

_KEY_FORMS = (
    # (pattern, group of the source language, of the target language, of the text)
    (rf"(?s)^{_PAD}({_LANG})[ \r\n]*({_SIGN})[ \r\n]*({_TARGET})[ \r\n]*\2(.*)$", 1, 3, 4),
    (rf"(?s)^{_PAD}({_LANG})[ \r\n]*({_SIGN})(.*)\2[ \r\n]*({_TARGET}){_PAD}$", 1, 4, 3),
    (rf"(?s)^(.*?)({_SIGN})[ \r\n]*({_LANG})[ \r\n]*\2[ \r\n]*({_TARGET}){_PAD}$", 3, 4, 1),
)
#: A canonical text made of a name and at least two LABEL number fields.
_STAT = r"^(.*?)((?: \p{L}[\p{L}\p{M}]*? ?\d+){2,}) ?$"


def _spaced(text: Column) -> Column:
    """Lower case, one blank for every run of white space, punctuation or symbols."""
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[\p{P}\p{S}\p{Z}\s\x00-\x1f]+", " ")))


def canonical_text(text: Column) -> Column:
    """The text without case, white space and punctuation; fields of a stat line in sorted order."""
    spaced = _spaced(text)
    tail = F.regexp_extract(spaced, _STAT, 2)
    fields = F.array_sort(F.regexp_extract_all(tail, F.lit(r" (\p{L}[\p{L}\p{M}]*? ?\d+)"), F.lit(1)))
    stat = F.concat(F.replace(F.regexp_extract(spaced, _STAT, 1), F.lit(" "), F.lit("")), F.lit("\x1e"), F.replace(F.array_join(fields, "\x1d"), F.lit(" "), F.lit("")))
    # a digit before the end is what a stat line has and most texts have not: the pattern only runs there
    return F.when(spaced.rlike(r"\d ?$") & spaced.rlike(_STAT), stat).otherwise(F.replace(spaced, F.lit(" "), F.lit("")))


def _bare(part: Column) -> Column:
    return F.regexp_replace(F.lower(part), r"[^\p{L}\p{N}]+", "")


def canonical_key(key: Column) -> Column:
    """A cache key as source language, target language and canonical text, wherever the text stood."""
    parts = F.lit(None).cast("struct<src:string,tgt:string,text:string>")
    for pattern, s, t, x in reversed(_KEY_FORMS):
        own = F.struct(F.regexp_extract(key, pattern, s).alias("src"), F.regexp_extract(key, pattern, t).alias("tgt"), F.regexp_extract(key, pattern, x).alias("text"))
        parts = F.when(key.rlike(pattern), own).otherwise(parts)
    text = canonical_text(F.coalesce(parts["text"], key))
    return F.concat(_bare(F.coalesce(parts["src"], F.lit(""))), F.lit("\x1f"), _bare(F.coalesce(parts["tgt"], F.lit(""))), F.lit("\x1f"), text)


def memory_key(source_text: Column, source_lang: Column, target_lang: Column) -> Column:
    """What two ``memory`` rows must share to be copies; null for a null text."""
    lang = lambda c: F.coalesce(c, F.lit("\x00"))
    return F.concat(lang(source_lang), F.lit("\x1f"), lang(target_lang), F.lit("\x1f"), canonical_text(source_text))


def fingerprints(df: DataFrame, tbl: str, id_col: str, key: Column) -> DataFrame:
    """``(tbl, row_id, h128, h64)`` of every row whose canonical key isn't null."""
    keyed = df.select(F.col(id_col).cast("long").alias("row_id"), key.alias("_key")).where("_key IS NOT NULL")
    return keyed.select(F.lit(tbl).alias("tbl"), "row_id", F.unhex(F.md5("_key")).alias("h128"), F.xxhash64("_key").alias("h64"))


def all_fingerprints(memory: DataFrame, translations: DataFrame) -> DataFrame:
    """Fingerprints of both tables, written once for the stages that follow."""
    m = fingerprints(memory, "memory", "memory_id", memory_key(F.col("source_text"), F.col("source_lang"), F.col("target_lang")))
    t = fingerprints(translations, "translations", "entry_id", canonical_key(F.col("cache_key")))
    return materialize(m.unionByName(t))


def groups(prints: DataFrame) -> DataFrame:
    """``(tbl, h128, h64, kept_id, n_rows)``: the kept record of each group and how many rows the group has."""
    return prints.groupBy("tbl", "h128", "h64").agg(F.min("row_id").alias("kept_id"), F.count("*").alias("n_rows"))


def find_copies(prints: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """``(tbl, kept_id, copy_id)``: one row for each copy.

    A record that occurs once leaves the aggregate before the join. Groups with
    more than ``share`` of all rows, ``1 / share`` of them at most, are told to
    every executor, so that their rows stay where they are read; all others are
    joined by their hash.
    """
    names = {"tbl": "_t", "h128": "_a", "h64": "_b"}
    many = materialize(groups(prints).where("n_rows > 1").select(*(F.col(c).alias(n) for c, n in names.items()), "kept_id", "n_rows"))
    level = F.lit(share * prints.count())
    same = (F.col("h128") == F.col("_a")) & (F.col("h64") == F.col("_b")) & (F.col("tbl") == F.col("_t"))
    told = prints.join(F.broadcast(many.where(F.col("n_rows") > level)), same, "left")
    hot = told.where("_t IS NOT NULL").select("tbl", "kept_id", "row_id")
    rest = told.where("_t IS NULL").select("tbl", "row_id", "h128", "h64").join(many.where(F.col("n_rows") <= level), same).select("tbl", "kept_id", "row_id")
    return hot.unionByName(rest).where("row_id <> kept_id").select("tbl", "kept_id", F.col("row_id").alias("copy_id"))


def collapse(prints: DataFrame) -> DataFrame:
    """``(tbl, kept_id, n_copies)``: one row for each distinct record, with the number of its further copies."""
    return groups(prints).select("tbl", "kept_id", (F.col("n_rows") - 1).alias("n_copies"))


def collisions(prints: DataFrame) -> DataFrame:
    """``(tbl, n_records, n_hashes, n_collisions)``: distinct records, distinct 128-bit hashes, and how many records share one with another."""
    records = groups(prints).groupBy("tbl", "h128").agg(F.count("*").alias("n"))
    sums = records.groupBy("tbl").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_hashes"))
    return sums.withColumn("n_collisions", F.col("n_records") - F.col("n_hashes"))
