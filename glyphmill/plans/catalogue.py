"""The queries over the engine's operators, with SQL equivalents for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import boxes, gates, labels, protect, scripts, text
from glyphmill.operators import batching, layout, lexicon, overlap, stores, telemetry, tracking
from glyphmill.session import load, shared_dir
from glyphmill.streaming import blocks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# SQL fragments -------------------------------------------------------------------------------


def n(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({col}, ''), '{pattern}'))"


def letters(col: str) -> str:
    return n(col, r"\p{L}")


def only_letters(col: str) -> str:
    return rf"regexp_replace(coalesce({col}, ''), '[^\p{{L}}]', '', 'g')"


def in_script(col: str, script: str) -> str:
    return f"len(regexp_extract_all({only_letters(col)}, '[{scripts.SCRIPTS[script]}]'))"


def share(col: str, script: str) -> str:
    return f"CASE WHEN {letters(col)} > 0 THEN {in_script(col, script)} / {letters(col)} ELSE 0.0 END"


def fold(col: str) -> str:
    return f"replace(lower(coalesce({col}, '')), 'ß', 'ss')"


_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

def strip(col: str) -> str:
    return f"regexp_replace(coalesce({col}, ''), '^{_SPACE}|{_SPACE}$', '', 'g')"


def compare(col: str) -> str:
    return f"regexp_replace({fold(col)}, '{_SPACE}', '', 'g')"


def collapsed(col: str) -> str:
    return f"trim(regexp_replace({fold(col)}, '{_SPACE}', ' ', 'g'))"


def toks(col: str) -> str:
    return rf"regexp_extract_all({fold(col)}, '[\p{{L}}\p{{N}}_]+')"


def when(*pairs: tuple[str, str], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


_KANA, _HAN, _HANGUL, _LATIN, _CYR = (scripts.KANA, scripts.HAN, scripts.HANGUL, scripts.LATIN, scripts.CYRILLIC)


def detect_sql(col: str) -> str:
    han, lat, cyr, total = n(col, "[一-鿿]"), n(col, _LATIN), n(col, _CYR), letters(col)
    return when(
        (f"regexp_matches(coalesce({col}, ''), '[぀-ヿ]')", "'ja'"), (f"regexp_matches(coalesce({col}, ''), '{scripts.CHINESE_MARKS}')", "'zh-CN'"), (f"{total} < 2", "NULL"),
        (f"regexp_matches(coalesce({col}, ''), '{_HANGUL}')", "'ko'"), (f"{cyr} > 0.3 * {total}", "'ru'"), (f"{han} > 0.3 * {total} AND {lat} < 0.2 * {total}", "'ja'"), (f"{lat} > 0.6 * {total}", "'en'"),
    )


# Scripts and languages -----------------------------------------------------------------------


@query(
    f"""SELECT lang, {detect_sql('text')} AS detected, count(*) AS n_docs, sum({letters('text')})::BIGINT AS letters, round(avg({share('text', 'latn')}), 6) AS mean_latin_share
    FROM documents GROUP BY 1, 2"""
)
def script_profile(spark: SparkSession, d: str) -> DataFrame:
    """LNG1, LNG2, LNG8: letters, Latin share and detected language of the documents, by label."""
    t = F.col("text")
    rows = load(spark, d, "documents").select("lang", scripts.detect_lang(t).alias("detected"), scripts.letter_count(t).alias("k"), scripts.share_in_script(t, "latn").alias("s"))
    return rows.groupBy("lang", "detected").agg(F.count("*").alias("n_docs"), F.sum("k").cast("long").alias("letters"), F.round(F.avg("s"), 6).alias("mean_latin_share"))


@query(
    "SELECT row_id, " + ", ".join(f"round({share('text', s)}, 6) AS {s}" for s in ("latn", "cyrl", "jpan", "hans", "hang")) + f", {letters('text')}::INT AS letters FROM tracked_block"
)
def script_shares(spark: SparkSession, d: str) -> DataFrame:
    """LNG1, LNG2, LNG7: share of each script among the letters of every block."""
    t = F.col("text")
    return load(spark, d, "tracked_block").select("row_id", *(F.round(scripts.share_in_script(t, s), 6).alias(s) for s in ("latn", "cyrl", "jpan", "hans", "hang")), scripts.letter_count(t).alias("letters"))


_DOMINANT = ", ".join(f"{{'k': {in_script('text', s)}, 'at': -(length(regexp_extract(coalesce(text, ''), '^([^{b}]*)', 1)) + 1), 's': '{s}'}}" for s, b in scripts.SCRIPTS.items() if s in ("cyrl", "jpan", "hang", "hans", "arab", "hebr", "deva", "thai", "grek"))


@query(
    f"""SELECT script, count(*) AS n, sum(CASE WHEN code IS NULL THEN 1 ELSE 0 END)::BIGINT AS undecided FROM (
      SELECT script, CASE script WHEN 'cyrl' THEN 'ru' WHEN 'jpan' THEN 'ja' WHEN 'hang' THEN 'ko' WHEN 'hans' THEN 'zh' END AS code FROM (
        SELECT CASE WHEN best.k * 2 >= {letters('text')} THEN best.s END AS script FROM (
          SELECT text, list_sort(list_filter([{{'k': {in_script('text', 'latn')}, 'at': -(length(regexp_extract(coalesce(text, ''), '^((?:[^A-Za-zÀ-ɏ]|[×÷])*)', 1)) + 1), 's': 'latn'}}, {_DOMINANT}], lambda x: x.k > 0), 'DESC')[1] AS best FROM translations)))
    GROUP BY 1"""
)
def dominant_scripts(spark: SparkSession, d: str) -> DataFrame:
    """LNG3, LNG6: dominant script of the translations' sources and whether it names a language."""
    s = load(spark, d, "translations").select(scripts.dominant_script(F.col("source_text")).alias("script"))
    return s.groupBy("script").agg(F.count("*").alias("n"), F.count_if(scripts.code_for_script(F.col("script")).isNull()).alias("undecided"))


_SQL["dominant_scripts"] = _SQL["dominant_scripts"].replace("coalesce(text,", "coalesce(source_text,").replace("SELECT text, list_sort", "SELECT source_text, list_sort")


@query(
    f"""SELECT target_lang, count(*) AS n, sum(CASE WHEN {letters('translated_text')} >= 3 AND (CASE target_lang WHEN 'ru' THEN {share('translated_text', 'cyrl')} WHEN 'ja' THEN {share('translated_text', 'jpan')}
      WHEN 'zh' THEN {share('translated_text', 'hans')} WHEN 'ko' THEN {share('translated_text', 'hang')} ELSE {share('translated_text', 'latn')} END) >= 0.25 THEN 1 ELSE 0 END)::BIGINT AS in_script FROM translations GROUP BY 1"""
)
def target_script_rows(spark: SparkSession, d: str) -> DataFrame:
    """LNG4, LNG5: translations whose text is in the script of their target language."""
    t = load(spark, d, "translations")
    return t.groupBy("target_lang").agg(F.count("*").alias("n"), F.count_if(scripts.is_in_target_script(F.col("translated_text"), F.col("target_lang"))).alias("in_script"))


_k, _h, _l, _c = n("text", _KANA), n("text", _HAN), n("text", _LATIN), n("text", _CYR)


@query(
    f"""SELECT row_id,
      {when((f"{_k} >= 1", f"CASE WHEN {_l} >= 3 THEN 'mixed' ELSE 'ja' END"), (f"{_h} >= 1 AND {_l} >= 3", "'mixed'"), (f"{_h} >= 2", "'ja'"), (f"{_c} >= 2 AND {_l} = 0", "'target'"), (f"{_l} >= 2", "'en'"), (f"{_c} >= 1", "'target'"), other="'unknown'")} AS b_script,
      {when(("trim(coalesce(text, '')) = ''", "''"), (f"{_k} >= 1", "'ja'"), (f"{n('text', _HANGUL)} >= 1", "'ko'"), (f"{_h} >= 1", "'auto'"), (f"{_c} >= 1 AND {_l} < 2", "'ru'"), (f"{_l} >= 2", "'en'"), (f"{_c} >= 1", "'ru'"), other="'auto'")} AS b_lang,
      ({_k} >= 1 OR ({_h} >= 1 AND {_l} < 3)) AS japanese,
      coalesce(nullif(trim(coalesce(lang, '')), ''), CASE script WHEN 'ja' THEN 'ja' WHEN 'en' THEN 'en' ELSE 'auto' END) AS source_lang FROM tracked_block"""
)
def block_languages(spark: SparkSession, d: str) -> DataFrame:
    """LNG10-LNG12, LNG14-LNG16: script and language of single blocks."""
    t = F.col("text")
    return load(spark, d, "tracked_block").select("row_id", scripts.block_script(t).alias("b_script"), scripts.block_lang(t).alias("b_lang"), scripts.is_japanese_block(t).alias("japanese"), scripts.block_source_lang(F.col("lang"), F.col("script")).alias("source_lang"))


_solid = "length(replace(coalesce(text, ''), ' ', ''))"


@query(
    "SELECT row_id, " + ", ".join(f"CASE WHEN {_solid} > 0 THEN round({n('text', p)} / {_solid}, 6) ELSE 0.0 END AS {a}" for a, p in (("cjk", "[぀-ヿ一-鿿]"), ("cyr", "[Ѐ-ӿ]"), ("lat", "[A-Za-z]")))
    + f", ({letters('text')} >= 2 AND {share('text', 'cyrl')} >= 0.72) AS mostly_russian FROM tracked_block"
)
def character_ratios(spark: SparkSession, d: str) -> DataFrame:
    """LNG13, LNG17-LNG21: shares among all characters but blanks."""
    t = F.col("text")
    cols = [F.round(scripts.ratio(t, p), 6).alias(a) for a, p in (("cjk", "[぀-ヿ一-鿿]"), ("cyr", "[Ѐ-ӿ]"), ("lat", "[A-Za-z]"))]
    return load(spark, d, "tracked_block").select("row_id", *cols, scripts.is_mostly(t, "cyrl", least_letters=2).alias("mostly_russian"))


# Text forms ----------------------------------------------------------------------------------


@query(
    rf"""SELECT memory_id, md5({compare('source_text')}) AS compared, md5({collapsed('source_text')}) AS collapsed,
      md5(trim(regexp_replace(regexp_replace({fold('source_text')}, '[^\p{{L}}\p{{M}}\p{{N}}_\s\x{{3000}}]', '', 'g'), '{_SPACE}', ' ', 'g'))) AS echo,
      md5(array_to_string(regexp_extract_all(lower(coalesce(source_text, '')), '[\p{{L}}\p{{N}}_'']+'), ' ')) AS words FROM memory"""
)
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """STR4-STR7, STR9: comparison forms of the memory's sources, as digests."""
    t = F.col("source_text")
    return load(spark, d, "memory").select("memory_id", F.md5(text.compare_form(t)).alias("compared"), F.md5(text.collapsed_form(t)).alias("collapsed"), F.md5(text.echo_form(t)).alias("echo"), F.md5(text.words_form(t)).alias("words"))


_pairs = "|".join(text.IMPOSSIBLE_PAIRS)


@query(
    rf"""SELECT entry_id, len(list_distinct({toks('source_text')}))::INT AS distinct_tokens, greatest(1, {n('source_text', '[^ \t\n\r\f\x0b]+')})::INT AS blank_tokens,
      md5(array_to_string(list_sort(string_split(regexp_replace(coalesce(source_text, ''), '{_SPACE}', '', 'g'), '')), '')) AS bag,
      md5(regexp_replace(coalesce(source_text, ''), '[\p{{L}}\p{{M}}\p{{N}}_\s\x{{3000}}]+', '', 'g')) AS marks,
      len(list_filter(list_transform(range(1, length(regexp_replace(lower(coalesce(source_text, '')), '[^a-z]', '', 'g'))), lambda i: substring(regexp_replace(lower(coalesce(source_text, '')), '[^a-z]', '', 'g'), i::INT, 2)), lambda p: regexp_matches(p, '^({_pairs})$')))::INT AS bad_pairs
    FROM translations"""
)
def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    """STR21, STR23-STR25, STR27, STR33: token counts, character bags and mark skeletons of the translations' sources."""
    t = F.col("source_text")
    return load(spark, d, "translations").select("entry_id", F.size(text.token_set(t)).alias("distinct_tokens"), text.blank_tokens(t).alias("blank_tokens"), F.md5(text.character_bag(t)).alias("bag"), F.md5(text.mark_skeleton(t)).alias("marks"), text.impossible_pairs(t).alias("bad_pairs"))


@query(
    rf"""SELECT entry_id, concat_ws(chr(31), coalesce(source_lang, ''), coalesce(target_lang, ''), {strip('source_text')}) AS made,
      CASE WHEN len(string_split(cache_key, chr(31))) >= 3 THEN string_split(cache_key, chr(31))[1] ELSE '' END AS part_source,
      CASE WHEN len(string_split(cache_key, chr(31))) >= 3 THEN string_split(cache_key, chr(31))[2] ELSE '' END AS part_target,
      substring(sha256(cache_key), 1, 16) AS digest FROM translations"""
)
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """STR28, STR29, STR31: keys made, split and digested."""
    parts = text.split_cache_key(F.col("cache_key"))
    return load(spark, d, "translations").select("entry_id", text.cache_key(F.col("source_lang"), F.col("target_lang"), F.col("source_text")).alias("made"), parts["source"].alias("part_source"), parts["target"].alias("part_target"), text.digest(F.col("cache_key")).alias("digest"))


@query(
    """SELECT pack, substring(sha256(string_agg(line, chr(10) ORDER BY line)), 1, 16) AS version FROM (
      SELECT DISTINCT pack, source || chr(9) || coalesce(target, '') AS line FROM terms WHERE source IS NOT NULL) GROUP BY pack"""
)
def glossary_versions(spark: SparkSession, d: str) -> DataFrame:
    """STR30: fingerprint of each pack's sorted entries. The digest needs a pack's entries in order and in one place; packs are dictionaries that people write, not corpora."""
    lines = load(spark, d, "terms").where("source IS NOT NULL").select("pack", F.concat("source", F.lit("\t"), F.coalesce("target", F.lit(""))).alias("line")).distinct()
    return lines.groupBy("pack").agg(text.digest(F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("version"))


@query(
    r"""SELECT entry_id, CASE WHEN length(line) > 80 THEN substring(line, 1, 79) || '…' ELSE line END AS line, CASE WHEN lower(coalesce(source_lang, '')) IN ('zh', 'zh-cn', 'zh-hans') THEN 'zh-Hans' ELSE coalesce(source_lang, '') END AS azure,
      upper(string_split(coalesce(source_lang, ''), '-')[1]) AS deepl FROM (SELECT *, trim(regexp_replace(coalesce(source_text, ''), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS line FROM translations)"""
)
def brief_lines(spark: SparkSession, d: str) -> DataFrame:
    """STR32, STR35, STR36: one-line summaries and provider codes."""
    lang = F.col("source_lang")
    return load(spark, d, "translations").select("entry_id", text.brief(F.col("source_text")).alias("line"), text.provider_language("azure", lang, False).alias("azure"), text.provider_language("deepl", lang, False).alias("deepl"))


@query(
    r"""WITH x AS (SELECT entry_id, source_text AS s, translated_text AS o, regexp_extract(coalesce(source_text, ''), '^\s*([.!?…~*\-—–「」『』（）()\[\]{}]+)', 1) AS sl, regexp_extract(coalesce(source_text, ''), '([.!?…~*\-—–「」『』（）()\[\]{}]+)$', 1) AS st,
        regexp_extract(coalesce(translated_text, ''), '^\s*([.!?…~*\-—–「」『』（）()\[\]{}]+)', 1) AS ol FROM translations),
      y AS (SELECT *, CASE WHEN sl <> '' AND ol = '' THEN sl || regexp_replace(o, '^@@', '') ELSE o END AS one FROM x)
      SELECT entry_id, CASE WHEN coalesce(s, '') = '' OR coalesce(o, '') = '' THEN o WHEN st <> '' AND regexp_extract(coalesce(one, ''), '([.!?…~*\-—–「」『』（）()\[\]{}]+)$', 1) = '' THEN regexp_replace(one, '@@$', '') || st ELSE one END AS carried FROM y""".replace("@@", _SPACE)
)
def edge_marks(spark: SparkSession, d: str) -> DataFrame:
    """PH9: the source's edge punctuation carried over to the translation."""
    return load(spark, d, "translations").select("entry_id", text.carry_edge_marks(F.col("source_text"), F.col("translated_text")).alias("carried"))


# Gates ---------------------------------------------------------------------------------------

_w = "regexp_extract_all(coalesce(line, ''), '[A-Za-zА-яЁё]{2,}')"
_spelled = f"len(list_filter({_w}, lambda w: length(w) >= 3 AND regexp_matches(w, '[aeiouAEIOUаеёиоуыэюяАЕЁИОУЫЭЮЯ]')))"
_abbrev = f"len(list_filter({_w}, lambda w: length(w) <= 3 AND w = upper(w)))"
_digits, _compact = n("line", "[0-9]"), r"length(regexp_replace(coalesce(line, ''), '[ \t\n\r\f\x0b]+', '', 'g'))"


@query(
    rf"""SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN spam THEN 1 ELSE 0 END)::BIGINT AS spam FROM (SELECT doc_id,
      {when((f"{_digits} < 3 OR {_digits} < 0.18 * greatest({_compact}, 1)", "false"), (r"regexp_matches(trim(coalesce(line, '')), '^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$')", "false"), (f"len({_w}) = 0", "true"),
            (f"{_spelled} >= 2 OR ({_spelled} >= 1 AND {_abbrev} >= 1) OR {_abbrev} >= 2", "false"), (f"{_spelled} + {_abbrev} >= 1 AND {_digits} < 8", "false"), other=f"len({_w}) < 2")} AS spam
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)) GROUP BY 1"""
)
def digit_spam_lines(spark: SparkSession, d: str) -> DataFrame:
    """FLT3: digit blobs among the documents' lines."""
    lines = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(gates.digit_spam(F.col("line"))).alias("spam"))


_SYL = r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}]"
_V = "aeiouyаеёиоуыэюя"


def gibberish_sql(col: str) -> str:
    t = toks(col)
    noise = rf"CASE WHEN regexp_matches(w, '{_SYL}') OR regexp_matches(w, '\p{{N}}') THEN 0 WHEN NOT regexp_matches(w, '[{_V}]') OR len(list_distinct(string_split(w, ''))) <= greatest(1, length(w) // 3) THEN length(w) ELSE 0 END"
    total = rf"list_sum(list_transform({t}, lambda w: len(regexp_extract_all(w, '\p{{L}}'))))"
    return f"CASE WHEN len({t}) = 0 THEN 1.0 WHEN {total} = 0 THEN 0.0 ELSE list_sum(list_transform({t}, lambda w: {noise})) / {total} END"


def crowded_sql(t: str) -> str:
    return f"len(list_filter({t}, lambda w: length(w) >= 5 AND NOT regexp_matches(w, '{_SYL}') AND regexp_matches(w, '[^{_V}]{{4,}}')))"


@query(f"SELECT entry_id, round({gibberish_sql('translated_text')}, 6) AS score, {crowded_sql(toks('translated_text'))}::INT AS crowded FROM translations")
def gibberish_scores(spark: SparkSession, d: str) -> DataFrame:
    """FLT11, FLT15: noise score and consonant-crowded tokens of the translations."""
    t = F.col("translated_text")
    crowded = F.size(F.filter(text.tokens(t), lambda w: (F.length(w) >= 5) & gates.crowded(w)))
    return load(spark, d, "translations").select("entry_id", F.round(gates.gibberish(t), 6).alias("score"), crowded.alias("crowded"))


_s, _o = "source_text", "translated_text"
_leaves = rf"(len({toks(_s)}) >= 3 AND len({toks(_o)}) > 0 AND regexp_matches(coalesce({_o}, ''), '[Ѐ-ӿ぀-ヿ一-鿿]') AND regexp_matches(coalesce({_s}, ''), '[A-Za-z]') AND len(list_filter({toks(_s)}, lambda w: list_contains({toks(_o)}, w))) * 5 >= len({toks(_s)}) * 4)"
_alien = f"(len({toks(_o)}) > 6 AND len({toks(_s)}) >= 2 AND NOT list_has_any({toks(_s)}, {toks(_o)}) AND length(coalesce({_o}, '')) > 3 * greatest(4, length(coalesce({_s}, ''))))"
_longs = f"len(list_filter({toks(_o)}, lambda w: length(w) >= 5))"
_reads = when(
    (f"{strip(_o)} = ''", "false"), (f"len({toks(_o)}) = 0", rf"NOT regexp_matches(coalesce({_s}, ''), '\p{{L}}')"), (rf"NOT regexp_matches(coalesce({_s}, ''), '\p{{L}}')", "true"), (f"{gibberish_sql(_o)} > 0.34", "false"), (_leaves, "false"),
    (f"contains(coalesce({_o}, ''), 'PATH0')", "false"), (_alien, "false"), other=f"NOT ({_longs} > 0 AND {crowded_sql(toks(_o))} * 2 >= {_longs})",
)
_bare = lambda c: rf"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
_said = "regexp_matches(lower(coalesce(translated_text, '')), '" + "|".join(gates.FAILURES) + "')"
_stops = lambda c, p: f"len(regexp_extract_all({strip(c)}, '{p}'))"


@query(
    rf"""SELECT entry_id, CASE WHEN {strip(_o)} = '' THEN true WHEN ({_bare(_s)} <> '' AND {_bare(_s)} = {_bare(_o)} AND regexp_matches(coalesce({_s}, ''), '\p{{L}}')) OR {_said} THEN true ELSE NOT ({_reads}) END AS error,
      {_leaves} AS untranslated,
      (length({strip(_s)}) >= 60 AND {strip(_o)} <> '' AND (({_stops(_s, '[.!?…]+')} >= 2 AND {_stops(_o, '[.!?…。]+')} < {_stops(_s, '[.!?…]+')}) OR length({strip(_o)}) < greatest(24, floor(length({strip(_s)}) * 0.42)))) AS dropped_tail
      FROM translations"""
)
def translation_gates(spark: SparkSession, d: str) -> DataFrame:
    """FLT10, FLT12-FLT14: quality gates over source and translation."""
    s, o = F.col("source_text"), F.col("translated_text")
    words = load(spark, d, "translations").select("entry_id", "source_text", "translated_text", text.tokens(s).alias("src"), text.tokens(o).alias("out"))
    src, out = F.col("src"), F.col("out")
    return words.select("entry_id", gates.is_error_response(s, o, src, out).alias("error"), gates.leaves_source(s, o, src, out).alias("untranslated"), gates.dropped_tail(s, o).alias("dropped_tail"))


_t = r"trim(regexp_replace(string_split(coalesce(text, ''), chr(10))[-1], '[ \t\n\r\f\x0b]+', ' ', 'g'))"
_dangling = gates.DANGLING.replace("'", "''")


@query(
    f"""SELECT engine, count(*) AS n, sum(CASE WHEN broken THEN 1 ELSE 0 END)::BIGINT AS incomplete FROM (SELECT engine, {when((f"length({_t}) < 12", "true"), (f"regexp_matches({_t}, '[.!?…」』»\"]$')", "false"),
      (f"regexp_matches({_t}, '[぀-ヿ㐀-鿿豈-﫿가-힯]')", f"regexp_matches({_t}, '[はがをにでとものねよ]$') OR (length({_t}) < 18 AND NOT regexp_matches({_t}, '[。！？]$'))"),
      (f"regexp_matches(lower({_t}), '(^|[^a-z0-9_])({_dangling})$')", "true"), (f"length({_t}) >= 48 AND (regexp_matches({_t}, '[A-Za-z]{{8,}}$') OR regexp_matches({_t}, '(,|—|-)$'))", "true"), other="false")} AS broken FROM tracked_block) GROUP BY 1"""
)
def incomplete_lines(spark: SparkSession, d: str) -> DataFrame:
    """FLT18: spoken lines that break off, by engine."""
    return load(spark, d, "tracked_block").groupBy("engine").agg(F.count("*").alias("n"), F.count_if(gates.looks_incomplete(F.col("text"))).alias("incomplete"))


_pw = r"regexp_extract_all(coalesce(line, ''), '[^ \t\n\r\f\x0b]+')"
_nm = r"regexp_extract(trim(coalesce(line, '')), '^([A-Za-z][A-Za-z0-9 .''\-]{0,28}):\s+\S.{3,}', 1)"
_up = r"upper(trim(regexp_replace(coalesce(line, ''), '[ \t\n\r\f\x0b]+', ' ', 'g')))"


@query(
    rf"""SELECT doc_id, sum(CASE WHEN {_nm} <> '' AND length(trim(coalesce(line, ''))) >= 8 AND length(trim({_nm})) BETWEEN 2 AND 24 AND lower(trim({_nm})) NOT IN ({", ".join(f"'{w}'" for w in gates.NO_NAMES)}) AND NOT regexp_matches(trim({_nm}), '^\d+$')
        AND NOT (len(list_filter(regexp_split_to_array(trim({_nm}), '\s+'), lambda w: w <> '')) >= 2 AND len(list_filter(regexp_split_to_array(trim({_nm}), '\s+'), lambda w: length(w) > 9)) > 0) THEN 1 ELSE 0 END)::BIGINT AS spoken,
      sum(CASE WHEN len({_pw}) >= 7 AND len(list_filter({_pw}[1:2], lambda w: regexp_matches(w, '^\p{{Lu}}'))) = 0 AND len(list_filter({_pw}[3:], lambda w: regexp_matches(w, '^\p{{Lu}}'))) <= greatest(1, len({_pw}) // 4) THEN 1 ELSE 0 END)::BIGINT AS prose,
      sum(CASE WHEN regexp_matches({_up}, '^(BARNING|DARNING|WARNI|ARNING|SYSTEM)$') OR regexp_matches({_up}, '^W?A?RNINGS?$') OR (contains({_up}, 'WARNING') AND length({_up}) <= 18) OR regexp_matches({_up}, 'PROGRAM\s*CONTROL|SYSTEM\s*ANNOUNCE|CONTROL:\s*0') THEN 1 ELSE 0 END)::BIGINT AS hud_spam,
      sum(CASE WHEN {n('line', '[A-Za-z]')} >= 2 AND {n('line', '[ぁ-ゖァ-ヺー一-鿿]')} = 0 THEN 1 ELSE 0 END)::BIGINT AS latin
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1"""
)
def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    """FLT17, FLT19-FLT21, FLT23: spoken lines, prose, banners and Latin labels of each document."""
    x = F.col("line")
    lines = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(gates.is_spoken_line(x)).alias("spoken"), F.count_if(gates.reads_as_prose(x)).alias("prose"), F.count_if(gates.is_hud_spam(x)).alias("hud_spam"), F.count_if(gates.is_latin_label(x)).alias("latin"))


@query(
    r"""SELECT entry_id, pos, CASE WHEN regexp_matches(t, '^\d+\s*/\s*\d+$') THEN regexp_replace(t, '\s+', '', 'g') WHEN regexp_matches(t, '^\d+([.,]\d+)?\s*%$') THEN regexp_replace(t, '\s+', '', 'g')
      WHEN regexp_matches(t, '(?i)^lv\.?\s*(\d+)$') THEN 'Level ' || regexp_extract(t, '(?i)^lv\.?\s*(\d+)$', 1) END AS guarded
      FROM (SELECT entry_id, unnest(string_split(coalesce(source_text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(source_text, ''), chr(10)), 1) - 1 AS pos, trim(x) AS t FROM translations)"""
)
def number_shapes(spark: SparkSession, d: str) -> DataFrame:
    """JN4: number shapes in every line of each source."""
    lines = load(spark, d, "translations").select("entry_id", F.posexplode(F.split(F.coalesce("source_text", F.lit("")), "\n")).alias("pos", "line"))
    return lines.select("entry_id", "pos", gates.numeric_guard(F.col("line"), F.lit("Level")).alias("guarded"))


# Dictionaries --------------------------------------------------------------------------------

RULES = [
    lexicon.Rule(r"^(.+) (\d+)$", "$1 №$2", "global", 10),
    lexicon.Rule(r"(?i)lv\.? ?(\d+)", "Level $1", "global", 40),
    lexicon.Rule(r"^([A-Z][a-z]+) Map (\d+)$", "Map of $1 ($2)", "user", 5),
    lexicon.Rule(r"^(.+)の(.+)$", "$2: $1", "game", 50, "core"),
]
_DISTINCT_TERMS = """(SELECT * FROM (SELECT ordinal, source, target, coalesce(scope, 'global') AS scope, coalesce(priority, 0) AS priority, flags, pack,
      row_number() OVER (PARTITION BY source, coalesce(scope, 'global'), pack, array_to_string(list_sort(list_distinct(coalesce(flags, []))), ',') ORDER BY ordinal) AS k FROM terms) WHERE k = 1)"""
_ADMITTED = "(scope IN ('user', 'global', 'profile') OR (scope = 'game' AND pack = 'core'))"
_WINNERS = f"""(SELECT source, target, pack FROM (SELECT source, target, pack, row_number() OVER (PARTITION BY source ORDER BY CASE scope WHEN 'user' THEN 4 WHEN 'profile' THEN 3 WHEN 'game' THEN 2 WHEN 'global' THEN 1 ELSE 0 END DESC, priority DESC, ordinal) AS w
      FROM {_DISTINCT_TERMS} WHERE coalesce(target, '') <> '' AND target <> source AND {_ADMITTED}) WHERE w = 1)"""


@query(f"SELECT ordinal, source, scope, priority, pack FROM {_DISTINCT_TERMS}")
def loaded_terms(spark: SparkSession, d: str) -> DataFrame:
    """SRC3, SNK2: the terms of all packs, distinct, the first of equal ones."""
    return lexicon.distinct_terms(load(spark, d, "terms")).select("ordinal", "source", "scope", "priority", "pack")


@query(f"SELECT t.row_id, w.target, w.pack FROM tracked_block t LEFT JOIN {_WINNERS} w ON t.text = w.source")
def term_look_up(spark: SparkSession, d: str) -> DataFrame:
    """JN1, FLT43: the winning term of every block, in the game ``core``."""
    terms = lexicon.distinct_terms(load(spark, d, "terms"))
    return lexicon.look_up(load(spark, d, "tracked_block").select("row_id", "text"), "text", terms, "core", True).select("row_id", "target", "pack")


_T = "trim(coalesce(text, ''))"
_RULED = (
    rf"CASE WHEN regexp_matches({_T}, '^([A-Z][a-z]+) Map (\d+)$') AND NOT (regexp_matches({_T}, '[぀-ヿ㐀-鿿豈-﫿]') AND NOT regexp_matches({_T}, '[A-Za-z]')) THEN regexp_replace({_T}, '^([A-Z][a-z]+) Map (\d+)$', 'Map of \1 (\2)')"
    rf" WHEN regexp_matches({_T}, '^(.+)の(.+)$') AND NOT (regexp_matches({_T}, '[A-Za-z]') AND NOT regexp_matches({_T}, '[぀-ヿ㐀-鿿豈-﫿]')) THEN regexp_replace({_T}, '^(.+)の(.+)$', '\2: \1')"
    rf" WHEN regexp_matches({_T}, '(?i)lv\.? ?(\d+)') AND NOT (regexp_matches({_T}, '[぀-ヿ㐀-鿿豈-﫿]') AND NOT regexp_matches({_T}, '[A-Za-z]')) AND regexp_replace({_T}, '(?i)lv\.? ?(\d+)', 'Level \1') <> {_T} THEN regexp_replace({_T}, '(?i)lv\.? ?(\d+)', 'Level \1')"
    rf" WHEN regexp_matches({_T}, '^(.+) (\d+)$') THEN regexp_replace({_T}, '^(.+) (\d+)$', '\1 №\2') END"
)


@query(f"SELECT row_id, {_RULED} AS rewritten FROM tracked_block")
def rule_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """JN2, FLT42: the first rule that changes a block's text, one substitution."""
    return load(spark, d, "tracked_block").select("row_id", lexicon.rewrite(F.col("text"), RULES, "core", True).alias("rewritten"))


_USER = "(SELECT source_text AS source, min(translated_text) AS target FROM memory WHERE memory_id % 50 = 0 AND coalesce(translated_text, '') <> '' GROUP BY 1)"


@query(
    rf"""SELECT b.row_id, CASE WHEN u.target IS NOT NULL THEN 'user' WHEN w.target IS NOT NULL THEN 'lexicon' WHEN {_RULED.replace('text', 'b.text')} IS NOT NULL THEN 'rule' WHEN k.target IS NOT NULL THEN 'term_number'
        WHEN regexp_matches(trim(coalesce(b.text, '')), '^\d+\s*/\s*\d+$|^\d+([.,]\d+)?\s*%$|(?i)^lv\.?\s*(\d+)$') THEN 'number' END AS step,
      coalesce(u.target, w.target, {_RULED.replace('text', 'b.text')}) AS resolved
    FROM tracked_block b LEFT JOIN {_USER} u ON b.text = u.source LEFT JOIN {_WINNERS} w ON b.text = w.source LEFT JOIN {_WINNERS} k ON regexp_extract(coalesce(b.text, ''), '^(.+?)\s+(\d[\d.,/:]*)$', 1) = k.source"""
)
def resolution_chain(spark: SparkSession, d: str) -> DataFrame:
    """JN3-JN5: user map, lexicon, rules, known term with number, number shapes. The user map is every fiftieth memory row, as its SQL says; ``resolution_chain_all`` takes all."""
    return _chain(spark, d, load(spark, d, "memory").where("memory_id % 50 = 0"))


@query(_SQL["resolution_chain"].replace("memory_id % 50 = 0 AND ", ""))
def resolution_chain_all(spark: SparkSession, d: str) -> DataFrame:
    """JN3-JN5: ``resolution_chain`` with the whole memory as user map."""
    return _chain(spark, d, load(spark, d, "memory"))


def _chain(spark: SparkSession, d: str, memory: DataFrame) -> DataFrame:
    user = memory.select(F.col("source_text").alias("source"), F.col("translated_text").alias("target"))
    terms = lexicon.distinct_terms(load(spark, d, "terms"))
    done = lexicon.cascade(load(spark, d, "tracked_block").select("row_id", "text"), "text", user, terms, RULES, "Level", "core", True)
    return done.select("row_id", "step", F.when(F.col("step").isin("user", "lexicon", "rule"), F.col("resolved")).alias("resolved"))


@query("SELECT flag, count(DISTINCT surface) AS surfaces FROM (SELECT unnest(flags) AS flag, source AS surface FROM terms) WHERE surface <> '' GROUP BY 1")
def flag_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """AGG10: size of the vocabulary of each flag."""
    return lexicon.term_groups(load(spark, d, "terms")).groupBy("flag").agg(F.count("*").alias("surfaces"))


# Stores --------------------------------------------------------------------------------------


@query(
    f"""SELECT source_lang, target_lang, s AS source_text, arg_max(o, (created_at, entry_id)) AS translated_text, arg_max(backend_id, (created_at, entry_id)) AS backend_id, epoch_us(min(created_at)) AS created_us, epoch_us(max(created_at)) AS last_used_us, count(*) AS use_count
    FROM (SELECT *, {strip('source_text')} AS s, {strip('translated_text')} AS o FROM translations) WHERE s <> '' AND o <> '' AND s <> o GROUP BY 1, 2, 3"""
)
def memory_upsert(spark: SparkSession, d: str) -> DataFrame:
    """UPS1, UPS5: the memory that results from remembering every translation in time order."""
    kept = stores.remember(load(spark, d, "translations"), ["source_lang", "target_lang", "source_text"], ["created_at", "entry_id"])
    return kept.withColumns({"created_us": F.unix_micros("created_at"), "last_used_us": F.unix_micros("last_used_at")}).drop("created_at", "last_used_at")


@query(
    """SELECT t.entry_id, m.translated_text AS remembered FROM translations t LEFT JOIN (SELECT source_lang, target_lang, source_text, arg_max(translated_text, (last_used_at, memory_id)) FILTER (translated_text IS NOT NULL) AS translated_text FROM memory GROUP BY 1, 2, 3) m
      ON t.source_lang = m.source_lang AND t.target_lang = m.target_lang AND t.source_text = m.source_text"""
)
def memory_look_up(spark: SparkSession, d: str) -> DataFrame:
    """JN7: remembered translation of each cache row, by language pair and source."""
    keys = ["source_lang", "target_lang", "source_text"]
    known = load(spark, d, "memory").where("translated_text IS NOT NULL").groupBy(*keys).agg(F.max_by("translated_text", F.struct("last_used_at", "memory_id")).alias("translated_text"))
    return stores.look_up(load(spark, d, "translations").select("entry_id", *keys), known, keys).select("entry_id", "remembered")


@query("SELECT memory_id, source_lang, use_count FROM memory WHERE target_lang = 'ru' ORDER BY last_used_at DESC NULLS LAST, memory_id LIMIT 50")
def recent_memory(spark: SparkSession, d: str) -> DataFrame:
    """TOP2: the fifty most recently used rows for one target language."""
    return stores.recent(load(spark, d, "memory"), "ru").select("memory_id", "source_lang", "use_count")


@query("SELECT backend_id, count(*) AS n_rows, count(DISTINCT cache_key) AS n_keys FROM translations WHERE cache_key IS NOT NULL AND (coalesce(glossary_version, '') = '' OR glossary_version = (SELECT max(glossary_version) FROM translations)) GROUP BY 1")
def versioned_cache(spark: SparkSession, d: str) -> DataFrame:
    """JN6: cache rows that the newest glossary version may use, by backend."""
    t = load(spark, d, "translations")
    version = t.agg(F.max("glossary_version")).first()[0]
    return stores.versioned_hits(t, version).groupBy("backend_id").agg(F.count("*").alias("n_rows"), F.countDistinct("cache_key").alias("n_keys"))


@query("SELECT entry_id, backend_id FROM (SELECT entry_id, backend_id, row_number() OVER (PARTITION BY backend_id ORDER BY last_used_at DESC NULLS LAST, entry_id) AS k FROM translations) WHERE k <= 200")
def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    """TOP4, SNK3: the 200 most recently used rows that each backend's cache keeps."""
    kept = stores.evict(load(spark, d, "translations").select("entry_id", "backend_id", "last_used_at"), 200, ["backend_id"], [F.desc_nulls_last("last_used_at"), F.col("entry_id")])
    return kept.select("entry_id", "backend_id")


@query(
    """WITH gone AS (SELECT DISTINCT cache_key FROM translations WHERE coalesce(translated_text, '') = '' AND cache_key IS NOT NULL)
    SELECT entry_id FROM translations t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.cache_key = t.cache_key)"""
)
def forgotten_keys(spark: SparkSession, d: str) -> DataFrame:
    """UPS2, UPS3: the cache without the keys that ever had an empty answer."""
    t = load(spark, d, "translations")
    return stores.forget(t, t.where("coalesce(translated_text, '') = ''"), ["cache_key"]).select("entry_id")


@query(
    """SELECT coalesce(p.source, r.source) AS source, coalesce(r.target, p.target) AS target FROM (SELECT source, min(target) AS target FROM terms WHERE scope = 'user' AND source IS NOT NULL GROUP BY 1) p
    FULL JOIN (SELECT source_text AS source, max(translated_text) AS target FROM memory WHERE use_count >= 5 AND translated_text IS NOT NULL GROUP BY 1) r ON p.source = r.source"""
)
def promoted_pack(spark: SparkSession, d: str) -> DataFrame:
    """SNK5: the user's pack with often used memory rows merged in."""
    pack = load(spark, d, "terms").where("scope = 'user' AND source IS NOT NULL").groupBy("source").agg(F.min("target").alias("target"))
    rows = load(spark, d, "memory").where("use_count >= 5 AND translated_text IS NOT NULL").select(F.col("source_text").alias("source"), F.col("translated_text").alias("target"))
    return stores.promote(pack, rows)


# Requests ------------------------------------------------------------------------------------


@query(
    "SELECT source_text AS text, coalesce(source_lang, '') AS lang, min(entry_id) AS ordinal, count(*) AS copies FROM translations WHERE trim(coalesce(source_text, '')) <> '' GROUP BY 1, 2"
)
def request_texts(spark: SparkSession, d: str) -> DataFrame:
    """TOP6: each request (text and language) once, at its first place."""
    return batching.distinct_requests(load(spark, d, "translations"), "source_text", "source_lang", "entry_id")


@query()
def request_batches(spark: SparkSession, d: str) -> DataFrame:
    """TOP3: requests of each call of 28, packed into batches of at most 8 rows and 512 tokens."""
    rows = load(spark, d, "translations").select("entry_id", ((F.col("entry_id") - 1) / batching.CALL_CAP).cast("long").alias("call"), "source_text")
    return batching.pack_batches(rows, ["call"], "entry_id", "source_text").select("entry_id", "call", "batch")


@query(
    r"""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN conf >= 0.8 THEN 0 ELSE 1 END, len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')) DESC, length(trim(text)) DESC, box.y1, box.x1, row_id) AS k FROM tracked_block) WHERE k <= 120"""
)
def screen_lines(spark: SparkSession, d: str) -> DataFrame:
    """TOP1: the 120 most useful lines of each session."""
    return batching.cap_lines(load(spark, d, "tracked_block").select("row_id", "session_id", "text", "conf", "box"), ["session_id"]).select("row_id")


@query(
    """SELECT line, count(*) AS copies, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, """ + collapsed("line") + """ AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)) WHERE line <> '' GROUP BY 1 HAVING count(*) > 1"""
)
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """STR6, DED: lines that occur more than once, by collapsed form."""
    lines = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", text.collapsed_form(F.col("line")).alias("line"))
    return lines.where("line <> ''").groupBy("line").agg(F.count("*").alias("copies"), F.countDistinct("doc_id").alias("n_docs")).where("copies > 1")


# Blocks across frames ------------------------------------------------------------------------

_VERSIONS = "(SELECT *, lag(text) OVER w AS pt, lag(norm) OVER w AS pn, lag(script) OVER w AS ps, lag(box) OVER w AS pb, lag(row_id) OVER w AS pr FROM tracked_block WINDOW w AS (PARTITION BY session_id, id ORDER BY content_revision, received_at, row_id))"
_lf = lambda c: rf"regexp_replace({fold(c)}, '[\s\x{{3000}}.,!?''\"—–-]', '', 'g')"
_least = f"greatest(12, floor(least(length({_lf('pt')}), length({_lf('text')})) * 0.45)::INT)"
_x, _y = f"list_distinct({toks('pt')})", f"list_distinct({toks('text')})"
_means = r"(length(w) > 1 OR regexp_matches(w, '^\p{N}$') OR w IN ('a', 'i'))"
_ox, _oy = (f"list_filter({a}, lambda w: NOT list_contains({b}, w) AND {_means})" for a, b in ((_x, _y), (_y, _x)))
_odd = f"(len({_ox}) + len({_oy}))"


@query(
    rf"""SELECT row_id, {when((f"len({_x}) = 0 AND len({_y}) = 0", "false"), (f"len({_x}) = 0 OR len({_y}) = 0", "true"), (f"{_odd} = 0", "false"), other=f"NOT (len(list_intersect({_x}, {_y})) >= 5 AND {_odd} = 1 AND length(coalesce(list_concat({_ox}, {_oy})[1], '')) <= 5)")} AS word_change,
      ({_lf('pt')} <> '' AND {_lf('text')} <> '' AND length({_lf('pt')}) >= {_least} AND length({_lf('text')}) >= {_least} AND substring({_lf('pt')}, 1, {_least}) = substring({_lf('text')}, 1, {_least})) AS same_start,
      (length({compare('pt')}) >= 4 AND length({compare('text')}) > length({compare('pt')}) AND contains({compare('text')}, {compare('pt')})) AS grew FROM {_VERSIONS} WHERE pr IS NOT NULL"""
)
def version_changes(spark: SparkSession, d: str) -> DataFrame:
    """SIM3, DED3, DED8, STR8: each block version against the one before it."""
    v = tracking.versions(load(spark, d, "tracked_block")).where("prev_row_id IS NOT NULL")
    a, b = F.col("prev_text"), F.col("text")
    return v.select("row_id", tracking.word_change(a, b).alias("word_change"), tracking.shares_start(a, b).alias("same_start"), tracking.is_fragment(a, b).alias("grew"))


@query()
def version_likeness(spark: SparkSession, d: str) -> DataFrame:
    """SIM1, SIM2, SIM4, SIM5, STM15: sequence likeness of consecutive versions and whether the content changed."""
    v = tracking.versions(load(spark, d, "tracked_block")).where("prev_row_id IS NOT NULL")
    a, b = F.col("prev_text"), F.col("text")
    v = v.withColumn("ratio", tracking.sequence_ratio(text.collapsed_form(a), text.collapsed_form(b))).withColumn("body_ratio", tracking.sequence_ratio(text.body_form(a), text.body_form(b)))
    alike = tracking.keys_alike(a, b, F.col("ratio"))
    return v.select("row_id", F.round("ratio", 6).alias("ratio"), alike.alias("alike"), (F.col("body_ratio") >= 0.9).alias("bodies_alike"), tracking.content_changed(a, F.col("prev_norm"), F.col("prev_script"), b, F.col("script"), F.col("conf"), alike).alias("changed"))


_NOW = "TIMESTAMP '2030-01-01 00:00:00'"
_life = "greatest(0.0, (epoch_us(last_seen) - epoch_us(coalesce(first_seen, last_seen))) / 1e6)"
_freq, _pos, _p = "(coalesce(change_count, 0) / greatest(1, coalesce(seen_passes, 0)))", "greatest(0.0, 1.0 - coalesce(position_drift, 0.0) / 80.0)", "coalesce(seen_passes, 0)"
_seen = f"greatest({_life}, {_p} * 0.25)"
_dyn = when((f"{_seen} >= 8.0 AND {_freq} <= 0.08 AND {_pos} >= 0.75", "'stable'"), (f"{_seen} <= 2.0 AND ({_freq} >= 0.4 OR {_p} <= 3)", "'transient'"), (f"{_freq} >= 0.55 OR ({_freq} >= 0.35 AND {_pos} < 0.5)", "'dynamic'"), (f"{_seen} >= 3.0 AND {_freq} <= 0.25", "'slow'"), (f"{_freq} >= 0.3", "'dynamic'"), (f"{_seen} < 2.0", "'transient'"), other="'slow'")
_kd = "lower(trim(coalesce(element_at(params, 'kind')[1], '')))"
_kind = when((f"{collapsed('text')} IN ('pick up', 'pickup') OR regexp_matches({collapsed('text')}, '^(obtained|acquired|picked up) ')", "'transient'"), (f"{_kd} IN ('dialogue', 'dialogue-line', 'body')", "'dialogue'"), (f"{_kd} = 'subtitle'", "'subtitle'"), (f"{_kd} IN ('transient', 'toast', 'popup')", "'transient'"), other="'hud'")
_grace = f"(CASE WHEN {_p} >= 4 THEN coalesce(CASE dyn WHEN 'transient' THEN 300 WHEN 'dynamic' THEN 500 WHEN 'stable' THEN 1000 END, CASE kind WHEN 'dialogue' THEN 500 WHEN 'subtitle' THEN 500 WHEN 'transient' THEN 300 ELSE 1000 END) ELSE CASE kind WHEN 'dialogue' THEN 500 WHEN 'subtitle' THEN 500 WHEN 'transient' THEN 300 ELSE 1000 END END)"


@query(
    f"""SELECT row_id, kind, dyn, {_grace} AS grace, (coalesce(missing_passes, 0) >= 2 AND (coalesce(missing_passes, 0) >= greatest(2, ceil({_grace} / 250)) OR coalesce((epoch_us(received_at) - epoch_us(missing_since)) / 1000.0 >= {_grace}, false))) AS due
    FROM (SELECT *, {_dyn} AS dyn, {_kind} AS kind FROM tracked_block)"""
)
def block_expiry(spark: SparkSession, d: str) -> DataFrame:
    """STM5-STM8, STM10, STM35-STM37: dynamics, grace and due removal of every block version, as of its arrival."""
    b = load(spark, d, "tracked_block")
    passes = F.col("seen_passes")
    life = tracking.lifespan(F.col("first_seen"), F.col("last_seen"), F.col("last_seen"))
    b = b.withColumn("dyn", tracking.dynamics(life, tracking.change_frequency(F.col("change_count"), passes), tracking.stability(F.col("position_drift")), passes))
    b = b.withColumn("kind", tracking.block_kind(F.try_element_at("params", F.lit("kind")), F.col("text")))
    b = b.withColumn("grace", tracking.grace_ms(F.col("kind"), F.col("dyn"), passes))
    return b.select("row_id", "kind", "dyn", "grace", tracking.removal_due(F.col("missing_passes"), F.col("missing_since"), F.col("grace"), F.col("received_at")).alias("due"))


@query(
    """SELECT r.result_id, b.cur AS current_revision, (b.cur IS NULL OR r.content_revision = b.cur) AS accepted FROM result_identity r
    LEFT JOIN (SELECT session_id, id, max(content_revision) AS cur FROM tracked_block GROUP BY 1, 2) b ON r.session_id = b.session_id AND r.block_id = b.id"""
)
def admitted_results(spark: SparkSession, d: str) -> DataFrame:
    """STM28-STM30: results whose block has moved on are late."""
    return tracking.admit_results(load(spark, d, "result_identity"), load(spark, d, "tracked_block")).select("result_id", "current_revision", "accepted")


@query("SELECT session_id, arg_max(row_id, (content_revision, received_at, row_id)) AS row_id, max(content_revision) AS content_revision FROM tracked_block GROUP BY session_id, id")
def latest_blocks(spark: SparkSession, d: str) -> DataFrame:
    """STM2: the latest version of each block wins."""
    b = load(spark, d, "tracked_block").select("session_id", "id", "row_id", "content_revision", "received_at")
    return tracking.latest(b, ["session_id", "id"], ["content_revision", "received_at", "row_id"]).select("session_id", "row_id", "content_revision")


_AREA = lambda b: f"greatest(1, ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1))"
_INTER = "(greatest(0, least(pb.x2, box.x2) - greatest(pb.x1, box.x1)) * greatest(0, least(pb.y2, box.y2) - greatest(pb.y1, box.y1)))"
_CD = "sqrt(power((pb.x1 + pb.x2 - box.x1 - box.x2) / 2.0, 2) + power((pb.y1 + pb.y2 - box.y1 - box.y2) / 2.0, 2))"
_IOU = f"(CASE WHEN {_INTER} > 0 THEN {_INTER} / ({_AREA('pb')} + {_AREA('box')} - {_INTER}) ELSE 0.0 END)"


@query(
    f"""SELECT row_id, round({_IOU}, 6) AS iou, round({_INTER} / least({_AREA('pb')}, {_AREA('box')}), 6) AS overlap, round(least({_AREA('pb')}, {_AREA('box')}) / greatest({_AREA('pb')}, {_AREA('box')}), 6) AS size_ratio,
      round({_CD} / greatest(8.0, (pb.x2 - pb.x1 + pb.y2 - pb.y1) / 2.0), 6) AS offset_ratio, (pb.x1 <= box.x2 AND box.x1 <= pb.x2 AND pb.y1 <= box.y2 AND box.y1 <= pb.y2) AS touching,
      ({_IOU} >= 0.15 OR {_CD} <= 2.5 * greatest(1.0, (greatest(1, pb.y2 - pb.y1) + greatest(1, box.y2 - box.y1)) / 2.0)) AS may_match FROM {_VERSIONS} WHERE pr IS NOT NULL"""
)
def box_relations(spark: SparkSession, d: str) -> DataFrame:
    """SIM6-SIM16, JN9: geometry between consecutive versions of a block."""
    v = tracking.versions(load(spark, d, "tracked_block")).where("prev_row_id IS NOT NULL")
    a, b = F.col("prev_box"), F.col("box")
    return v.select("row_id", F.round(boxes.iou(a, b), 6).alias("iou"), F.round(boxes.overlap_ratio(a, b), 6).alias("overlap"), F.round(boxes.size_ratio(a, b), 6).alias("size_ratio"), F.round(boxes.center_offset(a, b), 6).alias("offset_ratio"), boxes.overlaps(a, b).alias("touching"), boxes.may_be_same(a, b).alias("may_match"))


@query(
    """SELECT session_id, epoch_us(hour) AS hour_us, tracked, dirty, CASE WHEN tracked <= 0 THEN 'no_tracked' WHEN dirty > 8 THEN 'many_dirty' WHEN rate < 0.65 THEN 'low_match' WHEN since >= 5.0 THEN 'periodic' END AS reason FROM (
      SELECT session_id, date_trunc('hour', last_seen) AS hour, count(DISTINCT id) AS tracked, sum(CASE WHEN change_count > 0 THEN 1 ELSE 0 END)::BIGINT AS dirty, avg(CASE WHEN missing_passes > 0 THEN 0.0 ELSE 1.0 END) AS rate, (epoch_us(max(last_seen)) - epoch_us(min(last_seen))) / 1e6 AS since
      FROM tracked_block WHERE last_seen IS NOT NULL GROUP BY 1, 2)"""
)
def reread_reasons(spark: SparkSession, d: str) -> DataFrame:
    """STM13, AGG11: why each session hour must be read again as a whole."""
    b = load(spark, d, "tracked_block").where("last_seen IS NOT NULL")
    g = b.groupBy("session_id", F.date_trunc("hour", "last_seen").alias("hour")).agg(
        F.countDistinct("id").alias("tracked"), F.count_if(F.col("change_count") > 0).alias("dirty"), F.avg(F.when(F.col("missing_passes") > 0, 0.0).otherwise(1.0)).alias("rate"), ((F.unix_micros(F.max("last_seen")) - F.unix_micros(F.min("last_seen"))) / 1e6).alias("since")
    )
    return g.select("session_id", F.unix_micros("hour").alias("hour_us"), "tracked", "dirty", tracking.reread_reason(F.col("tracked"), F.lit(False), F.col("dirty"), F.col("rate"), F.col("since")).alias("reason"))


@query(
    """SELECT row_id, CASE WHEN c <= 0 OR (p >= 3.0 AND a >= 0.02 AND c <= 1 AND m < 30) OR (c = 1 AND (m > 500 OR m < 30)) OR (c > 15 AND m < 50) OR (a >= 0.08 AND e < 0.01 AND c <= 2) THEN 'motion'
      WHEN (c <= 10 AND m > 30 AND e >= 0.005) OR (c BETWEEN 2 AND 12 AND m > 25 AND t <= 12) THEN 'text' ELSE 'unknown' END AS class
    FROM (SELECT row_id, (box.x2 - box.x1) * (box.y2 - box.y1) / 2073600.0 AS a, change_count AS c, stable_passes AS t, (box.x2 - box.x1) * 1.0 AS m, coalesce(conf, 0.0) / 10 AS e, missing_passes * 1.0 AS p FROM tracked_block)"""
)
def change_classes(spark: SparkSession, d: str) -> DataFrame:
    """STM22: text or motion, from six features; block columns stand in for the features of a frame."""
    b = load(spark, d, "tracked_block")
    w, h = boxes.width(F.col("box")), boxes.height(F.col("box"))
    return b.select("row_id", tracking.change_class(w * h / 2073600.0, F.col("stable_passes"), F.col("change_count"), w * 1.0, F.coalesce("conf", F.lit(0.0)) / 10, F.col("missing_passes") * 1.0).alias("class"))


@query("SELECT row_id, row_number() OVER (PARTITION BY session_id, date_trunc('minute', last_seen) ORDER BY floor(box.y1 / 12), box.x1, row_id) ::INT AS place, floor(box.y1 / 12)::BIGINT AS band FROM tracked_block WHERE last_seen IS NOT NULL")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """WIN1, WIN2: bands of 12 pixels, then from left to right, in each minute of a session."""
    b = load(spark, d, "tracked_block").where("last_seen IS NOT NULL")
    frame = Window.partitionBy("session_id", F.date_trunc("minute", "last_seen")).orderBy(F.floor(F.col("box.y1") / 12), F.col("box.x1"), F.col("row_id"))
    return b.select("row_id", F.row_number().over(frame).alias("place"), F.floor(F.col("box.y1") / 12).alias("band"))


@query(
    """WITH x AS (SELECT session_id, date_trunc('minute', last_seen) AS minute, box, lead(box) OVER (PARTITION BY session_id, date_trunc('minute', last_seen) ORDER BY box.y1, box.x1, row_id) AS nb FROM tracked_block WHERE last_seen IS NOT NULL)
    SELECT session_id, epoch_us(minute) AS minute_us, count(*) AS n, min(box.y1) AS top, sum(CASE WHEN nb.y1 - box.y2 > 36 THEN 1 ELSE 0 END)::BIGINT AS big_gaps, sum(greatest(8, box.y2 - box.y1))::BIGINT AS ink,
      coalesce(quantile_cont(nb.y1 - box.y1, 0.5) FILTER (nb.y1 - box.y1 > 2), 0.0)::DOUBLE AS pitch FROM x GROUP BY session_id, minute"""
)
def row_pitch(spark: SparkSession, d: str) -> DataFrame:
    """AGG6, AGG12: gaps, ink and median row pitch of each minute of a session."""
    b = load(spark, d, "tracked_block").where("last_seen IS NOT NULL").withColumn("minute", F.date_trunc("minute", "last_seen"))
    x = b.withColumn("nb", F.lead("box").over(Window.partitionBy("session_id", "minute").orderBy("box.y1", "box.x1", "row_id")))
    step = F.col("nb.y1") - F.col("box.y1")
    return x.groupBy("session_id", "minute").agg(
        F.count("*").alias("n"), F.min("box.y1").alias("top"), F.count_if(F.col("nb.y1") - F.col("box.y2") > 36).alias("big_gaps"), F.sum(F.greatest(F.lit(8), boxes.height(F.col("box")))).alias("ink"), F.coalesce(F.percentile(F.when(step > 2, step), F.lit(0.5)), F.lit(0.0)).alias("pitch")
    ).withColumn("minute_us", F.unix_micros("minute")).drop("minute")


# Telemetry -----------------------------------------------------------------------------------


@query(
    """SELECT event_type AS name, count(*) AS n, round(sum(greatest(0.0, value)), 4) AS total_ms, max(greatest(0.0, value)) AS max_ms, arg_max(greatest(0.0, value), event_id) AS last_ms, round(quantile_cont(greatest(0.0, value), 0.5), 6) AS p50, round(quantile_cont(greatest(0.0, value), 0.95), 6) AS p95
    FROM events WHERE value IS NOT NULL GROUP BY 1"""
)
def timing_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """AGG1, AGG2: timings of the events by type."""
    t = telemetry.timings(load(spark, d, "events"), "event_type", "value", "event_id")
    return t.withColumns({c: F.round(c, k) for c, k in (("total_ms", 4), ("p50", 6), ("p95", 6))})


@query(
    """SELECT r.session_id, count(*) AS results, sum(CASE WHEN finished_at IS NULL THEN 1 ELSE 0 END)::BIGINT AS unfinished, count(DISTINCT block_id) AS blocks, max(state_revision) AS state_revision,
      'results=' || count(*) || ' unfinished=' || sum(CASE WHEN finished_at IS NULL THEN 1 ELSE 0 END)::BIGINT AS line FROM result_identity r GROUP BY 1"""
)
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG3-AGG5, AGG16: counters of each session, also as a line."""
    g = load(spark, d, "result_identity").groupBy("session_id").agg(F.count("*").alias("results"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"), F.countDistinct("block_id").alias("blocks"), F.max("state_revision").alias("state_revision"))
    return g.withColumn("line", F.concat(F.lit("results="), F.col("results"), F.lit(" unfinished="), F.col("unfinished")))


@query("SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS k FROM events")
def json_values(spark: SparkSession, d: str) -> DataFrame:
    """SRC17: one value of each event's JSON; an empty one is missing."""
    return load(spark, d, "events").select("event_id", F.nullif(F.trim(F.get_json_object("props", "$.k")), F.lit("")).alias("k"))


@query("SELECT kind, count(*) AS n FROM (SELECT coalesce(element_at(params, 'kind')[1], '') AS kind FROM tracked_block) WHERE kind NOT IN ('tooltip', 'label') GROUP BY 1")
def kept_kinds(spark: SparkSession, d: str) -> DataFrame:
    """DED10: blocks by kind, without overlay kinds."""
    b = load(spark, d, "tracked_block").select(F.coalesce(F.try_element_at("params", F.lit("kind")), F.lit("")).alias("kind"))
    return b.where(~F.col("kind").isin("tooltip", "label")).groupBy("kind").agg(F.count("*").alias("n"))


# Frames of lines -----------------------------------------------------------------------------


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by session and range of twelve ids, which stand in for frames of lines."""
    return load(spark, d, "tracked_block").where("id IS NOT NULL").withColumn("frame", F.expr("id div 12"))


_FRAME = ["session_id", "frame"]


def _as_next(lines: DataFrame) -> DataFrame:
    """Lines under the frame after their own, where they are the frame before."""
    return lines.withColumn("frame", F.col("frame") + 1)


@query()
def wrapped_lines(spark: SparkSession, d: str) -> DataFrame:
    """WIN1-WIN5: reading order of each frame with soft wraps joined."""
    return layout.run_pass(_frames(spark, d), _FRAME, "wraps")


@query()
def frame_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """WIN7-WIN9, WIN12, WIN15, DED6: double reads dropped, rows stitched, paragraphs joined."""
    return layout.run_pass(_frames(spark, d), _FRAME, "paragraphs")


@query()
def flow_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """WIN10, WIN16: lines that flow on joined, with the tails that touch them."""
    return layout.run_pass(_frames(spark, d), _FRAME, "flow")


@query()
def column_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """WIN6: paragraphs of each frame that don't cross its columns."""
    return layout.run_pass(_frames(spark, d), _FRAME, "columns")


_aid = "list_filter(range(1, length(k)), lambda i: len(list_filter(range(3, 11), lambda l: i + 2 * l - 1 <= length(k) AND substring(k, i::INT, l::INT) = substring(k, (i + l)::INT, l::INT))) > 0)"


@query(
    rf"""WITH b AS (SELECT row_id, session_id, id // 12 AS frame, box, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0b]+', '', 'g') AS k FROM tracked_block WHERE box IS NOT NULL AND id IS NOT NULL),
      h AS (SELECT session_id, frame, list_sort(list(greatest(1, box.y2 - box.y1))) AS hs FROM b GROUP BY 1, 2), l AS (SELECT session_id, frame, len(hs) AS n, hs[floor(len(hs) * 0.55::DOUBLE)::INT + 1:] AS body, hs[-1] AS top FROM h),
      m AS (SELECT session_id, frame, n, greatest(12, floor(least(body[len(body) // 2 + 1], top) * 0.45::DOUBLE)) AS lim FROM l),
      a AS (SELECT b.*, n >= 4 AND regexp_matches(k, '^[ぁ-ヿ]+$') AND len({_aid}) > 0 AND box.y2 - box.y1 <= lim AND EXISTS (SELECT 1 FROM b o WHERE o.session_id = b.session_id AND o.frame = b.frame AND o.row_id <> b.row_id AND regexp_matches(o.text, '[一-鿿]') AND (o.box.y2 - 4 <= b.box.y1 OR o.box.y1 >= b.box.y2 + 4) AND least(o.box.x2, b.box.x2) - greatest(o.box.x1, b.box.x1) > 0.4 * greatest(1, b.box.x2 - b.box.x1)) AS aid FROM b JOIN m USING (session_id, frame))
    SELECT row_id FROM (SELECT row_id, aid, bool_and(aid) OVER (PARTITION BY session_id, frame) AS every FROM a) WHERE NOT aid OR every"""
)
def unaided_lines(spark: SparkSession, d: str) -> DataFrame:
    """WIN25: lines without small reading aids beside Chinese characters."""
    return layout.run_pass(_frames(spark, d), _FRAME, "unaided").select(F.col("first_id").alias("row_id"))


@query()
def frame_texts(spark: SparkSession, d: str) -> DataFrame:
    """SNK6, STR43: each frame as plain text."""
    return layout.frame_text(_frames(spark, d), _FRAME)


@query()
def changed_regions(spark: SparkSession, d: str) -> DataFrame:
    """STM18-STM21, STM26: tiles of changed blocks, grouped and united into regions."""
    tiles = _frames(spark, d).where("change_count > 0 AND box IS NOT NULL").select(*_FRAME, F.expr("box.x1 div 16").cast("int").alias("tile_x"), F.expr("box.y1 div 16").cast("int").alias("tile_y")).distinct()
    return layout.tile_regions(tiles, _FRAME, 16, 3840, 2160, 24)


@query()
def matched_lines(spark: SparkSession, d: str) -> DataFrame:
    """JN8-JN10: greedy matching of each frame's blocks with those of the frame before it by score."""
    rows = _frames(spark, d).select(*_FRAME, F.col("row_id").alias("id"), "box", "lang", "text")
    return tracking.match_frames(_as_next(rows), rows, _FRAME)


# Reversible rewrites -------------------------------------------------------------------------

_RESTORED = "SELECT entry_id, coalesce(source_text, '') AS restored, true AS survived FROM translations"


def _round_trip(spark: SparkSession, d: str, take, shape: str) -> DataFrame:
    rows = load(spark, d, "translations").select("entry_id", take(F.col("source_text")).alias("p"))
    return rows.select("entry_id", protect.restore(F.col("p.text"), F.col("p.taken"), shape).alias("restored"), protect.survived(F.col("p.text"), F.col("p.taken"), shape).alias("survived"))


@query(_RESTORED)
def path_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """PH1, PH2, PH7: paths taken out and put back."""
    return _round_trip(spark, d, protect.protect_paths, protect.PATH_TOKEN)


@query(_RESTORED)
def name_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """PH3, PH4, PH7: names taken out and put back."""
    return _round_trip(spark, d, protect.protect_names, protect.NAME_TOKEN)


@query(_RESTORED)
def mark_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """PH5, PH6, PH8: inner punctuation taken out and put back."""
    return _round_trip(spark, d, protect.protect_marks, protect.MARK_TOKEN)


# Streams -------------------------------------------------------------------------------------


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all there is and returns what it wrote; tests and replays."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("SELECT session_id, id, arg_max(row_id, (content_revision, row_id)) AS row_id FROM tracked_block GROUP BY 1, 2")
def streamed_latest(spark: SparkSession, d: str) -> DataFrame:
    """STM2 as a stream: the newest version of each block so far."""
    rows = load(spark, d, "tracked_block").select("session_id", "id", "content_revision", "row_id")
    stream = spark.readStream.schema(rows.schema).parquet(f"{d}/tracked_block.parque[t]")  # a pattern, since the table may be a file or a folder
    return _drain(blocks.newest(stream, ["session_id", "id"], ["content_revision", "row_id"], "row_id"), "complete")


# Labels, roles, readings ---------------------------------------------------------------------

_l1 = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0b]+', ' ', 'g'))"
_spoken = lambda t: rf"(length(trim({t})) >= 8 AND regexp_extract(trim({t}), '^([A-Za-z][A-Za-z0-9 .''\-]{{0,28}}):\s+\S.{{3,}}', 1) <> '' AND length(trim(regexp_extract(trim({t}), '^([A-Za-z][A-Za-z0-9 .''\-]{{0,28}}):\s+\S.{{3,}}', 1))) BETWEEN 2 AND 24 AND lower(trim(regexp_extract(trim({t}), '^([A-Za-z][A-Za-z0-9 .''\-]{{0,28}}):\s+\S.{{3,}}', 1))) NOT IN ({', '.join(repr(w) for w in gates.NO_NAMES)}) AND NOT (len(string_split(trim(regexp_extract(trim({t}), '^([A-Za-z][A-Za-z0-9 .''\-]{{0,28}}):\s+\S.{{3,}}', 1)), ' ')) >= 2 AND len(list_filter(string_split(trim(regexp_extract(trim({t}), '^([A-Za-z][A-Za-z0-9 .''\-]{{0,28}}):\s+\S.{{3,}}', 1)), ' '), lambda w: length(w) > 9)) > 0))"
_wl = f"regexp_extract_all({_l1}, '[A-Za-z'']+')"


@query(
    rf"""SELECT row_id, (length({_l1}) BETWEEN 2 AND 32 AND NOT {_spoken(_l1)} AND NOT (regexp_matches({_l1}, '^\p{{Ll}}') AND length({_l1}) >= 8) AND NOT regexp_matches({_l1}, '(?i)\b({labels.BODY_WORDS})\b') AND len({_wl}) BETWEEN 1 AND 4) AS prompt,
      CASE WHEN trim(coalesce(text, '')) = '' THEN -1.0 WHEN regexp_matches(trim(text), '^\d+$') THEN 0.55 WHEN length(trim(text)) <= 4 AND regexp_matches(trim(text), '[0-9]') AND regexp_matches(trim(text), '\p{{L}}') AND NOT contains(trim(text), ' ') THEN 0.05
        WHEN regexp_matches(trim(text), '^[A-Za-z][A-Za-z''’-]*$') THEN 0.6 WHEN regexp_matches(text, '[ぁ-ゖァ-ヺー一-鿿]') THEN 0.8 ELSE 0.3 END::DOUBLE AS plausible,
      CASE WHEN lower(trim(coalesce(lang, ''))) IN ('ru', 'uk', 'bg', 'sr', 'mk') THEN 'Ур.' ELSE 'Lv.' END AS level_word FROM tracked_block"""
)
def label_shapes(spark: SparkSession, d: str) -> DataFrame:
    """FLT22, FLT44, STR37: prompts, plausibility of readings and level words of the blocks."""
    t = F.col("text")
    return load(spark, d, "tracked_block").select("row_id", labels.is_ui_prompt(t).alias("prompt"), labels.plausibility(t).alias("plausible"), labels.level_word(F.col("lang")).alias("level_word"))


@query()
def line_roles(spark: SparkSession, d: str) -> DataFrame:
    """FLT24, FLT27, JN22, JN24, JN25, FLT46: navigation lines, headers, roles by kind and shape, and zones."""
    b = load(spark, d, "tracked_block")
    zones = [{"x": 0.0, "y": 0.0, "w": 0.25, "h": 0.25, "unit": "frac", "role": "HUD"}, {"x": 0.0, "y": 0.9, "w": 1.0, "h": 0.1, "unit": "frac", "role": "DECOR"}]
    t = F.col("text")
    return b.select("row_id", labels.is_nav_line(t).alias("nav"), labels.is_section_header(t).alias("header"), labels.role(F.try_element_at("params", F.lit("kind")), t, F.col("box")).alias("role"), labels.zone_roles(b, zones, 1920, 1080).alias("zone"))


@query(
    rf"""SELECT row_id FROM tracked_block b WHERE NOT EXISTS (SELECT 1 FROM (SELECT session_id, {'@E@'.replace('@E@', "trim(regexp_replace(regexp_replace(replace(lower(coalesce(translation, '')), 'ß', 'ss'), '[^\\p{L}\\p{M}\\p{N}_\\s\\x{3000}]', '', 'g'), '" + _SPACE + "', ' ', 'g'))")} AS e FROM tracked_block) o
      WHERE o.session_id = b.session_id AND o.e <> '' AND o.e = trim(regexp_replace(regexp_replace(replace(lower(coalesce(b.text, '')), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{N}}_\s\x{{3000}}]', '', 'g'), '{_SPACE}', ' ', 'g')))"""
)
def own_text_dropped(spark: SparkSession, d: str) -> DataFrame:
    """JN15, JN16: blocks that don't repeat what their session shows itself."""
    b = load(spark, d, "tracked_block")
    return labels.without_own_text(b.select("row_id", "session_id", "text"), "text", b, "translation", ["session_id"]).select("row_id")


@query(f"SELECT entry_id, trim(regexp_replace(coalesce(translated_text, ''), '{_SPACE}', ' ', 'g')) AS joined, true AS every_row, len(list_filter(string_split(coalesce(source_text, ''), chr(10)), lambda x: true))::INT AS n FROM translations")
def words_over_rows(spark: SparkSession, d: str) -> DataFrame:
    """STR39, STR40, STR42, STR44: translations spread over the lines of their sources by length; joined again they are whole."""
    rows = load(spark, d, "translations")
    weights = F.transform(F.split(F.coalesce("source_text", F.lit("")), "\n"), lambda x: F.length(F.regexp_replace(x, r"\s+", "")))
    parts = rows.select("entry_id", labels.spread("translated_text", weights).alias("p"), F.size(weights).alias("n"))
    return parts.select("entry_id", F.array_join(F.filter("p", lambda x: x != ""), " ").alias("joined"), (F.size("p") == F.col("n")).alias("every_row"), "n")


# Noise ---------------------------------------------------------------------------------------

_JP = "[ぁ-ゖァ-ヺー一-鿿]"
_nt = "trim(coalesce(line, ''))"
_gt = rf"trim(regexp_replace({_nt}, '[ \t\n\r\f\x0b]+', ' ', 'g'))"
_ex = lambda t, p: f"regexp_extract_all({t}, '{p}')"
_gw, _gp = _ex(_gt, "[A-Za-z]{4,}"), _ex(_gt, "[A-Za-zА-яЁё'']+")
_cnt = lambda xs, test: f"len(list_filter({xs}, lambda w: {test}))"
_glued = when(
    (f"{_gt} = ''", "true"), (f"{n(_gt, _JP)} >= 2", "false"), (f"length({_gt}) >= 16 AND NOT contains({_gt}, ' ')", "true"),
    (f"len({_gw}) > 0 AND {_cnt(_gw, "NOT regexp_matches(lower(w), '[aeiouy]')")} >= greatest(2, len({_gw}) // 2)", "true"), other=f"(len({_gp}) >= 5 AND {_cnt(_gp, 'length(w) <= 2')} >= 4 AND {_cnt(_gp, 'length(w) <= 2')} * 5 >= len({_gp}) * 3)",
)


@query(
    f"""SELECT doc_id, sum(CASE WHEN glued THEN 1 ELSE 0 END)::BIGINT AS glued, sum(CASE WHEN screen THEN 1 ELSE 0 END)::BIGINT AS screen, count(*) AS n_lines FROM (SELECT doc_id, {_glued} AS glued,
      regexp_matches(coalesce(line, ''), '(?i)\\b({gates.SCREEN_WORDS.replace("'", "''")})\\b') AS screen FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)) GROUP BY 1"""
)
def glued_lines(spark: SparkSession, d: str) -> DataFrame:
    """FLT2, AGG7: glued lines and screen words of each document."""
    x = F.col("line")
    lines = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(gates.is_glued(x)).alias("glued"), F.count_if(gates.is_screen_word(x)).alias("screen"), F.count("*").alias("n_lines"))


@query()
def noise_by_engine(spark: SparkSession, d: str) -> DataFrame:
    """FLT1, FLT9, AGG8: noisy reads and the sum of reading scores of each engine."""
    b = load(spark, d, "tracked_block").select("engine", "text", "conf", gates.is_noise(F.col("text")).alias("noise"))
    return b.groupBy("engine").agg(F.count("*").alias("n"), F.count_if("noise").alias("noisy"), F.round(F.sum(gates.reading_score(F.col("text"), F.col("conf") * 100, F.col("noise"))), 2).alias("score"))


@query()
def repaired_readings(spark: SparkSession, d: str) -> DataFrame:
    """STR1-STR3: texts with repaired short words."""
    return load(spark, d, "memory").select("memory_id", text.repair_reading(F.col("source_text")).alias("text"))


@query(
    """WITH b AS (SELECT row_id, session_id, id // 12 AS frame, (box.x1 + box.x2) / 2.0 AS c, text FROM tracked_block WHERE box IS NOT NULL AND id IS NOT NULL),
      g AS (SELECT *, c - lag(c) OVER w AS gap FROM b WINDOW w AS (PARTITION BY session_id, frame ORDER BY c, row_id)),
      r AS (SELECT *, CASE WHEN gap > 70 THEN row_number() OVER (PARTITION BY session_id, frame ORDER BY coalesce(gap, -1) DESC, c, row_id) END AS k FROM g),
      q AS (SELECT *, sum(CASE WHEN k <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, frame ORDER BY c, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS col FROM r)
    SELECT session_id, frame, col, count(*) AS n, sum("""
    + letters("text")
    + ")::BIGINT AS letters, sum("
    + in_script("text", "cyrl")
    + """)::BIGINT AS own FROM q GROUP BY 1, 2, 3"""
)
def column_scripts(spark: SparkSession, d: str) -> DataFrame:
    """WIN19, WIN24: columns of each frame, cut at its two widest gaps, and their letters in the target script."""
    b = _frames(spark, d).where("box IS NOT NULL").select("row_id", *_FRAME, ((F.col("box.x1") + F.col("box.x2")) / 2.0).alias("c"), "text")
    order = Window.partitionBy(*_FRAME).orderBy("c", "row_id")
    g = b.withColumn("gap", F.col("c") - F.lag("c").over(order))
    k = F.row_number().over(Window.partitionBy(*_FRAME).orderBy(F.desc(F.coalesce("gap", F.lit(-1.0))), "c", "row_id"))
    q = g.withColumn("cut", (F.col("gap") > 70) & (k <= 2)).withColumn("col", F.sum(F.when(F.col("cut"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return q.groupBy(*_FRAME, "col").agg(F.count("*").alias("n"), F.sum(scripts.letter_count(F.col("text"))).alias("letters"), F.sum(scripts.count(F.col("text"), f"[{scripts.SCRIPTS['cyrl']}&&\\p{{L}}]")).alias("own"))


# Two reads of a frame ------------------------------------------------------------------------


def _reads(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return _frames(spark, d).where("box IS NOT NULL").select(*_FRAME, F.col("row_id").alias("id"), "text", "box", "conf", *more)


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two halves of each frame's blocks, which stand in for two reads of it."""
    rows = _reads(spark, d)
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1")


_HALF = "(SELECT session_id, id // 12 AS frame, row_id AS id, text, box, conf FROM tracked_block WHERE box IS NOT NULL AND id IS NOT NULL AND row_id % 2 = {})"


@query(
    f"""SELECT a.id FROM {_HALF.format(0)} a WHERE NOT EXISTS (SELECT 1 FROM {_HALF.format(1)} b WHERE a.session_id = b.session_id AND a.frame = b.frame
      AND (greatest(0, least(a.box.x2, b.box.x2) - greatest(a.box.x1, b.box.x1)) * greatest(0, least(a.box.y2, b.box.y2) - greatest(a.box.y1, b.box.y1)))
        / least(greatest(1, (a.box.x2 - a.box.x1) * (a.box.y2 - a.box.y1)), greatest(1, (b.box.x2 - b.box.x1) * (b.box.y2 - b.box.y1))) >= 0.28)"""
)
def unshared_lines(spark: SparkSession, d: str) -> DataFrame:
    """JN26, DED11: lines of one read that none of the other overlaps."""
    a, b = _halves(spark, d)
    return overlap.without_overlapping(a, b, _FRAME).select("id")


@query(
    _SQL["unshared_lines"].replace(_HALF.format(0), "(SELECT session_id, id // 12 AS frame, row_id AS id, box FROM tracked_block WHERE box IS NOT NULL AND id IS NOT NULL)").replace(_HALF.format(1), "(SELECT session_id, id // 12 + 1 AS frame, box FROM tracked_block WHERE box IS NOT NULL AND id IS NOT NULL)")
)
def unshared_lines_all(spark: SparkSession, d: str) -> DataFrame:
    """JN26, DED11: lines of each frame that no line of the frame before it overlaps."""
    rows = _reads(spark, d)
    return overlap.without_overlapping(rows, _as_next(rows), _FRAME).select("id")


@query()
def merged_reads(spark: SparkSession, d: str) -> DataFrame:
    """JN11, JN12, JN14: each frame merged by place with the frame before it, the surer line of each band, ``tess`` as second read."""
    rows = _reads(spark, d, "engine")
    merged = overlap.merge_by_place(_as_next(rows), rows, _FRAME)
    second = F.coalesce(F.col("engine") == "tess", F.lit(False))
    return overlap.best_in_band(merged.where(~second), merged.where(second), _FRAME).select(*_FRAME, "id")


@query()
def united_reads(spark: SparkSession, d: str) -> DataFrame:
    """DED9: the lines of each frame in other languages and in Japanese, one for each cell of 4 pixels."""
    rows = _reads(spark, d, "lang")
    japanese = F.coalesce(F.col("lang") == "ja", F.lit(False))
    return overlap.union_of_halves(rows.where(~japanese), rows.where(japanese), _FRAME).select(*_FRAME, "id")


@query()
def plates(spark: SparkSession, d: str) -> DataFrame:
    """JN17-JN20: names beside or above their bodies."""
    a, b = _halves(spark, d)
    return overlap.name_plates(a.unionByName(b), _FRAME)


@query()
def finished_frames(spark: SparkSession, d: str) -> DataFrame:
    """WIN28, DED1, DED2: the furthest reads of each frame, distinct, at most 80."""
    a, b = _halves(spark, d)
    return overlap.finish_frame(overlap.longest_reads(a.unionByName(b), _FRAME), _FRAME).select(*_FRAME, "id")


# Runs, claims, summaries ---------------------------------------------------------------------


@query(
    f"""WITH x AS (SELECT doc_id, pos, CASE WHEN {_spoken("coalesce(line, '')")} THEN 1 ELSE 0 END AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
      y AS (SELECT doc_id, sum(start) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM x)
    SELECT doc_id, max(run) AS runs, max(n) AS longest FROM (SELECT doc_id, run, count(*) AS n FROM y GROUP BY 1, 2) GROUP BY 1"""
)
def spoken_runs(spark: SparkSession, d: str) -> DataFrame:
    """WIN14: a spoken line begins a run that lasts until the next one; runs of each document. A document's lines are one window's partition."""
    lines = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    start = F.when(gates.is_spoken_line(F.col("line")), 1).otherwise(0)
    runs = lines.withColumn("run", F.sum(start).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("run").alias("runs"), F.max("n").alias("longest"))


_tt = "trim(coalesce(text, ''))"


@query(
    rf"""SELECT row_id FROM tracked_block WHERE coalesce(element_at(params, 'kind')[1], '') IN ('dialogue', 'dialogue-line', 'body') AND {_tt} <> '' AND (length(regexp_replace({_tt}, '[ \t\n\r\f\x0b]+', '', 'g')) >= 12 OR {_spoken(_tt)})
      AND ({_spoken(_tt)} OR length({_tt}) >= 22 OR regexp_matches({_tt}, '[.!?…]'))"""
)
def dialogue_cards(spark: SparkSession, d: str) -> DataFrame:
    """STM32: blocks of dialogue that are long or punctuated enough to be spoken."""
    t = F.trim(F.coalesce("text", F.lit("")))
    spoken = gates.is_spoken_line(t)
    kind = F.coalesce(F.try_element_at("params", F.lit("kind")), F.lit(""))
    b = load(spark, d, "tracked_block").where(kind.isin("dialogue", "dialogue-line", "body") & (t != ""))
    return b.where(((F.length(F.regexp_replace(t, r"\s+", "")) >= 12) | spoken) & (spoken | (F.length(t) >= 22) | t.rlike("[.!?…]"))).select("row_id")


@query("SELECT source AS key, arg_min(pack, ordinal) AS owner, count(*) - 1 AS refused FROM terms WHERE source IS NOT NULL GROUP BY 1")
def first_claims(spark: SparkSession, d: str) -> DataFrame:
    """CFG5: the first claim of a key holds, later ones are refused; load order decides."""
    return load(spark, d, "terms").where("source IS NOT NULL").groupBy(F.col("source").alias("key")).agg(F.min_by("pack", "ordinal").alias("owner"), (F.count("*") - 1).alias("refused"))


@query("SELECT session_id, arg_min(engine, row_id) FILTER (engine IS NOT NULL) AS engine, arg_min(lang, row_id) FILTER (lang IS NOT NULL) AS lang, sum(change_count)::BIGINT AS changes, sum(seen_passes)::BIGINT AS passes FROM tracked_block GROUP BY 1")
def merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    """AGG15, AGG19: summaries of a session merged: counts add up, of other fields the first value stays."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_id"))).alias(c)
    return load(spark, d, "tracked_block").groupBy("session_id").agg(first("engine"), first("lang"), F.sum("change_count").alias("changes"), F.sum("seen_passes").alias("passes"))


@query(
    r"""SELECT memory_id, len(p)::INT AS n_prints, array_to_string(list_sort(p), ' ') AS prints FROM (SELECT memory_id, list_distinct(list_filter(list_transform(string_split(source_text, '|'), lambda w: regexp_replace(lower(w), '[^a-z0-9]+', '', 'g')), lambda w: w <> '')) AS p
      FROM memory WHERE contains(source_text, '|'))"""
)
def line_prints(spark: SparkSession, d: str) -> DataFrame:
    """STR10, AGG18: fingerprints of the parts of pipe-joined lines."""
    prints = F.array_distinct(F.filter(F.transform(F.split("source_text", r"\|"), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]+", "")), lambda w: w != ""))
    rows = load(spark, d, "memory").where(F.contains("source_text", F.lit("|"))).select("memory_id", prints.alias("p"))
    return rows.select("memory_id", F.size("p").alias("n_prints"), F.array_join(F.array_sort("p"), " ").alias("prints"))


from glyphmill.plans import line_rules, readers  # noqa: E402, F401  register their queries
