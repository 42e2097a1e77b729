"""Queries over what lines are, and over readings, with SQL equivalents for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import boxes, gates, labels, lines, protect, text
from glyphmill.operators import batching, speakers, tracking
from glyphmill.plans import catalogue as c
from glyphmill.plans.catalogue import query, when
from glyphmill.session import load

WIDTH, HEIGHT = 1920, 1080
MARK, OPENINGS, SHAPES, WHOLE = "shared page|copied from", ("Obtained", "Quest", "Your"), (r"\b\d+\s*x\s*col\.?\b",), ("guard", "map", "settings")
NEEDLES, TITLES, LEGEND = ("just now", "wounded"), ("online", "episode"), ("waypoint", "checkpoint", "harbour", "map")
NAMES, KNOWN = ("ミラ", "スモ"), ("設定", "購入")

_cnt = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"
_any = lambda t, ws: "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"
_list = lambda ws: ", ".join(f"'{w}'" for w in ws)
_lw = lambda w: _cnt(w, "[aeiouyAEIOUYаеёиоуыэюяАЕЁИОУЫЭЮЯ]")

# Layers of common table expressions: texts, noise, shapes --------------------------------------

_scraps = "regexp_extract_all(t0, '[A-Za-zА-яЁё]+')"
_words3 = "len(list_filter(regexp_extract_all(t0, '[A-Za-z]{3,}'), lambda w: regexp_matches(lower(w), '[aeiou]')))"
_spam = when(
    (f"{c._digits} < 3 OR {c._digits} < 0.18 * greatest({c._compact}, 1)", "false"), (r"regexp_matches(t0, '^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$')", "false"), (f"len({c._w}) = 0", "true"),
    (f"{c._spelled} >= 2 OR ({c._spelled} >= 1 AND {c._abbrev} >= 1) OR {c._abbrev} >= 2", "false"), (f"{c._spelled} + {c._abbrev} >= 1 AND {c._digits} < 8", "false"), other=f"len({c._w}) < 2",
)
_flips = "len(list_filter(regexp_extract_all(t0, '[А-яЁё]{4,}'), lambda w: len(list_filter(range(1, length(w)), lambda i: regexp_matches(substring(w, i::INT, 2), '^([А-ЯЁ][а-яё]|[а-яё][А-ЯЁ])$'))) >= 2))"
_dry = f"len(list_filter(regexp_extract_all(t0, '[A-Za-zА-яЁё]{{6,}}'), lambda w: lower(w) NOT IN ({_list(gates.FEW_VOWELS)}) AND {_lw('w')} < 0.14 * length(w))) > 0"
_cyr, _all = _cnt("t0", "[Ѐ-ӿ]"), _cnt("t0", r"\p{L}")
_cyrillic = rf"({_cyr} * 2 > {_all} OR ({_cyr} * 2 = {_all} AND (regexp_matches(t0, '^[^\p{{L}}]*[Ѐ-ӿ]') OR {_cnt('t0', '[A-Za-z]')} < {_cyr})))"
_noise = when(
    ("length(t0) < 2", "true"), (f"{_cnt('t0', c._JP)} >= 2", "false"), ("glued", "true"), (f"{_all} < 2", "true"),
    (f"len({_scraps}) >= 4 AND len(list_filter({_scraps}, lambda w: length(w) <= 2)) >= len({_scraps}) - 1 AND length(array_to_string({_scraps}, '')) <= 18", "true"), ("spam", "true"),
    (f"{_cnt('t0', '[а-яё]')} = 0 AND {_cnt('t0', '[А-ЯЁ]')} >= 6 AND {_cnt('t0', '[А-ЯЁ]')} >= 0.7 * {_all}", "true"), (f"{_dry} OR {_flips} >= 2", "true"),
    other=f"({_cnt('t0', '[A-Za-z]')} >= 4 AND {_cnt('t0', c._JP)} = 0 AND NOT {_cyrillic} AND (({_words3} = 0 AND {_cnt('t0', '[A-Za-z]{2,}')} < 2) OR ({_words3} = 1 AND length(t0) > 18 AND {_cnt('t0', '[0-9()~.,-]')} >= 4)))",
)
_hud = r"(regexp_matches(upper(t), '^(BARNING|DARNING|WARNI|ARNING|SYSTEM)$') OR regexp_matches(upper(t), '^W?A?RNINGS?$') OR (contains(upper(t), 'WARNING') AND length(t) <= 18) OR regexp_matches(upper(t), 'PROGRAM\s*CONTROL|SYSTEM\s*ANNOUNCE|CONTROL:\s*0'))"
_wt = "regexp_extract_all(t, '[A-Za-z'']+')"
_capitals = f"len(list_filter({_wt}, lambda w: regexp_matches(w, '^[A-Z]')))"
_header = rf"(length(t) BETWEEN 2 AND 52 AND NOT regexp_matches(t, '[.!?:,;]$') AND len({_wt}) BETWEEN 1 AND 7 AND NOT (spoken AND length(t) >= 40) AND ({_capitals} >= greatest(1, len({_wt}) - CASE WHEN regexp_matches(coalesce({_wt}[-1], ''), '^[a-z'']{{1,3}}$') THEN 1 ELSE 0 END) OR (regexp_matches(t, '^\p{{Lu}}') AND len({_wt}) BETWEEN 3 AND 7 AND NOT regexp_matches(t, '^({labels.OPENINGS})\b') AND NOT spoken)))"
_prompt = rf"(length(t) BETWEEN 2 AND 32 AND NOT spoken AND NOT (regexp_matches(t, '^\p{{Ll}}') AND length(t) >= 8) AND NOT regexp_matches(t, '(?i)\b({labels.BODY_WORDS})\b') AND len({_wt}) BETWEEN 1 AND 4)"
_nw = "regexp_extract_all(t0, '[A-Za-zА-яЁё0-9''-]+')"
_nav = rf"(t0 <> '' AND length(t0) <= 58 AND NOT regexp_matches(t0, '^\p{{Ll}}') AND (regexp_matches(t0, '(?i)^({labels.NAV_WORDS})\b') OR (len({_nw}) BETWEEN 1 AND 4 AND len(list_filter({_nw}, lambda w: NOT (regexp_matches(w, '^[^\p{{L}}]') OR regexp_matches(w, '^\p{{Lu}}')))) = 0 AND length(t0) <= 40)))"
_ls = "regexp_replace(t, '[^A-Za-z]', '', 'g')"
_vow = _cnt(_ls, "[aeiouyAEIOUY]")
_solid = f"(length({_ls}) BETWEEN 3 AND 18 AND NOT contains(t, ' ') AND ((regexp_matches({_ls}, '^[A-Z]+$') AND {_vow} <= greatest(1, length({_ls}) // 5)) OR (length({_ls}) >= 5 AND {_vow} < 0.18 * length({_ls}))))"
_junk = f"(t = '' OR {_solid})"
_bw, _bh = "greatest(0, box.x2 - box.x1)", "greatest(0, box.y2 - box.y1)"
_plate = f"coalesce((({_bw} >= {int(WIDTH * 0.72)} AND box.y2 >= {int(HEIGHT * 0.94)} AND length({_ls}) < 28) OR ({_bw} >= {int(WIDTH * 0.85)} AND length({_ls}) <= 14) OR ({_bh} >= 55 AND length({_ls}) < 20)) AND NOT spoken, false)"
_run = r"regexp_replace(coalesce(line, ''), '[ \t\n\r\f\x0b]+', '', 'g')"
_window = rf"({_any('lower(t0)', NEEDLES)} OR regexp_matches(t0, '/home/\w+/Pictures') OR regexp_matches(t0, '→\s*/') OR (regexp_matches({_run}, '^[A-Za-z]$') AND length({_run}) BETWEEN 5 AND 14) OR (length(t0) >= 36 AND t0 = upper(t0) AND t0 <> lower(t0) AND contains(t0, ' ') AND {_all} >= 24 AND {_any('lower(t0)', TITLES)}))"
_known = rf"(lower(t) IN ({_list(WHOLE)}) OR regexp_matches(t, '(?i)^({'|'.join(OPENINGS)})\b') OR regexp_matches(t, '(?i){SHAPES[0]}'))"

TEXTS = f"b AS (SELECT row_id, session_id, id, id // 12 AS frame, engine, conf, box, lang, params, stable_passes, text AS line, trim(coalesce(text, '')) AS t0, {c._l1} AS t FROM tracked_block)"
NOISE = f"{TEXTS}, m AS (SELECT *, {c._glued} AS glued, {_spam} AS spam, {c._spoken('t')} AS spoken FROM b), x AS (SELECT *, {_noise} AS noise FROM m)"
SHAPES_SQL = f"{NOISE}, y AS (SELECT *, {_hud} AS hud, {_header} AS header, {_prompt} AS prompt, {_window} AS win, {_junk} AS junk, {_known} AS known FROM x)"

_choice = rf"(length(t) BETWEEN 5 AND 80 AND NOT (spoken OR hud OR win OR noise OR junk) AND (regexp_matches(t, '(?i)^(\[[^\]]{{1,6}}\]\s*)?({'|'.join(lines.COMMANDS)})\b') OR regexp_matches(t, '(?i)^\[[A-Z0-9x]\]\s+\S') OR ({_cnt('t', '[A-Za-z]')} >= 8 AND len({_wt}) BETWEEN 2 AND 8 AND regexp_matches(t, '^\p{{Lu}}') AND NOT (regexp_matches(t, '(\.\.\.|…)$') AND length(t) > 50))))"
_lat0 = _cnt("t0", "[A-Za-z]")
_goes_on = rf"(length(t0) >= 4 AND NOT (spoken OR junk OR hud OR win OR noise) AND {_lat0} >= 4 AND (({_lat0} >= 18 AND {_cnt('t0', ' ')} <= 2) OR NOT ({_lat0} <= 12 AND regexp_matches(t0, '^\p{{Lu}}[^\p{{Lu}}\s]*$') AND NOT regexp_matches(t0, '[.!?,]$'))))"
_cjk = _cnt("t", lines.CJK)
_screen = rf"(length(t) >= 3 AND NOT hud AND NOT win AND (spoken OR known OR (NOT noise AND ({_cnt('t', '[A-Za-z]')} + {_cnt('t', '[Ѐ-ӿ]')} + {_cjk} >= 4 OR {_cjk} >= 2) AND NOT (regexp_matches(t, '^[A-Z]{{1,3}}$') OR regexp_matches(t, '^\d+(/\d+)?$') OR regexp_matches(t, '(?i)^Lv\.?\s*\d+[O0]?$')))))"
_panel = rf"(length(t) >= 18 AND NOT prompt AND NOT header AND NOT choice AND NOT (spoken AND regexp_matches(t, '^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?:')) AND NOT regexp_matches(t, '^[A-Z][\w''-]*(?:\s+[\w''-]+){{0,3}}:$') AND (regexp_matches(t, '^\p{{Ll}}') OR regexp_matches(t, '(?i)\b({labels.BODY_WORDS})\b') OR length(t) >= 36))"
_copied = rf"""CASE WHEN length(t0) < 2 THEN true WHEN regexp_matches(t0, '^[A-Za-z][\w.]*\)?\.?$') THEN false ELSE win OR noise OR regexp_matches(t0, '(?i)^[□■▪▫◉●○]\s*\d*\s*m?\s*ago$') OR (regexp_matches(t0, '(?i)\b\d+m\s*ago\b') AND length(t0) <= 16)
  OR ({_cnt('t0', lines.CJK)} >= 0.4 * greatest({_all}, 1) AND {_cyr} < 0.1 * greatest({_all}, 1) AND {_lat0} < 0.3 * greatest({_all}, 1)) OR regexp_matches(t0, '^[①-⓿■-◿\x{{3000}}-〿\s]+$') OR regexp_matches(t0, '(?i)^Edited(\s+\d+)?$') OR regexp_matches(t0, '^[+＋]?\s*[\d①-⑳]+(\s*[-–]\s*[\d①-⑳]+)?$') END"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with what several line rules share, computed once."""
    t = F.col("text")
    b = load(spark, d, "tracked_block").withColumns({"noise": gates.is_noise(t), "win": lines.is_window_text(t, NEEDLES, None, TITLES), "known": lines.is_known_phrase(t, OPENINGS, SHAPES, WHOLE)})
    return b.withColumn("choice", lines.is_choice(t, F.col("noise"), F.col("win")))


@query(
    f"""WITH {SHAPES_SQL}, z AS (SELECT *, {_choice} AS choice FROM y) SELECT row_id, junk OR regexp_matches(t, '(?i)(?:{MARK})') OR {_plate} AS junk, win AS window, known, choice, {_goes_on} AS goes_on, {_screen} AS screen, {_panel} AS panel, {_copied} AS copied,
      t <> '' AND NOT spoken AND {_any('lower(t)', LEGEND)} AS legend FROM z"""
)
def line_gates(spark: SparkSession, d: str) -> DataFrame:
    """FLT16, FLT25, FLT26, FLT28-FLT32, FLT40: what each block's text is."""
    t, noise, win = F.col("text"), F.col("noise"), F.col("win")
    return _texts(spark, d).select(
        "row_id", lines.is_junk_line(t, F.col("box"), WIDTH, HEIGHT, MARK).alias("junk"), win.alias("window"), "known", "choice", lines.continues_speech(t, noise, win).alias("goes_on"), lines.is_screen_line(t, noise, win, F.col("known")).alias("screen"),
        lines.is_panel_text(t, F.col("choice"), labels.BODY_WORDS).alias("panel"), lines.is_copy_junk(t, noise, win, False).alias("copied"), lines.is_legend(t, LEGEND).alias("legend"),
    )


c._SQL["noise_by_engine"] = f"""WITH {NOISE} SELECT engine, count(*) AS n, sum(CASE WHEN noise THEN 1 ELSE 0 END)::BIGINT AS noisy, round(sum(CASE WHEN noise THEN 0.0 WHEN {_words3.replace('t0', "coalesce(line, '')")} >= 2 OR ({_words3.replace('t0', "coalesce(line, '')")} >= 1 AND length(coalesce(line, '')) >= 14)
  THEN 12 + {_words3.replace('t0', "coalesce(line, '')")} * 4 + coalesce(conf * 100, 0) * 0.04::DOUBLE WHEN {_words3.replace('t0', "coalesce(line, '')")} = 1 AND coalesce(conf * 100, 0) >= 78 THEN 5.0 ELSE 0.0 END), 2) AS score FROM x GROUP BY 1"""

_ratio = "greatest(1, box.x2 - box.x1) / greatest(1, box.y2 - box.y1)"
_kind = "lower(trim(coalesce(element_at(params, 'kind')[1], '')))"
_role = when(
    *((f"{_kind} = '{k}'", f"'{r}'") for k, r in labels.ROLE_OF_KIND.items()), ("t0 = ''", "'unknown'"), (f"spoken0 AND {_ratio} >= 4.0", "'dialogue'"), ("prompt AND length(t0) <= 28", "'menu'"),
    (f"greatest(1, box.y2 - box.y1) >= 34 AND {_ratio} >= 3.2 AND length(t0) <= 32", "'title'"), (f"{_ratio} >= 6.0", "CASE WHEN spoken0 THEN 'dialogue' ELSE 'body' END"), ("length(t0) <= 40", "'hud'"), other="'unknown'",
)
ROLES = f"{SHAPES_SQL}, r0 AS (SELECT *, {c._spoken('t0')} AS spoken0 FROM y), r AS (SELECT *, {_role} AS role FROM r0)"
_cx, _cy = "(box.x1 + box.x2) * 0.5", "(box.y1 + box.y2) * 0.5"
c._SQL["line_roles"] = f"""WITH {ROLES} SELECT row_id, {_nav} AS nav, header, role, CASE WHEN {_cx} BETWEEN 0 AND 1920 AND {_cy} BETWEEN 0.9 * 1080 AND (0.9 + 0.1) * 1080 THEN 'DECOR' WHEN {_cx} BETWEEN 0 AND 480 AND {_cy} BETWEEN 0 AND 270 THEN 'HUD' END AS zone FROM r"""


def _fix(sql: str) -> str:
    for pattern, new in text.READING_FIXES:
        pattern, new = pattern.replace("(?=[A-Za-zА-я])", "([A-Za-zА-я])"), "\\1" if "(?=" in pattern else new.replace("$", "\\")
        sql = f"regexp_replace({sql}, '(?i){pattern}', '{new}', 'g')"
    return sql


c._SQL["repaired_readings"] = rf"""SELECT memory_id, {c.strip(f"array_to_string(list_transform(string_split(coalesce(source_text, ''), chr(10)), lambda v: trim({_fix("trim(regexp_replace(v, '[ \t\r\f\x0b]+', ' ', 'g'))")})), chr(10))")} AS text FROM memory"""


# Japanese reads, boxes, words -----------------------------------------------------------------

_cc = r"regexp_replace(t, '[ \t\n\r\f\x0b]+', '', 'g')"
_jp, _hn, _kn = _cnt(_cc, lines.JAPANESE), _cnt(_cc, lines.HAN), _cnt(_cc, lines.KANA)
_latin = f"({_cnt('t', '[A-Za-z]')} >= 2 AND {_cnt('t', c._JP)} = 0)"
_name = f"({_cc} IN ({_list(NAMES)}) AND length({_cc}) BETWEEN 1 AND 6 AND ({_kn} >= 2 OR ({_hn} >= 1 AND length({_cc}) <= 3)))"
_hits = f"len(list_filter([{_list(lines.PARTICLES)}], lambda p: contains({_cc}, p)))"
_longs = _cnt(_cc, "[ー―一]")
_jnoise = when(
    (f"t = '' OR {_latin} OR t IN ({_list(KNOWN)}) OR {_name}", "false"), (f"{_jp} < 2 OR ({_cnt(_cc, '[A-Za-z]')} >= 3 AND {_jp} < 8) OR regexp_matches(t, '[`|>\\\\_^=~]')", "true"), (f"length(t) - length({_cc}) >= 2 AND {_jp} <= 10", "true"),
    (f"{_hn} = 0 AND (({_longs} >= 2 AND {_jp} <= 10) OR {_longs} >= greatest(3, length({_cc}) // 2))", "true"), (f"{_hn} = 0 AND {_cnt(_cc, '[ニヌネノミー]')} >= 3 AND length({_cc}) <= 12", "true"),
    (f"{_hn} = 0 AND {_hits} = 0 AND (({_jp} <= 4 AND {_cc} NOT IN ({_list(KNOWN)})) OR {_jp} <= 6)", "true"), (f"{_hn} >= 1 AND {_jp} <= 2 AND {_hits} = 0 AND {_kn} >= 1", "true"), other=f"({_hn} = 0 AND {_jp} <= 4 AND {_hits} = 1 AND {_cc} NOT IN ({_list(KNOWN)}))",
)


@query(
    f"""WITH {NOISE}, j AS (SELECT *, {_jnoise} AS scrap, {_name} AS name, {_latin} AS latin FROM x)
    SELECT row_id, scrap, name, round(CASE WHEN scrap OR latin THEN 0.0 WHEN {_cnt('t', lines.HAN)} >= 1 THEN 14 + {_cnt('t', lines.HAN)} * 2 + coalesce(conf * 100, 0) * 0.03::DOUBLE WHEN name THEN 8.0 WHEN {_cnt('t', lines.JAPANESE)} >= 4 THEN 6.0 ELSE 1.0 END, 4)::DOUBLE AS score,
      NOT noise AS plausible, CASE WHEN latin OR coalesce(element_at(params, 'kind')[1], '') IN ('chip', 'latin', 'menu') THEN NOT noise OR replace(upper(coalesce(line, '')), ' ', '') IN ('TAP!', 'NEW!') ELSE NOT scrap END AS plausible_ja FROM j"""
)
def japanese_reads(spark: SparkSession, d: str) -> DataFrame:
    """FLT4, FLT5, FLT35, AGG9: scraps, short names, points and plausibility of the blocks in Japanese mode."""
    t = F.col("text")
    kind = F.try_element_at("params", F.lit("kind"))
    b = load(spark, d, "tracked_block").withColumns({"noise": gates.is_noise(t), "scrap": lines.is_japanese_noise(t, KNOWN, NAMES)})
    scored = F.round(lines.japanese_score(t, F.col("conf") * 100, F.col("scrap"), NAMES), 4).alias("score")
    return b.select("row_id", "scrap", lines.is_short_name(t, NAMES).alias("name"), scored, lines.is_plausible(t, kind, False, F.col("noise"), F.col("scrap")).alias("plausible"), lines.is_plausible(t, kind, True, F.col("noise"), F.col("scrap"), ("TAP!", "NEW!")).alias("plausible_ja"))


@query(
    f"""SELECT entry_id, NOT regexp_matches(coalesce(source_text, ''), '{lines.CJK}') AND ({c.letters('source_text')} < 2 OR {c.in_script('source_text', 'cyrl')} * 2 > {c.letters('source_text')} OR ({c.in_script('source_text', 'cyrl')} * 2 = {c.letters('source_text')} AND regexp_matches(source_text, '^[^\\p{{L}}]*[Ѐ-ӿ]'))
      OR len(list_filter([{', '.join(c.in_script('source_text', s) for s in ('latn', 'cyrl', 'jpan', 'hang', 'hans', 'arab', 'hebr', 'deva', 'thai', 'grek'))}], lambda k: k * 2 >= {c.letters('source_text')})) = 0) AS as_is FROM translations"""
)
def kept_sources(spark: SparkSession, d: str) -> DataFrame:
    """FLT6: sources that a translation into Russian leaves as they are."""
    return load(spark, d, "translations").select("entry_id", lines.stays_as_is(F.col("source_text"), F.lit("ru")).alias("as_is"))


_n = f"greatest(1, length({_run}))"
_w, _h = "greatest(1, box.x2 - box.x1)", "greatest(1, box.y2 - box.y1)"
_budget, _pitch = f"greatest(12.0, {_h} * 1.45)", f"greatest(8, round_even(greatest(8.0, {_h}) * 0.7::DOUBLE, 0)::INT)"
_new = when(
    (f"{_w} >= {int(WIDTH * 0.47)} AND {_w} / {_n} > {_budget}", f"greatest(80, least({_w}, {_n} * {_pitch} + 48))"), (f"{_w} >= {int(WIDTH * 0.36)} AND {_n} <= 20 AND {_w} / {_n} > greatest(40.0, {_budget})", f"greatest(64, least({_w}, {_n} * greatest(10, {_pitch}) + 40))"),
    (f"{_n} <= 28 AND {_w} > greatest(220, floor({_n} * greatest(22.0, {_budget}) + 48))", f"greatest(56, least({_w}, {_n} * greatest(10, {_pitch}) + 40))"),
)
_gone = f"(({_n} <= 2 AND ({_w} > greatest(80.0, {WIDTH * 0.12}) OR {_h} > greatest(48.0, {HEIGHT * 0.08}))) OR ({_n} <= 4 AND {_w} * {_h} > {WIDTH * HEIGHT * 0.12}))"


@query(
    f"""WITH {TEXTS}, k AS (SELECT row_id, box, t0 = '' OR box IS NULL OR {_gone} AS gone, {_new} AS new FROM b)
    SELECT row_id, CASE WHEN NOT gone THEN CASE WHEN new IS NULL THEN box.x1 ELSE trunc((box.x1 + box.x2) / 2 - new / 2)::INT END END AS x1, CASE WHEN NOT gone THEN CASE WHEN new IS NULL THEN box.x2 ELSE trunc((box.x1 + box.x2) / 2 + new / 2)::INT END END AS x2 FROM k"""
)
def fitted_boxes(spark: SparkSession, d: str) -> DataFrame:
    """FLT38: boxes cut to what their texts can fill; impossible ones are null."""
    fitted = load(spark, d, "tracked_block").select("row_id", lines.fitted_box(F.col("text"), F.col("box"), WIDTH, HEIGHT).alias("b"))
    return fitted.select("row_id", F.col("b.x1").alias("x1"), F.col("b.x2").alias("x2"))


@query("SELECT session_id, id // 12 AS frame, coalesce(sum(length(trim(coalesce(text, '')))), 0) < 2 AS unusable FROM tracked_block WHERE id IS NOT NULL GROUP BY 1, 2")
def unusable_reads(spark: SparkSession, d: str) -> DataFrame:
    """FLT39: frames of which nothing was read."""
    return c._frames(spark, d).groupBy("session_id", "frame").agg(lines.unusable(F.col("text")).alias("unusable"))


_ws = r"regexp_extract_all(trim(coalesce(text, '')), '[^ \t\n\r\f\x0b]+')"
_wide = f"greatest(1, round_even(length(w) * (box.x2 - box.x1) / list_sum(list_transform({_ws}, lambda v: length(v))), 0)::INT)"


@query(
    f"""WITH a AS (SELECT row_id, box, {_ws} AS ws, list_transform({_ws}, lambda w: {_wide}) AS rooms FROM tracked_block WHERE box IS NOT NULL)
    SELECT row_id, CASE WHEN box.x2 > box.x1 THEN coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: coalesce(list_sum(rooms[1:i - 1]), 0) + rooms[i] // 2 < (box.x1 + box.x2) // 2 - box.x1), lambda i: ws[i]), ' '), '') ELSE '' END AS left_half FROM a"""
)
def left_halves(spark: SparkSession, d: str) -> DataFrame:
    """STR41: the words of each block that stand in the left half of its box."""
    b = load(spark, d, "tracked_block").where("box IS NOT NULL")
    x1, x2 = F.col("box.x1"), F.col("box.x2")
    return b.select("row_id", lines.words_in_range(F.col("text"), x1, x2, x1, F.floor((x1 + x2) / 2)).alias("left_half"))


_MARKED = "Map|Karte|карта"


@query(rf"""SELECT entry_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(source_text, ''), '(?i)[\s,.\-—]*\b(?:{_MARKED})\s*$', ''), '(?i)\b(?:{_MARKED})\b', '', 'g'), '\s{{2,}}', ' ', 'g'), '^[ ,.\-]+|[ ,.\-]+$', '', 'g') AS stripped FROM translations WHERE NOT regexp_matches(coalesce(source_text, ''), '[Ѐ-ӿ]')""")
def stripped_tails(spark: SparkSession, d: str) -> DataFrame:
    """STR12: sources without a mark, wherever it stands; texts in Cyrillic, whose word borders engines see differently, are left out."""
    rows = load(spark, d, "translations").where(~F.coalesce("source_text", F.lit("")).rlike("[Ѐ-ӿ]"))
    return rows.select("entry_id", lines.strip_tail(F.col("source_text"), _MARKED).alias("stripped"))


_pl = "string_split(coalesce(pt, ''), chr(10))"
_py = f"pb.y1 + (pb.y2 - pb.y1) * (i - 1) // len({_pl})"
_best = f"list_sort(list_transform(range(1, len({_pl}) + 1), lambda i: {{'d': abs({_py} - box.y1), 'k': i}}))[1].k"
_lf1, _lf2 = c._lf("text"), c._lf("best")
_len = f"greatest(12, floor(least(length({_lf1}), length({_lf2})) * 0.45)::INT)"


@query(
    f"""WITH v AS (SELECT row_id, text, box, pb, {_pl}[{_best}] AS best, pb.y1 + (pb.y2 - pb.y1) * ({_best} - 1) // len({_pl}) AS y1, pb.y1 + (pb.y2 - pb.y1) * {_best} // len({_pl}) AS y2 FROM {c._VERSIONS} WHERE pb IS NOT NULL AND box IS NOT NULL)
    SELECT row_id, coalesce(box.y1 BETWEEN y1 - 8 AND y2 + 8 AND {_lf1} <> '' AND {_lf2} <> '' AND length({_lf1}) >= {_len} AND length({_lf2}) >= {_len} AND substring({_lf1}, 1, {_len}) = substring({_lf2}, 1, {_len}), false) AS covered FROM v"""
)
def covered_lines(spark: SparkSession, d: str) -> DataFrame:
    """DED4: block versions that are a line of the version before, whose lines share its height evenly."""
    v = tracking.versions(load(spark, d, "tracked_block")).where("prev_box IS NOT NULL AND box IS NOT NULL")
    own = F.split(F.coalesce("prev_text", F.lit("")), "\n")
    at = lambda k: (F.col("prev_box.y1") + F.floor((F.col("prev_box.y2") - F.col("prev_box.y1")) * k / F.size(own))).cast("int")
    paragraph = F.transform(own, lambda x, k: F.struct(x.alias("key"), at(k).alias("y1"), at(k + 1).alias("y2")))
    return v.select("row_id", lines.inside_paragraph(F.col("text"), F.col("box.y1"), paragraph).alias("covered"))


# Speakers -------------------------------------------------------------------------------------

_sh, _sw = "greatest(1, a.box.y2 - a.box.y1)", "greatest(1, a.box.x2 - a.box.x1)"
SCORES = f"""{ROLES}, f AS (SELECT * FROM r WHERE box IS NOT NULL AND id IS NOT NULL),
  below AS (SELECT a.row_id, min(p.row_id) AS first, arg_min(p.box.y1 - a.box.y2, p.row_id) AS gap FROM f a JOIN f p ON a.session_id = p.session_id AND a.frame = p.frame AND (p.spoken0 OR p.role = 'dialogue') AND p.box.y1 >= a.box.y2 - 2 AND p.box.y1 - a.box.y2 <= greatest(48, {_sh} * 3) AND least(a.box.x2, p.box.x2) - greatest(a.box.x1, p.box.x1) > 0 GROUP BY 1),
  same AS (SELECT row_id, count(*) OVER (PARTITION BY session_id, frame, {c.fold('t0')}) - 1 AS repeats FROM f),
  s0 AS (SELECT a.row_id, a.session_id, a.frame, a.role, a.t0, b.gap IS NOT NULL AS under,
    CASE WHEN a.role = 'speaker' THEN 2.5 ELSE 0 END + CASE WHEN b.gap IS NULL THEN 0 ELSE 2.2 + CASE WHEN b.gap <= greatest(12, {_sh}) THEN 0.6 ELSE 0 END END + CASE WHEN {_sh} <= 32 AND {_sw} <= 280 THEN 0.7 ELSE 0 END + CASE WHEN {_sh} BETWEEN 10 AND 28 THEN 0.4 ELSE 0 END
    + least(1.2, 0.4 * s.repeats) + CASE WHEN coalesce(a.stable_passes, 0) >= 3 THEN 0.3 ELSE 0 END + CASE WHEN {_kind.replace('params', 'a.params')} IN ('name', 'speaker', 'chip') THEN 1.0 ELSE 0 END AS p
    FROM f a LEFT JOIN below b USING (row_id) JOIN same s USING (row_id)),
  s1 AS (SELECT *, CASE WHEN (len(regexp_extract_all(t0, '[^ \\t\\n\\r\\f\\x0b]+')) = 1 OR length(t0) < 12) AND p < 2.0 THEN p * 0.35::DOUBLE ELSE p::DOUBLE END AS q FROM s0),
  s2 AS (SELECT row_id, session_id, frame, CASE WHEN role = 'dialogue' THEN 0.0 WHEN NOT under AND role <> 'speaker' AND q < 2.5 THEN q * 0.5::DOUBLE ELSE q END AS score FROM s1)"""


@query(f"WITH {SCORES} SELECT row_id, round(score, 4)::DOUBLE AS score FROM s2")
def speaker_scores(spark: SparkSession, d: str) -> DataFrame:
    """JN23: how much each line looks like a speaker's name, from its frame."""
    return _speakers(spark, d).select("row_id", F.round("score", 4).alias("score"))


@query(f"WITH {SCORES} SELECT row_id, row_number() OVER (PARTITION BY session_id, frame ORDER BY round(score, 4) DESC, row_id) AS place FROM s2 WHERE round(score, 4) >= 2.2")
def detected_speakers(spark: SparkSession, d: str) -> DataFrame:
    """TOP5: the lines of each frame from a score of 2.2 on, the surest first."""
    return speakers.detect(_speakers(spark, d).withColumn("score", F.round("score", 4)), ["session_id", "frame"], "row_id").select("row_id", "place")


def _speakers(spark: SparkSession, d: str) -> DataFrame:
    b = c._frames(spark, d).where("box IS NOT NULL").withColumn("kind", F.try_element_at("params", F.lit("kind")))
    return speakers.score(b, ["session_id", "frame"], "row_id")


# Readings -------------------------------------------------------------------------------------

_ew = "regexp_extract_all(coalesce(source_text, ''), '[A-Za-z]{2,}')"
_rw = "regexp_extract_all(coalesce(source_text, ''), '[A-Za-z][A-Za-z''’-]*')"
_core = "regexp_replace(lower(w), '[''’]', '', 'g')"
_good = f"NOT ({_cnt('w', '[A-Z]')} > 1 AND w <> upper(w)) AND NOT regexp_matches(w, '[a-z][A-Z]') AND length({_core}) >= 3 AND regexp_matches({_core}, '[aeiouy]') AND NOT regexp_matches({_core}, '[bcdfghjklmnpqrstvwxz]{{4,}}')"
_az = "regexp_replace(lower(coalesce(source_text, '')), '[^a-z]', '', 'g')"
_impossible = f"len(list_filter(range(1, length({_az})), lambda i: substring({_az}, i::INT, 2) IN ({_list(text.IMPOSSIBLE_PAIRS)})))"
_k = r"regexp_replace(coalesce(source_text, ''), '[ \t\n\r\f\x0b]+', '', 'g')"
_echo = f"len(list_filter(range(1, length({_k})), lambda i: len(list_filter(range(3, 11), lambda l: i + 2 * l - 1 <= length({_k}) AND substring({_k}, i::INT, l::INT) = substring({_k}, (i + l)::INT, l::INT))) > 0)) > 0"


@query(
    rf"""SELECT memory_id, len(list_filter({_rw}, lambda w: {_good}))::INT AS real_words, (-CASE WHEN len({_ew}) > 0 THEN {_impossible} ELSE 0 END)::INT AS pairs, len(list_filter({_ew}, lambda w: regexp_matches(lower(w), '[aeiouy]')))::INT AS vowel_words, length(array_to_string({_ew}, ''))::INT AS letters,
      regexp_replace(regexp_replace({c.collapsed('source_text')}, '^[a-z0-9 .''\-]{{1,28}}:\s*', ''), '^[^:]{{1,20}}:\s*', '') AS body, CASE WHEN regexp_matches({_k}, '^[ぁ-ヿ]+$') THEN {_echo} ELSE false END AS furigana FROM memory"""
)
def reading_forms(spark: SparkSession, d: str) -> DataFrame:
    """STR16, STR20, STR22, STR26, FLT34, SIM17: words, quality, body and reading aids of the memory's sources."""
    t = F.col("source_text")
    q = text.reading_quality(t)
    return load(spark, d, "memory").select("memory_id", text.real_words(t).alias("real_words"), q["pairs"].alias("pairs"), q["vowel_words"].alias("vowel_words"), q["letters"].alias("letters"), text.body_form(t).alias("body"), gates.is_furigana(t).alias("furigana"))


_swaps = [p for s in labels.SWAPPED for p in (s, s[::-1])]


@query(
    f"""SELECT row_id, {c.compare('pt')} = {c.compare('text')} AS same, (x <> '' AND length(x) = length(y) AND len(list_filter(range(1, length(x) + 1), lambda i: substring(x, i::INT, 1) <> substring(y, i::INT, 1) AND substring(x, i::INT, 1) || substring(y, i::INT, 1) NOT IN ({_list(_swaps)}))) = 0) AS confusable
      FROM (SELECT *, trim(coalesce(pt, '')) AS x, trim(coalesce(text, '')) AS y FROM {c._VERSIONS} WHERE pr IS NOT NULL)"""
)
def reread_lines(spark: SparkSession, d: str) -> DataFrame:
    """FLT36, FLT45: whether two versions of a block are the same line, or differ in confusable characters only."""
    v = tracking.versions(load(spark, d, "tracked_block")).where("prev_row_id IS NOT NULL")
    return v.select("row_id", labels.same_line(F.col("prev_text"), F.col("text")).alias("same"), labels.are_confusable(F.col("prev_text"), F.col("text")).alias("confusable"))


@query(f"SELECT * FROM (SELECT entry_id, 1 AS n, {c.strip('source_text')} AS body FROM translations UNION ALL SELECT entry_id, 2, {c.strip('translated_text')} FROM translations) WHERE body <> ''")
def marked_parts(spark: SparkSession, d: str) -> DataFrame:
    """STR38: source and translation in one marked blob, taken apart again."""
    blob = F.concat(F.lit("PART1 "), F.coalesce("source_text", F.lit("")), F.lit("\nPART2 "), F.coalesce("translated_text", F.lit("")))
    return load(spark, d, "translations").select("entry_id", F.explode(text.parse_marked(blob)).alias("p")).select("entry_id", "p.n", "p.body")


@query("SELECT ordinal, coalesce(length(pack) BETWEEN 1 AND 64 AND pack NOT IN ('.', '..') AND regexp_matches(pack, '^[A-Za-z0-9][A-Za-z0-9._-]*$'), false) AS pack_safe, coalesce(length(source) BETWEEN 1 AND 64 AND regexp_matches(source, '^[A-Za-z0-9][A-Za-z0-9._-]*$'), false) AS source_safe FROM terms")
def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    """UDF9: which packs and sources may name a folder."""
    return load(spark, d, "terms").select("ordinal", labels.is_safe_id(F.col("pack")).alias("pack_safe"), labels.is_safe_id(F.col("source")).alias("source_safe"))


@query("SELECT row_id, box.x1 - 7 AS x1, box.y1 + 9 AS y1, (box.x2 - 7) // 2 AS half_x2, (box.y2 + 9) // 2 AS half_y2 FROM tracked_block WHERE box IS NOT NULL AND box.x2 >= 7")
def moved_boxes(spark: SparkSession, d: str) -> DataFrame:
    """WIN26, WIN27: boxes shifted, then halved."""
    b = boxes.moved(F.col("box"), -7, 9)
    half = boxes.scaled_down(b, 2)
    return load(spark, d, "tracked_block").where("box IS NOT NULL AND box.x2 >= 7").select("row_id", b["x1"].alias("x1"), b["y1"].alias("y1"), half["x2"].alias("half_x2"), half["y2"].alias("half_y2"))


_marks = r"[.!?…~*\-—–「」『』（）()\[\]{},:;]+"


@query(
    rf"""WITH a AS (SELECT entry_id, coalesce(source_text, '') AS s, regexp_replace(coalesce(source_text, ''), '[\s\x{{3000}}]+$', '') AS e FROM translations),
      k AS (SELECT entry_id, s, regexp_extract_all(e, '{_marks}') AS runs, regexp_matches(e, '^{_marks}') AS head, regexp_matches(e, '{_marks}$') AS tail FROM a)
    SELECT entry_id, array_to_string(CASE WHEN contains(s, '__MARK') THEN [] ELSE runs[CASE WHEN head THEN 2 ELSE 1 END:len(runs) - CASE WHEN tail THEN 1 ELSE 0 END] END, '|') AS taken FROM k"""
)
def taken_marks(spark: SparkSession, d: str) -> DataFrame:
    """PH5: the runs of inner punctuation that are taken out, in order."""
    return load(spark, d, "translations").select("entry_id", F.array_join(protect.protect_marks(F.col("source_text"))["taken"], "|").alias("taken"))


@query("SELECT entry_id, target_lang || ':' || upper(source_text) AS answer FROM translations WHERE source_text IS NOT NULL AND target_lang IS NOT NULL AND NOT regexp_matches(source_text, '[^\\x00-\\x7f]')".replace("\\\\", "\\"))
def backend_answers(spark: SparkSession, d: str) -> DataFrame:
    """UDF1: a backend called on batches of one language each."""
    rows = load(spark, d, "translations").where("source_text IS NOT NULL AND target_lang IS NOT NULL").where(~F.col("source_text").rlike(r"[^\x00-\x7f]"))
    requests = rows.select("entry_id", F.col("source_text").alias("text"), F.col("target_lang").alias("lang"))
    return batching.run_backend(requests, lambda texts, lang: [f"{lang}:{t.upper()}" for t in texts]).select("entry_id", "answer")
