"""SQL for DuckDB that gives the rows of the training-data queries that SQL can express."""

from __future__ import annotations

_SIGNS = (r"\x1f", r"\|\|", r"\|", "::", r"\t")
_LANG = r"(?:[A-Za-z]{2,3}(?:[-_][A-Za-z0-9]{2,4})?|auto|AUTO|unknown|UNKNOWN)?"
_TARGET = r"[A-Za-z]{2,3}(?:[-_][A-Za-z0-9]{2,4})?"
_PAD = r"[ \t\r\n]*"


def _canonical(col: str) -> str:
    spaced = rf"(' ' || trim(regexp_replace(replace(lower({col}), 'ß', 'ss'), '[\p{{P}}\p{{S}}\p{{Z}}\s\x0b\x00-\x1f]+', ' ', 'g')))"
    stat = r"^(.*?)((?: \p{L}[\p{L}\p{M}]*? ?\d+){2,}) ?$"
    fields = rf"array_to_string(list_sort(regexp_extract_all(regexp_extract({spaced}, '{stat}', 2), ' (\p{{L}}[\p{{L}}\p{{M}}]*? ?\d+)', 1)), chr(29))"
    return rf"CASE WHEN regexp_matches({spaced}, '\d ?$') AND regexp_matches({spaced}, '{stat}') THEN replace(regexp_extract({spaced}, '{stat}', 1), ' ', '') || chr(30) || replace({fields}, ' ', '') ELSE replace({spaced}, ' ', '') END"


def _forms() -> list[tuple[str, int, int, int]]:
    gap = r"[ \r\n]*"
    out = []
    out += [(rf"(?s)^{_PAD}({_LANG}){gap}{s}{gap}({_TARGET}){gap}{s}(.*)$", 1, 2, 3) for s in _SIGNS]
    out += [(rf"(?s)^{_PAD}({_LANG}){gap}{s}(.*){s}{gap}({_TARGET}){_PAD}$", 1, 3, 2) for s in _SIGNS]
    out += [(rf"(?s)^(.*?){s}{gap}({_LANG}){gap}{s}{gap}({_TARGET}){_PAD}$", 2, 3, 1) for s in _SIGNS]
    return out


def _key_part(which: int, other: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(cache_key, '{f[0]}') THEN regexp_extract(cache_key, '{f[0]}', {f[which]})" for f in _forms())
    return f"CASE {cases} ELSE {other} END"


_BARE = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_MEMORY_KEY = f"coalesce(source_lang, chr(0)) || chr(31) || coalesce(target_lang, chr(0)) || chr(31) || {_canonical('source_text')}"
_PRINTS = f"""prints AS (
  SELECT 'memory' AS tbl, memory_id AS row_id, {_MEMORY_KEY} AS k FROM memory WHERE source_text IS NOT NULL
  UNION ALL SELECT 'translations', entry_id, {_BARE.format('src')} || chr(31) || {_BARE.format('tgt')} || chr(31) || {_canonical('body')}
  FROM (SELECT entry_id, {_key_part(1, "''")} AS src, {_key_part(2, "''")} AS tgt, {_key_part(3, 'cache_key')} AS body FROM translations WHERE cache_key IS NOT NULL))"""

P3_FOUND = f"""WITH {_PRINTS}, g AS (SELECT tbl, k, min(row_id) AS kept_id FROM prints GROUP BY 1, 2)
SELECT p.tbl, g.kept_id, p.row_id AS copy_id FROM prints p JOIN g ON p.tbl = g.tbl AND p.k = g.k WHERE p.row_id <> g.kept_id"""
P3_RECORDS = f"WITH {_PRINTS} SELECT tbl, min(row_id) AS kept_id, count(*) - 1 AS n_copies FROM prints GROUP BY tbl, k"
P3_COLLISIONS = f"WITH {_PRINTS} SELECT tbl, count(DISTINCT k) AS n_records, count(DISTINCT md5(k)) AS n_hashes, count(DISTINCT k) - count(DISTINCT md5(k)) AS n_collisions FROM prints GROUP BY tbl"

_WORDS = r"regexp_extract_all(replace(lower(txt), 'ß', 'ss'), '[\p{L}\p{N}]+')"
_SETS = f"""WITH sides AS (
  SELECT memory_id AS id, {_MEMORY_KEY} AS g, 0 AS side, source_lang || chr(31) || target_lang AS pair, source_lang AS lang, source_text AS txt FROM memory WHERE source_text IS NOT NULL
  UNION ALL SELECT memory_id, coalesce({_MEMORY_KEY}, memory_id::VARCHAR), 1, source_lang || chr(31) || target_lang, target_lang, translated_text FROM memory WHERE translated_text IS NOT NULL),
worded AS (SELECT *, {_WORDS} AS ws, array_to_string({_WORDS}, '') AS joined FROM sides),
sets AS (SELECT id, g, side, pair, CASE WHEN lang IN ('ja', 'zh') THEN list_distinct(list_transform(range(1, length(joined)), lambda i: substring(joined, i::INT, 2))) ELSE list_distinct(ws) END AS items FROM worded)"""
P1_FOUND = f"""{_SETS},
flat AS (SELECT id, g, side, pair, len(items) AS n, unnest(items) AS item FROM sets),
shared AS (SELECT a.id AS a, b.id AS b, a.side, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM flat a JOIN flat b ON a.side = b.side AND a.pair = b.pair AND a.item = b.item AND a.id < b.id WHERE a.g <> b.g GROUP BY 1, 2, 3)
SELECT DISTINCT a AS memory_id_a, b AS memory_id_b FROM shared WHERE k >= 0.73 * (na + nb - k) - 1e-9"""

P1_LINKS = f"""{_SETS},
classes AS (SELECT min(id) AS class_id, count(*) AS n_rows, side, pair, list_sort(items) AS items FROM sets WHERE len(items) > 0 GROUP BY side, pair, list_sort(items)),
keyed AS (SELECT *, row_number() OVER () AS k FROM classes),
flat AS (SELECT k, side, pair, len(items) AS n, unnest(items) AS item FROM keyed),
shared AS (SELECT a.k AS a, b.k AS b FROM flat a JOIN flat b ON a.side = b.side AND a.pair = b.pair AND a.item = b.item AND a.k <> b.k GROUP BY 1, 2 HAVING count(*) >= 0.73 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9)
SELECT class_id, n_rows, count(b) AS n_links FROM keyed LEFT JOIN shared ON k = a GROUP BY k, class_id, n_rows"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_links": P1_LINKS, "p3_found": P3_FOUND, "p3_records": P3_RECORDS, "p3_collisions": P3_COLLISIONS}
