"""Blocks across frames: change tests, dynamics, expiry, admission of results, matching."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from glyphmill.functions import boxes, text
from glyphmill.functions.scripts import text_or_empty

# Milliseconds of grace, the assumed cycle, and the thresholds of the dynamics classes.
GRACE_MS = {"dialogue": 500, "subtitle": 500, "hud": 1000, "transient": 300}
CYCLE_MS, LEAST_MISSES = 250, 2
STABLE_S, STABLE_FREQ, STABLE_POS, SLOW_S, SLOW_FREQ, DYNAMIC_FREQ, TRANSIENT_S = 8.0, 0.08, 0.75, 3.0, 0.25, 0.55, 2.0
# Thresholds of the re-read decision, of likeness, and of short texts.
MANY_DIRTY, LOW_MATCH, PERIOD_S = 8, 0.65, 5.0
LIKE, SHORT_TEXT, LEAST_CONF = 0.88, 8, 0.55


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two texts (asymmetric in rare cases); null counts as empty."""
    memo: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a.fillna(""), b.fillna("")):
        if (x, y) not in memo:
            memo[x, y] = 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
        out.append(memo[x, y])
    return pd.Series(out, dtype="float64")


def versions(blocks: DataFrame) -> DataFrame:
    """Each block version beside the previous one of the same block (``prev_*``); the first has none.

    The versions of one block are few; a session's size doesn't matter.
    """
    order = Window.partitionBy("session_id", "id").orderBy("content_revision", "received_at", "row_id")
    return blocks.withColumns({f"prev_{c}": F.lag(c).over(order) for c in ("row_id", "text", "norm", "script", "lang", "box", "content_revision")})


def word_change(a: Column, b: Column) -> Column:
    """Whether a word came or went; one short word amid at least five common ones doesn't count."""
    x, y = text.token_set(a), text.token_set(b)
    means = lambda w: (F.length(w) > 1) | w.rlike(r"^\p{N}$") | w.isin("a", "i")
    only_x, only_y = F.filter(F.array_except(x, y), means), F.filter(F.array_except(y, x), means)
    odd = F.size(only_x) + F.size(only_y)
    lonely = F.coalesce(F.get(F.concat(only_x, only_y), F.lit(0)), F.lit(""))
    minor = (F.size(F.array_intersect(x, y)) >= 5) & (odd == 1) & (F.length(lonely) <= 5)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), False).when((F.size(x) == 0) | (F.size(y) == 0), True).when(odd == 0, False).otherwise(~minor)


def shares_start(a: Column, b: Column) -> Column:
    """Two reads agree from the front over 45 % of the shorter one, at least 12 characters."""
    x, y = text.line_form(a), text.line_form(b)
    least = F.greatest(F.lit(12), F.floor(F.least(F.length(x), F.length(y)) * 0.45).cast("int"))
    return (x != "") & (y != "") & (F.length(x) >= least) & (F.length(y) >= least) & (F.substr(x, F.lit(1), least) == F.substr(y, F.lit(1), least))


def is_fragment(part: Column, whole: Column, least: int = 4) -> Column:
    """Whether one text is inside a longer one, by their compare forms."""
    x, y = text.compare_form(part), text.compare_form(whole)
    return (F.length(x) >= least) & (F.length(y) > F.length(x)) & F.contains(y, x)


def keys_alike(a: Column, b: Column, ratio: Column, threshold: float = LIKE) -> Column:
    """Equal collapsed forms, one inside the other where both are short, or a sequence ratio above the threshold."""
    x, y = text.collapsed_form(a), text.collapsed_form(b)
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    inside = (F.contains(x, y) | F.contains(y, x)) & (long_ <= 48) & (short >= 8) & (short >= 0.72 * long_) & ~x.contains("|") & ~y.contains("|")
    return F.when((x == "") & (y == ""), True).when((x == "") | (y == ""), False).otherwise((x == y) | inside | (ratio >= threshold))


def content_changed(old_text: Column, old_norm: Column, old_script: Column, new_text: Column, new_script: Column, conf: Column, alike: Column) -> Column:
    """Whether a block's content changed: marks alone, script, any change of a short text, an unsure read, or unlike keys."""
    new, old = text.compare_form(new_text), text_or_empty(old_norm)
    marks = text.mark_skeleton(old_text) != text.mark_skeleton(new_text)
    return (
        F.when(new == old, marks)
        .when(text_or_empty(old_script) != text_or_empty(new_script), True)
        .when((F.length(old) <= SHORT_TEXT) | (F.length(new) <= SHORT_TEXT), True)
        .when(F.coalesce(conf, F.lit(0.0)) < LEAST_CONF, True)
        .otherwise(~alike)
    )


def lifespan(first_seen: Column, last_seen: Column, now: Column) -> Column:
    """Seconds since the first sight, never negative."""
    origin = F.coalesce(first_seen, last_seen, now)
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(origin)) / 1e6)


def change_frequency(changes: Column, passes: Column) -> Column:
    return F.coalesce(changes, F.lit(0)) / F.greatest(F.lit(1), F.coalesce(passes, F.lit(0)))


def stability(drift: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.coalesce(drift, F.lit(0.0)) / 80.0)


def dynamics(life: Column, freq: Column, pos: Column, passes: Column) -> Column:
    """stable, slow, dynamic or transient, from lifespan, change frequency and position."""
    p = F.coalesce(passes, F.lit(0))
    seen = F.greatest(life, p * (CYCLE_MS / 1000.0))
    return (
        F.when((seen >= STABLE_S) & (freq <= STABLE_FREQ) & (pos >= STABLE_POS), "stable")
        .when((seen <= TRANSIENT_S) & ((freq >= 0.4) | (p <= 3)), "transient")
        .when((freq >= DYNAMIC_FREQ) | ((freq >= 0.35) & (pos < 0.5)), "dynamic")
        .when((seen >= SLOW_S) & (freq <= SLOW_FREQ), "slow")
        .when(freq >= 0.3, "dynamic")
        .when(seen < TRANSIENT_S, "transient")
        .otherwise("slow")
    )


def block_kind(kind: Column, body: Column) -> Column:
    """dialogue, subtitle, transient or hud."""
    k, low = F.lower(F.trim(text_or_empty(kind))), text.collapsed_form(body)
    toast = low.isin("pick up", "pickup") | low.rlike("^(obtained|acquired|picked up) ")
    return F.when(toast, "transient").when(k.isin("dialogue", "dialogue-line", "body"), "dialogue").when(k == "subtitle", "subtitle").when(k.isin("transient", "toast", "popup"), "transient").otherwise("hud")


def grace_ms(kind: Column, dyn: Column, passes: Column) -> Column:
    """Milliseconds a block may be missing; with four passes its dynamics count before its kind."""
    by_kind = F.when(kind == "dialogue", GRACE_MS["dialogue"]).when(kind == "subtitle", GRACE_MS["subtitle"]).when(kind == "transient", GRACE_MS["transient"]).otherwise(GRACE_MS["hud"])
    by_dyn = F.when(dyn == "transient", GRACE_MS["transient"]).when(dyn == "dynamic", GRACE_MS["dialogue"]).when(dyn == "stable", GRACE_MS["hud"])
    return F.when(F.coalesce(passes, F.lit(0)) >= 4, F.coalesce(by_dyn, by_kind)).otherwise(by_kind)


def removal_due(missing_passes: Column, missing_since: Column, grace: Column, now: Column) -> Column:
    """At least two misses, and as many as the grace has cycles or as long as the grace lasts."""
    misses = F.coalesce(missing_passes, F.lit(0))
    needed = F.greatest(F.lit(LEAST_MISSES), F.ceil(grace / CYCLE_MS))
    waited = F.coalesce((F.unix_micros(now) - F.unix_micros(missing_since)) / 1000.0 >= grace, F.lit(False))
    return (misses >= LEAST_MISSES) & ((misses >= needed) | waited)


def reread_reason(tracked: Column, scene_change: Column, dirty: Column, match_rate: Column, since_s: Column) -> Column:
    """Why a frame must be read again as a whole; null where it needn't."""
    return (
        F.when(tracked <= 0, "no_tracked")
        .when(scene_change, "scene_change")
        .when(dirty > MANY_DIRTY, "many_dirty")
        .when(match_rate < LOW_MATCH, "low_match")
        .when(since_s >= PERIOD_S, "periodic")
    )


def change_class(area: Column, tiles: Column, components: Column, mean_size: Column, edge: Column, persistence: Column) -> Column:
    """text, motion or unknown, from six features of a change."""
    motion = (
        (components <= 0)
        | ((persistence >= 3.0) & (area >= 0.02) & (components <= 1) & (mean_size < 30))
        | ((components == 1) & ((mean_size > 500) | (mean_size < 30)))
        | ((components > 15) & (mean_size < 50))
        | ((area >= 0.08) & (edge < 0.01) & (components <= 2))
    )
    words = ((components <= 10) & (mean_size > 30) & (edge >= 0.005)) | (components.between(2, 12) & (mean_size > 25) & (tiles <= 12))
    return F.when(motion, "motion").when(words, "text").otherwise("unknown")


def admit_results(results: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``current_revision`` and ``accepted``: a result is late when its block has a newer content revision by now.

    A block nobody tracks admits every result.
    """
    now = blocks.groupBy("session_id", F.col("id").alias("block_id")).agg(F.max("content_revision").alias("current_revision"))
    seen = results.join(now, ["session_id", "block_id"], "left")
    return seen.withColumn("accepted", F.col("current_revision").isNull() | (F.col("content_revision") == F.col("current_revision")))


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row of the highest version of each key."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*version)).alias("_x")).select(*key, "_x.*")


def match_frames(previous: DataFrame, lines: DataFrame, frame: list[str]) -> DataFrame:
    """Greedy one-to-one matching of the lines of a frame with the blocks before it, by score.

    Pairs are formed inside a frame only and pass the geometric gate in SQL; the
    greedy choice then runs over one frame's scored pairs at a time.
    Columns: frame, prev_id, line_id, score.
    """
    p = previous.select(*frame, F.col("id").alias("prev_id"), F.col("box").alias("pb"), F.col("lang").alias("pl"), F.col("text").alias("pt"))
    q = lines.select(*frame, F.col("id").alias("line_id"), F.col("box").alias("qb"), F.col("lang").alias("ql"), F.col("text").alias("qt"))
    pairs = p.join(q, frame).where(boxes.may_be_same(F.col("pb"), F.col("qb")))
    likeness = sequence_ratio(text.collapsed_form(F.col("pt")), text.collapsed_form(F.col("qt")))
    scored = pairs.withColumn("score", boxes.match_score(F.col("pb"), F.col("qb"), (F.col("pl") == F.col("ql")) & (F.col("pl") != ""), likeness)).select(*frame, "prev_id", "line_id", "score")

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "prev_id", "line_id"], ascending=[False, True, True])
        used_p, used_q, keep = set(), set(), []
        for k, (a, b) in enumerate(zip(part["prev_id"], part["line_id"])):
            if a not in used_p and b not in used_q:
                used_p.add(a)
                used_q.add(b)
                keep.append(k)
        return part.iloc[keep]

    return scored.groupBy(*frame).applyInPandas(greedy, scored.schema)
