"""Prioritised dictionaries and rules: loading, exact look-up, rule rewriting, the fallback chain."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import gates
from glyphmill.functions.scripts import text_or_empty

# The rank of each scope, and the longest pattern of a rule.
SCOPE_RANK = {"user": 4, "profile": 3, "game": 2, "global": 1}
LONGEST_PATTERN = 200
_NESTED = re.compile(r"\([^()]*[+*][^()]*\)[+*{]")
_CJK, _LATIN = "[぀-ヿ㐀-鿿豈-﫿]", "[A-Za-z]"
#: Rows of a term table up to which it goes to every executor; beyond it the join shuffles.
BROADCAST_TERMS = 200_000


def scope_rank(scope: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SCOPE_RANK.items() for x in kv)), scope), F.lit(0))


def distinct_terms(terms: DataFrame) -> DataFrame:
    """Terms distinct on (source, scope, pack, sorted flags); the first by ordinal wins. Null priority counts as 0, null scope as global."""
    keyed = terms.withColumns({"scope": F.coalesce("scope", F.lit("global")), "priority": F.coalesce("priority", F.lit(0)), "_flags": F.array_join(F.array_sort(F.array_distinct(F.coalesce("flags", F.array().cast("array<string>")))), ",")})
    first = Window.partitionBy("source", "scope", "pack", "_flags").orderBy("ordinal")
    return keyed.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_flags")


def admitted(scope: Column, pack: Column, game: str | None, game_on: bool) -> Column:
    """Whether a term or rule of a scope counts: user and global ones always, profile ones in a game, game ones in their game."""
    in_game = (pack == game) if game else F.lit(game_on)
    return scope.isin("user", "global") | ((scope == "profile") & F.lit(game_on)) | ((scope == "game") & F.coalesce(in_game, F.lit(False)))


def winners(terms: DataFrame, game: str | None = None, game_on: bool = False) -> DataFrame:
    """``(source, target, pack)``: the term that wins for each source, by scope rank, priority and load order.

    Terms without a target and those that keep their source don't count.
    """
    usable = terms.where((text_or_empty(F.col("target")) != "") & (F.col("target") != F.col("source"))).where(admitted(F.col("scope"), F.col("pack"), game, game_on))
    order = F.struct(scope_rank(F.col("scope")).alias("r"), F.coalesce("priority", F.lit(0)).alias("p"), (-F.col("ordinal")).alias("o"))
    return usable.groupBy("source").agg(F.max_by(F.struct("target", "pack"), order).alias("w")).select("source", "w.target", "w.pack")


def look_up(texts: DataFrame, text_col: str, terms: DataFrame, game: str | None = None, game_on: bool = False) -> DataFrame:
    """Adds ``target`` and ``pack`` of the winning term; null without one.

    The winners go to every executor only while their number is below
    BROADCAST_TERMS; a larger dictionary is joined by a shuffle on the source.
    """
    won = winners(terms, game, game_on).withColumnRenamed("source", "_source")
    size = won.limit(BROADCAST_TERMS + 1).count()
    side = F.broadcast(won) if size <= BROADCAST_TERMS else won
    return texts.join(side, texts[text_col] == side["_source"], "left").drop("_source")


@dataclass(frozen=True)
class Rule:
    """A rewriting rule with a Java pattern and ``$1`` references."""

    pattern: str
    replacement: str
    scope: str = "global"
    priority: int = 0
    pack: str = "core"


def check_pattern(pattern: str | None) -> str:
    """The pattern, or a ValueError for an empty, overlong, explosive or malformed one."""
    text = (pattern or "").strip()
    if not text or len(text) > LONGEST_PATTERN or _NESTED.search(text):
        raise ValueError(f"refused pattern {text[:60]!r}")
    try:
        re.compile(text)
    except re.error as e:
        raise ValueError(f"malformed pattern {text[:60]!r}: {e}") from e
    return text


def rewrite(text: Column, rules: list[Rule], game: str | None = None, game_on: bool = False) -> Column:
    """One substitution by the first rule, in the order of rank, priority and pattern, that changes the text; else null.

    A Latin rule skips text in CJK without Latin, and the reverse. The rules
    form one CASE expression, so no join multiplies the rows.
    """
    t = F.trim(text_or_empty(text))
    out = None
    for r in sorted(rules, key=lambda r: (SCOPE_RANK.get(r.scope, 0), r.priority, r.pattern), reverse=True):
        if r.scope not in SCOPE_RANK or (r.scope == "profile" and not game_on) or (r.scope == "game" and (r.pack != game if game else not game_on)):
            continue
        cjk, latin = bool(re.search(_CJK, r.pattern)), bool(re.search(_LATIN, re.sub(r"\\[a-zA-Z]", "", r.pattern)))
        fits = t.rlike(r.pattern)
        if latin and not cjk:
            fits = fits & ~(t.rlike(_CJK) & ~t.rlike(_LATIN))
        if cjk and not latin:
            fits = fits & ~(t.rlike(_LATIN) & ~t.rlike(_CJK))
        # only the first match is replaced: the rest of the text is captured and put back
        new = F.regexp_replace(t, rf"(?s)^(?<pre>.*?)(?:{r.pattern})(?<post>.*)$", "${pre}" + _shift(r.replacement) + "${post}") if not r.pattern.startswith("^") else F.regexp_replace(t, r.pattern, r.replacement)
        fits = fits & (new != "") & (new != t)
        out = F.when(fits, new) if out is None else out.when(fits, new)
    return F.lit(None).cast("string") if out is None else out


def _shift(replacement: str) -> str:
    """Group numbers after one more group in front."""
    return re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}", replacement)


def cascade(texts: DataFrame, text_col: str, user: DataFrame, terms: DataFrame, rules: list[Rule], level_word: str, game: str | None = None, game_on: bool = False) -> DataFrame:
    """Adds ``resolved`` and ``step``: user map, lexicon, rules, ``term number`` with a known term, number shapes.

    ``user`` has (source, target); an empty target is a miss.
    """
    own = user.where(text_or_empty(F.col("target")) != "").groupBy("source").agg(F.min("target").alias("_user")).withColumnRenamed("source", "_us")
    base = texts.join(own, texts[text_col] == own["_us"], "left").drop("_us")
    named = look_up(base, text_col, terms, game, game_on).withColumnRenamed("target", "_term").drop("pack")
    head = F.regexp_extract(text_or_empty(F.col(text_col)), r"^(.+?)\s+(\d[\d.,/:]*)$", 1)
    named = look_up(named.withColumn("_head", head), "_head", terms, game, game_on).withColumnRenamed("target", "_known").drop("pack")
    number = F.regexp_extract(text_or_empty(F.col(text_col)), r"^(.+?)\s+(\d[\d.,/:]*)$", 2)
    steps = [
        ("user", F.col("_user")),
        ("lexicon", F.col("_term")),
        ("rule", rewrite(F.col(text_col), rules, game, game_on)),
        ("term_number", F.when(F.col("_known").isNotNull(), F.concat("_known", F.lit(" "), number))),
        ("number", gates.numeric_guard(F.col(text_col), F.lit(level_word))),
    ]
    step = F.lit(None).cast("string")
    for name, c in reversed(steps):
        step = F.when(c.isNotNull(), name).otherwise(step)
    return named.withColumn("resolved", F.coalesce(*(c for _, c in steps))).withColumn("step", step).drop("_user", "_term", "_head", "_known")


def term_groups(terms: DataFrame) -> DataFrame:
    """``(flag, surface)``: the distinct sources of each flag."""
    return terms.select(F.explode("flags").alias("flag"), F.col("source").alias("surface")).where("surface IS NOT NULL AND surface <> ''").distinct()
