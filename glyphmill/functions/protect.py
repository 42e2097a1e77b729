"""Reversible rewrites: paths, names and inner punctuation as tokens that survive a backend.

Each rewrite is a vectorised function from texts to a struct of the rewritten
text and what was taken out; its inverse is a fold of built-in replacements.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# The shapes of the tokens, and the characters of inner punctuation.
PATH_TOKEN, NAME_TOKEN, MARK_TOKEN = "\u3010{}\u250f\u3011", "ZZNAME{}ZZ", "__MARK{}__"
MARKS = r".!?…~*\-—–「」『』（）()\[\]{},:;"
_PATH = re.compile(r"(?<![\w./-])(?:~?/?(?:[\w.+-]+/)+[\w.+-]*|\.?[A-Za-z_][\w-]*(?:\.[A-Za-z][\w-]*)*\.[A-Za-z][A-Za-z0-9]{0,7})(?![\w/])")
_HOST = re.compile(r"^(?:www|https?)\.", re.I)
_RUN = re.compile(f"[{MARKS}]+")
_NAME = re.compile(r"[A-Z][\w’'-]*(?:[ \-'][A-Z][\w’'-]*)*")
_SCHEMA = StructType([StructField("text", StringType()), StructField("taken", ArrayType(StringType()))])


def take_paths(text: str | None) -> tuple[str, list[str]]:
    """The text with file paths and file names as tokens; hosts stay."""
    taken: list[str] = []

    def swap(m: re.Match) -> str:
        if _HOST.match(m[0]):
            return m[0]
        taken.append(m[0])
        return PATH_TOKEN.format(len(taken) - 1)

    whole = text or ""
    return (whole, []) if "\u250f" in whole else (_PATH.sub(swap, whole), taken)


def take_names(text: str | None, known: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """The text with capitalised runs as tokens; at the start of a sentence only known names count."""
    taken: list[str] = []
    whole = text or ""

    def swap(m: re.Match) -> str:
        before = whole[: m.start()].rstrip()
        opening = not before or before[-1] in ".!?:;。…"
        if len(m[0]) < 2 or (m[0].isupper() and len(m[0]) > 1) or (opening and not (m[0] in known or set(m[0].split()) & known)):
            return m[0]
        taken.append(m[0])
        return NAME_TOKEN.format(len(taken) - 1)

    return (whole, []) if "ZZNAME" in whole else (_NAME.sub(swap, whole), taken)


def take_marks(text: str | None) -> tuple[str, list[str]]:
    """The text with its inner punctuation runs as tokens; runs at the edges stay, and a text with such a token stays whole."""
    whole = text or ""
    end = len(whole.rstrip())
    taken: list[str] = []

    def swap(m: re.Match) -> str:
        if m.start() == 0 or m.end() >= end:
            return m[0]
        taken.append(m[0])
        return MARK_TOKEN.format(len(taken) - 1)

    return (whole, []) if "__MARK" in whole else (_RUN.sub(swap, whole), taken)


def _vectorised(rule):
    @F.pandas_udf(_SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule(t) for t in texts], columns=["text", "taken"])

    return run


def protect_paths(text: Column) -> Column:
    return _vectorised(take_paths)(text)


def protect_marks(text: Column) -> Column:
    return _vectorised(take_marks)(text)


def protect_names(text: Column, known: frozenset[str] = frozenset()) -> Column:
    return _vectorised(lambda t: take_names(t, known))(text)


def _token(shape: str, k: Column) -> Column:
    head, tail = shape.split("{}")
    return F.concat(F.lit(head), k.cast("string"), F.lit(tail))


def restore(text: Column, taken: Column, shape: str) -> Column:
    """Puts what was taken out back, in order."""
    both = F.transform(taken, lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    return F.aggregate(both, F.coalesce(text, F.lit("")), lambda t, p: F.replace(t, _token(shape, p["k"]), p["x"]))


def survived(text: Column, taken: Column, shape: str) -> Column:
    """Whether every token is still in the text."""
    return F.forall(F.transform(taken, lambda x, k: k), lambda k: F.contains(F.coalesce(text, F.lit("")), _token(shape, k)))
