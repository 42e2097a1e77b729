"""Script and language profiling as Column expressions.

Null texts count as empty. Nothing here leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter ranges of the scripts, in the order in which ties are decided.
SCRIPTS = {
    "latn": r"A-Za-zÀ-ɏ",
    "cyrl": r"Ѐ-ӿ",
    "jpan": r"぀-ヿ",
    "hang": r"가-힣ᄀ-ᇿ",
    "arab": r"؀-ۿݐ-ݿ",
    "hebr": r"֐-׿",
    "deva": r"ऀ-ॿ",
    "thai": r"฀-๿",
    "hans": r"㐀-䶿一-鿿",
    "grek": r"Ͱ-Ͽἀ-῿",
}
# The script of each language.
SCRIPT_OF_LANG = {
    **dict.fromkeys(("ru", "uk", "bg", "sr", "mk"), "cyrl"),
    **dict.fromkeys(("en", "fr", "de", "es", "pt", "it", "nl", "pl", "tr", "id", "vi", "ro", "sv", "no", "da", "fi", "cs", "hu"), "latn"),
    **dict.fromkeys(("ar", "fa", "ur"), "arab"), **dict.fromkeys(("hi", "mr", "ne"), "deva"),
    "ja": "jpan", "zh": "hans", "zh-cn": "hans", "zh-tw": "hans", "ko": "hang", "he": "hebr", "th": "thai", "el": "grek",
}
# The language that stands for a script; Latin stands for none.
CODE_FOR_SCRIPT = {"cyrl": "ru", "jpan": "ja", "hang": "ko", "hans": "zh"}
LEAST_LETTERS, TARGET_SHARE, MOSTLY_SHARE = 3, 0.25, 0.72
KANA, HAN, HANGUL, LATIN, CYRILLIC = r"[ぁ-ゖァ-ヺー]", r"[一-鿿々〆]", r"[가-힯ᄀ-ᇿ㄰-㆏]", "[A-Za-z]", r"[Ѐ-ӿ]"
CHINESE_MARKS = r"[，。；：？！、《》【】“”‘’]"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def count(text: Column, pattern: str) -> Column:
    """Matches of a pattern; 0 in a null text."""
    return F.regexp_count(text_or_empty(text), F.lit(pattern))


def letter_count(text: Column) -> Column:
    return count(text, r"\p{L}")


def share_in_script(text: Column, script: str) -> Column:
    """Share of a text's letters in a script; 0 without letters, and for an unknown script."""
    body = SCRIPTS.get("hans" if script == "hant" else script)
    if body is None:
        return F.lit(0.0)
    n = letter_count(text)
    return F.when(n > 0, count(text, f"[{body}&&\\p{{L}}]") / n).otherwise(0.0)


def dominant_script(text: Column) -> Column:
    """The script of at least half of the letters; of two equal ones the one that comes first in the text."""
    n = letter_count(text)
    found = F.array(*(F.struct(count(text, f"[{b}&&\\p{{L}}]").alias("k"), (-F.regexp_instr(text_or_empty(text), F.lit(f"[{b}&&\\p{{L}}]"))).alias("at"), F.lit(s).alias("s")) for s, b in SCRIPTS.items()))
    best = F.array_max(F.filter(found, lambda x: x["k"] > 0))
    return F.when(best["k"] * 2 >= n, best["s"])


def script_of(lang: Column) -> Column:
    """Script of a language code; null for an unknown language."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in SCRIPT_OF_LANG.items() for x in kv)), F.lower(F.trim(text_or_empty(lang))))


def code_for_script(script: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in CODE_FOR_SCRIPT.items() for x in kv)), script)


def is_in_target_script(text: Column, lang: Column, least_letters: int = LEAST_LETTERS, least_share: float = TARGET_SHARE) -> Column:
    """Whether enough of a text is in the script of a language; false for an unknown language."""
    own = script_of(lang)
    share = reduce(lambda rest, s: F.when(own == s, share_in_script(text, s)).otherwise(rest), SCRIPTS, F.lit(0.0))
    return own.isNotNull() & (letter_count(text) >= least_letters) & (share >= least_share)


def is_mostly(text: Column, script: str, least: float = MOSTLY_SHARE, least_letters: int = 1) -> Column:
    return (letter_count(text) >= least_letters) & (share_in_script(text, script) >= least)


def detect_lang(text: Column, chinese_only: str = "") -> Column:
    """Best-effort language by script.

    Kana decides for Japanese, Chinese punctuation for Chinese, then hangul,
    Cyrillic, Han and Latin by their shares. Curly quotes count as Chinese
    punctuation. ``chinese_only`` may hold characters that only Chinese has;
    Han text with none of them counts as Japanese.
    """
    t, n = text_or_empty(text), letter_count(text)
    han = count(text, r"[一-鿿]")
    hits = count(text, f"[{chinese_only}]") if chinese_only else F.lit(0)
    chinese = (hits > 0) & ((han <= 6) | (hits * 2 >= han))
    return (
        F.when(t.rlike(r"[぀-ヿ]"), "ja")
        .when(t.rlike(CHINESE_MARKS), "zh-CN")
        .when(n < 2, None)
        .when(t.rlike(HANGUL), "ko")
        .when(count(text, CYRILLIC) > 0.3 * n, "ru")
        .when((han > 0.3 * n) & (count(text, LATIN) < 0.2 * n), F.when(chinese, "zh-CN").otherwise("ja"))
        .when(count(text, LATIN) > 0.6 * n, "en")
    )


def block_script(text: Column) -> Column:
    """en, ja, mixed, target (Cyrillic) or unknown, by counts."""
    kana, han, latin, cyr = count(text, KANA), count(text, HAN), count(text, LATIN), count(text, CYRILLIC)
    return (
        F.when(kana >= 1, F.when(latin >= 3, "mixed").otherwise("ja"))
        .when((han >= 1) & (latin >= 3), "mixed")
        .when(han >= 2, "ja")
        .when((cyr >= 2) & (latin == 0), "target")
        .when(latin >= 2, "en")
        .when(cyr >= 1, "target")
        .otherwise("unknown")
    )


def block_lang(text: Column, target_lang: str = "ru") -> Column:
    """Source language of one block; Han alone is undecided, Cyrillic counts as the target language."""
    kana, han, latin, cyr = count(text, KANA), count(text, HAN), count(text, LATIN), count(text, CYRILLIC)
    return (
        F.when(F.trim(text_or_empty(text)) == "", "")
        .when(kana >= 1, "ja")
        .when(count(text, HANGUL) >= 1, "ko")
        .when(han >= 1, "auto")
        .when((cyr >= 1) & (latin < 2), target_lang)
        .when(latin >= 2, "en")
        .when(cyr >= 1, target_lang)
        .otherwise("auto")
    )


def is_japanese_block(text: Column) -> Column:
    return (count(text, KANA) >= 1) | ((count(text, HAN) >= 1) & (count(text, LATIN) < 3))


def block_source_lang(lang: Column, script: Column) -> Column:
    """The block's own language, else one from its script."""
    by_script = F.when(script == "ja", "ja").when(script == "en", "en").otherwise("auto")
    return F.coalesce(F.nullif(F.trim(text_or_empty(lang)), F.lit("")), by_script)


def ratio(text: Column, pattern: str) -> Column:
    """Share of a pattern among the characters that aren't blanks."""
    n = F.length(F.replace(text_or_empty(text), F.lit(" "), F.lit("")))
    return F.when(n > 0, count(text, pattern) / n).otherwise(0.0)
