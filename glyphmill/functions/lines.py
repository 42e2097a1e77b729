"""What a line of a screen is: residue of recognition, window furniture, choices, panel text, names.

Vocabularies are parameters. The defaults are empty or the few values that
results depend on, so that a program's own words come from its term tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import gates, labels
from glyphmill.functions.scripts import count, dominant_script, script_of, text_or_empty

JAPANESE, CJK, HAN, KANA = "[぀-ヿ㐀-鿿]", "[぀-ヿ㐀-鿿豈-﫿가-힯]", "[一-鿿]", "[぀-ヿ]"
# Particles and endings that Japanese sentences have, and the signs of lengthening.
PARTICLES = ("は", "が", "を", "に", "の", "です", "ます", "か", "よ", "ね", "だ", "な", "も", "と", "で", "から", "して", "って", "けど", "ない", "た", "て", "へ", "ご", "お")
COMMANDS = ("Confirm", "Cancel", "Back", "Next", "Skip", "Close", "Accept", "Decline")
_VOWEL, _LONG = "[aeiouyAEIOUY]", "[ー―一]"


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(text), r"\s+", " "))


def _compact(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), r"\s+", "")


def _any_of(t: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in the text."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)) if words else F.lit(False)


def _among(t: Column, words: tuple[str, ...]) -> Column:
    return t.isin(*words) if words else F.lit(False)


def strip_tail(text: Column, mark: str) -> Column:
    """The text without a watermark: runs of ``mark``, a pattern, go wherever they stand, and loose marks at the edges with them."""
    bare = F.regexp_replace(F.regexp_replace(text_or_empty(text), rf"(?i)[\s,.\-—]*\b(?:{mark})\s*$", ""), rf"(?i)\b(?:{mark})\b", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s{2,}", " "), r"^[ ,.\-]+|[ ,.\-]+$", "")


def is_junk_line(text: Column, box: Column | None = None, width: int = 0, height: int = 0, mark: str | None = None) -> Column:
    """A watermark or an empty plate: nothing, letters without vowels, or a plate far larger than its text. A null box has no shape."""
    t = one_line(text)
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    n, vowels = F.length(letters), count(letters, _VOWEL)
    solid = n.between(3, 18) & ~t.contains(" ") & ((letters.rlike("^[A-Z]+$") & (vowels <= F.greatest(F.lit(1), F.floor(n / 5)))) | ((n >= 5) & (vowels < 0.18 * n)))
    junk = (t == "") | solid
    if mark:
        junk = junk | t.rlike(f"(?i)(?:{mark})")
    if box is not None and width > 0 and height > 0:
        w, h = F.greatest(F.lit(0), box["x2"] - box["x1"]), F.greatest(F.lit(0), box["y2"] - box["y1"])
        plate = ((w >= int(width * 0.72)) & (box["y2"] >= int(height * 0.94)) & (n < 28)) | ((w >= int(width * 0.85)) & (n <= 14)) | ((h >= 55) & (n < 20))
        junk = junk | F.coalesce(plate & ~gates.is_spoken_line(t), F.lit(False))
    return junk


def is_window_text(text: Column, needles: tuple[str, ...] = (), kept: str | None = None, titles: tuple[str, ...] = ()) -> Column:
    """Text of the windows around the content: needles, paths, a run of letters without vowels, a long title in capitals.

    ``kept`` is a pattern of runs that are none; ``titles`` are words of capital titles.
    """
    t = F.trim(text_or_empty(text))
    low, run = F.lower(t), _compact(text)
    solid = run.rlike("^[A-Za-z]$") & F.length(run).between(5, 14) & (count(F.lower(run), "[aeiouy]") <= 1)
    if kept:
        solid = solid & ~low.rlike(kept)
    banner = (F.length(t) >= 36) & (t == F.upper(t)) & (t != low) & t.contains(" ") & (count(t, r"\p{L}") >= 24) & _any_of(low, titles)
    return _any_of(low, needles) | t.rlike(r"/home/\w+/Pictures") | t.rlike(r"→\s*/") | solid | banner


def is_known_phrase(text: Column, openings: tuple[str, ...] = (), shapes: tuple[str, ...] = (), whole: tuple[str, ...] = ()) -> Column:
    """A line that the noise filter must leave alone: by its opening words, by a pattern in it, or as a whole."""
    t = one_line(text)
    known = _among(F.lower(t), whole)
    if openings:
        known = known | t.rlike(rf"(?i)^({'|'.join(openings)})\b")
    for s in shapes:
        known = known | t.rlike(f"(?i){s}")
    return known


def is_choice(text: Column, noise: Column, window: Column, echo: Column | None = None) -> Column:
    """A reply to choose: a command, a key in brackets, or two to eight words from a capital on. ``noise`` and ``window`` are the text's own."""
    t = one_line(text)
    words = F.size(F.regexp_extract_all(t, F.lit("[A-Za-z']+"), F.lit(0)))
    no = gates.is_spoken_line(t) | gates.is_hud_spam(t) | window | noise | is_junk_line(t)
    if echo is not None:
        no = no | echo
    shaped = (count(t, "[A-Za-z]") >= 8) & words.between(2, 8) & t.rlike(r"^\p{Lu}") & ~(t.rlike(r"(\.\.\.|…)$") & (F.length(t) > 50))
    command = t.rlike(rf"(?i)^(\[[^\]]{{1,6}}\]\s*)?({'|'.join(COMMANDS)})\b") | t.rlike(r"(?i)^\[[A-Z0-9x]\]\s+\S")
    return F.length(t).between(5, 80) & ~no & (command | shaped)


def continues_speech(text: Column, noise: Column, window: Column) -> Column:
    """A further line of speech, without a name: letters enough, no lone capitalised word."""
    t = F.trim(text_or_empty(text))
    latin = count(t, "[A-Za-z]")
    lone = (latin <= 12) & t.rlike(r"^\p{Lu}[^\p{Lu}\s]*$") & ~t.rlike("[.!?,]$")
    no = gates.is_spoken_line(t) | is_junk_line(t) | gates.is_hud_spam(t) | window | noise
    glued = (latin >= 18) & (F.regexp_count(t, F.lit(" ")) <= 2)
    return (F.length(t) >= 4) & ~no & (latin >= 4) & (glued | ~lone)


def is_screen_line(text: Column, noise: Column, window: Column, known: Column) -> Column:
    """Any readable line of a screen; no short codes, fractions and levels."""
    t = one_line(text)
    cjk = count(t, CJK)
    letters = count(t, "[A-Za-z]") + count(t, "[Ѐ-ӿ]") + cjk
    code = t.rlike(r"^[A-Z]{1,3}$") | t.rlike(r"^\d+(/\d+)?$") | t.rlike(r"(?i)^Lv\.?\s*\d+[O0]?$")
    plain = ~noise & ((letters >= 4) | (cjk >= 2)) & ~code
    return (F.length(t) >= 3) & ~gates.is_hud_spam(t) & ~window & (gates.is_spoken_line(t) | known | plain)


def is_panel_text(text: Column, choice: Column, words: str) -> Column:
    """A line of a panel's description: long enough, no prompt, header or choice, and a sentence's middle, one of ``words``, or 36 characters."""
    t = one_line(text)
    header = labels.is_section_header(t)
    named = gates.is_spoken_line(t) & t.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?:")
    label = t.rlike(r"^[A-Z][\w'-]*(?:\s+[\w'-]+){0,3}:$")
    body = t.rlike(r"^\p{Ll}") | t.rlike(rf"(?i)\b({words})\b") | (F.length(t) >= 36)
    return (F.length(t) >= 18) & ~labels.is_ui_prompt(t) & ~header & ~choice & ~named & ~label & body


def is_copy_junk(text: Column, noise: Column, window: Column, allow_cjk: bool) -> Column:
    """What a copied screen holds besides text: icons, ages, counters; words of code are none."""
    t = F.trim(text_or_empty(text))
    n = F.greatest(count(t, r"\p{L}"), F.lit(1))
    icons = t.rlike(r"^[①-⓿■-◿　-〿\s]+$") | t.rlike(r"(?i)^Edited(\s+\d+)?$") | t.rlike(r"^[+＋]?\s*[\d①-⑳]+(\s*[-–]\s*[\d①-⑳]+)?$")
    ages = t.rlike(r"(?i)^[□■▪▫◉●○]\s*\d*\s*m?\s*ago$") | (t.rlike(r"(?i)\b\d+m\s*ago\b") & (F.length(t) <= 16))
    foreign = F.lit(False) if allow_cjk else (count(t, CJK) >= 0.4 * n) & (count(t, "[Ѐ-ӿ]") < 0.1 * n) & (count(t, "[A-Za-z]") < 0.3 * n)
    return F.when(F.length(t) < 2, True).when(t.rlike(r"^[A-Za-z][\w.]*\)?\.?$"), False).otherwise(window | noise | ages | foreign | icons)


def stays_as_is(text: Column, target: Column, garbled: Column | None = None) -> Column:
    """A text that needs no translation: in the target's script already, hardly any letters, or of no script. An unknown target leaves all but CJK."""
    own, script = script_of(target), dominant_script(text)
    few = (count(text, r"\p{L}") < 2) | own.isNull() | script.isNull() | (script == own)
    if garbled is not None:
        few = garbled | few
    return ~text_or_empty(text).rlike(CJK) & F.coalesce(few, F.lit(True))


def is_legend(text: Column, keys: tuple[str, ...]) -> Column:
    """An entry of a map's legend: one of the keys in it, not spoken."""
    t = one_line(text)
    return (t != "") & ~gates.is_spoken_line(t) & _any_of(F.lower(t), keys)


def is_short_name(text: Column, names: tuple[str, ...]) -> Column:
    """A known name of at most six characters: two kana, or a Han character in at most three."""
    t = _compact(text)
    return F.length(t).between(1, 6) & _among(t, names) & ((count(t, KANA) >= 2) | ((count(t, HAN) >= 1) & (F.length(t) <= 3)))


def is_japanese_noise(text: Column, known: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> Column:
    """Scraps that a recogniser makes of a picture in Japanese mode; ``known`` labels are none, ``names`` neither."""
    t = one_line(text)
    c = _compact(t)
    jp, han, kana, latin, long = count(c, JAPANESE), count(c, HAN), count(c, KANA), count(c, "[A-Za-z]"), count(c, _LONG)
    hits = F.size(F.filter(F.array(*map(F.lit, PARTICLES)), lambda p: F.contains(c, p)))
    unknown = ~_among(c, known)
    return (
        F.when((t == "") | gates.is_latin_label(t) | _among(t, known) | is_short_name(t, names), False)
        .when((jp < 2) | ((latin >= 3) & (jp < 8)) | t.rlike(r"[`|>\\_^=~]"), True)
        .when((F.length(t) - F.length(c) >= 2) & (jp <= 10), True)
        .when((han == 0) & (((long >= 2) & (jp <= 10)) | (long >= F.greatest(F.lit(3), F.floor(F.length(c) / 2)))), True)
        .when((han == 0) & (count(c, "[ニヌネノミー]") >= 3) & (F.length(c) <= 12), True)
        .when((han == 0) & (hits == 0) & (((jp <= 4) & unknown) | (jp <= 6)), True)
        .when((han >= 1) & (jp <= 2) & (hits == 0) & (kana >= 1), True)
        .otherwise((han == 0) & (jp <= 4) & (hits == 1) & unknown)
    )


def japanese_score(text: Column, conf: Column, noise: Column, names: tuple[str, ...] = ()) -> Column:
    """Points of a Japanese read: most for Han characters, with a share of the confidence (0 to 100)."""
    han = count(text, HAN)
    rest = F.when(is_short_name(text, names), 8.0).when(count(text, JAPANESE) >= 4, 6.0).otherwise(1.0)
    return F.when(noise | gates.is_latin_label(text), 0.0).when(han >= 1, 14 + han * 2 + F.coalesce(conf, F.lit(0.0)) * 0.03).otherwise(rest)


def is_plausible(text: Column, kind: Column, japanese: bool, noise: Column, japanese_noise: Column, kept: tuple[str, ...] = ()) -> Column:
    """Whether a line of a read stays: by the noise filter, and in Japanese mode by its own, but for Latin labels, of which ``kept`` always stay."""
    if not japanese:
        return ~noise
    latin = gates.is_latin_label(text) | F.coalesce(kind, F.lit("")).isin("chip", "latin", "menu")
    return F.when(latin, ~noise | _among(F.replace(F.upper(text_or_empty(text)), F.lit(" "), F.lit("")), kept)).otherwise(~japanese_noise)


def unusable(text: Column) -> Column:
    """An aggregate: whether the texts of a read hold less than two characters together."""
    return F.coalesce(F.sum(F.length(F.trim(text_or_empty(text)))), F.lit(0)) < 2


def fitted_box(text: Column, box: Column, width: int, height: int, short_name: Column | None = None) -> Column:
    """The box of a line that is wider than its text can be, cut around its centre; null for a box that its text can't fill.

    The room of a character follows the line's height. A blank text has no box.
    """
    n = F.greatest(F.lit(1), F.length(_compact(text)))
    w, h = F.greatest(F.lit(1), box["x2"] - box["x1"]), F.greatest(F.lit(1), box["y2"] - box["y1"])
    name = F.lit(False) if short_name is None else short_name
    each, budget = w / n, F.greatest(F.lit(12.0), h * 1.45)
    pitch = F.greatest(F.lit(8), F.bround(F.greatest(F.lit(8.0), h.cast("double")) * 0.7).cast("int"))
    wide = F.greatest(F.lit(10), pitch)
    new = (
        F.when((w >= max(480, int(width * 0.47))) & (each > budget), F.greatest(F.lit(80), F.least(w, n * pitch + 48)))
        .when((w >= max(360, int(width * 0.36))) & (n <= 20) & (each > F.greatest(F.lit(40.0), budget)), F.greatest(F.lit(64), F.least(w, n * wide + 40)))
        .when((n <= 28) & (w > F.greatest(F.lit(220), F.floor(n * F.greatest(F.lit(22.0), budget) + 48))), F.greatest(F.lit(56), F.least(w, n * wide + 40)))
    )
    centre = (box["x1"] + box["x2"]) / 2
    cut = F.struct((centre - new / 2).cast("int").alias("x1"), box["y1"].alias("y1"), (centre + new / 2).cast("int").alias("x2"), box["y2"].alias("y2"))
    impossible = ~name & (((n <= 2) & ((w > F.greatest(F.lit(80.0), F.lit(width * 0.12))) | (h > F.greatest(F.lit(48.0), F.lit(height * 0.08))))) | ((n <= 4) & (w * h > width * height * 0.12)))
    return F.when((F.trim(text_or_empty(text)) == "") | box.isNull() | impossible, F.lit(None)).when(new.isNotNull(), cut).otherwise(box)


def words_in_range(text: Column, x1: Column, x2: Column, left: Column, right: Column) -> Column:
    """The words of a line whose middles, by their shares of its width, lie from ``left`` up to ``right``."""
    words = F.filter(F.split(F.trim(text_or_empty(text)), r"\s+"), lambda w: w != "")

    def pick(bound: Column) -> Column:
        room = lambda w: F.greatest(F.lit(1), F.bround(F.length(w) * (x2 - x1) / F.greatest(bound["total"], F.lit(1))).cast("int"))
        start = F.struct(x1.cast("int").alias("at"), F.lit(0).alias("before"), F.lit(0).alias("inside"))

        def step(s: Column, w: Column) -> Column:
            # middles never go back, so the words inside follow each other
            middle = s["at"] + F.floor(room(w) / 2)
            return F.struct((s["at"] + room(w)).alias("at"), (s["before"] + F.when(middle < left, 1).otherwise(0)).alias("before"), (s["inside"] + F.when((middle >= left) & (middle < right), 1).otherwise(0)).alias("inside"))

        return F.transform(F.array(F.aggregate(bound["words"], start, step)), lambda ends: F.array_join(F.slice(bound["words"], ends["before"] + 1, ends["inside"]), " "))[0]

    # lambdas bind the words, their length and the ends, so that none is made anew for every word
    bound = F.struct(words.alias("words"), F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)).alias("total"))
    return F.when((right > left) & (x2 > x1), F.transform(F.array(bound), pick)[0]).otherwise("")


def inside_paragraph(line_key: Column, y1: Column, paragraph: Column) -> Column:
    """Whether a line is one of a paragraph's lines ``(key, y1, y2)``: it starts within 8 pixels of the nearest one and shares its start."""
    from glyphmill.operators.tracking import shares_start

    near = F.array_min(F.transform(paragraph, lambda p, k: F.struct(F.abs(p["y1"] - y1).alias("d"), k.alias("k"), p.alias("p"))))["p"]
    return F.coalesce(y1.between(near["y1"] - 8, near["y2"] + 8) & shares_start(line_key, near["key"]), F.lit(False))
