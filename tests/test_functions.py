"""Expressions against small goldens in our own words."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import boxes, gates, labels, protect, scripts, text
from glyphmill.operators import tracking


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, want",
    [("ひらがな", "ja"), ("你好，世界", "zh-CN"), ("한국어 문장", "ko"), ("Привет, мир", "ru"), ("plain words", "en"), ("設定", "ja"), ("12", None), ("", None), (None, None), ("it’s", "zh-CN")],
)
def test_detect_lang(spark, value, want):
    assert one(spark, scripts.detect_lang(F.col("t")), t=value) == want


@pytest.mark.parametrize("value, want", [("abc", "latn"), ("абв", "cyrl"), ("abа", "latn"), ("aб", "latn"), ("бa", "cyrl"), ("", None), (None, None)])
def test_dominant_script(spark, value, want):
    assert one(spark, scripts.dominant_script(F.col("t")), t=value) == want


@pytest.mark.parametrize("value, want", [("1482014820", True), ("HP 120/120 LV 3", False), ("12-05-2024", False), ("Bonds of iron 14820", False), ("a1", False), (None, False), ("q 123456789", True)])
def test_digit_spam(spark, value, want):
    assert one(spark, gates.digit_spam(F.col("t")), t=value) is want


@pytest.mark.parametrize("value, want", [("Go to the", True), ("I went to the market and", True), ("I went home at last.", False), ("short", True), (None, True), ("彼はどこへ行くのか教えてください私に", True)])
def test_incomplete(spark, value, want):
    assert one(spark, gates.looks_incomplete(F.col("t")), t=value) is want


@pytest.mark.parametrize("value, want", [("Mira: come with me now", True), ("feat: add a reader", False), ("Overworld Exploration: a title here", False), ("no colon at all", False), (None, False)])
def test_spoken(spark, value, want):
    assert one(spark, gates.is_spoken_line(F.col("t")), t=value) is want


@pytest.mark.parametrize("value, want", [("3 / 12", "3/12"), ("45 %", "45%"), ("Lv. 7", "Level 7"), ("Lv 3 to Lv 4", "Level 3 → level 4"), ("hello", None), (None, None)])
def test_numbers(spark, value, want):
    assert one(spark, gates.numeric_guard(F.col("t"), F.lit("Level")), t=value) == want


def test_furigana(spark):
    assert one(spark, gates.is_furigana(F.col("t")), t="かきくかきく") is True
    assert one(spark, gates.is_furigana(F.col("t")), t="かきく") is False


@pytest.mark.parametrize("src, out, want", [("..wait!", "подожди", "..подожди!"), ("wait", "подожди", "подожди"), ("「go」", "иди", "「иди」"), ("go!", "иди?", "иди?"), ("", "x", "x"), (None, None, None)])
def test_edges(spark, src, out, want):
    assert one(spark, text.carry_edge_marks(F.col("s"), F.col("o")), s=src, o=out) == want


def test_marked(spark):
    got = one(spark, text.parse_marked(F.col("t")), t="PART1 one\nPART2\nPART3 three\nPART1 again")
    assert [(r["n"], r["body"]) for r in got] == [(1, "one"), (3, "three")]


@pytest.mark.parametrize("a, b, want", [("take the old map", "take the new map", True), ("is", "15", True), ("same words", "same  words", False), ("one two three four five six", "one two three four five six x", False), ("", "", False), (None, "word", True)])
def test_word_change(spark, a, b, want):
    assert one(spark, tracking.word_change(F.col("a"), F.col("b")), a=a, b=b) is want


def test_sequence_ratio(spark):
    from difflib import SequenceMatcher

    pairs = [("abcd", "abxd"), ("", ""), ("a", "b"), ("same", "same")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", tracking.sequence_ratio("a", "b").alias("r")).collect()
    assert all(abs(r["r"] - (1.0 if r["a"] == r["b"] else SequenceMatcher(None, r["a"], r["b"]).ratio())) < 1e-12 for r in rows)


def test_boxes(spark):
    row = spark.sql("SELECT named_struct('x1',0,'y1',0,'x2',10,'y2',10) a, named_struct('x1',5,'y1',0,'x2',15,'y2',10) b, named_struct('x1',10,'y1',0,'x2',20,'y2',10) c")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    r = row.select(boxes.iou(a, b).alias("i"), boxes.iou(a, c).alias("z"), boxes.overlaps(a, c).alias("o"), boxes.overlap_ratio(a, b).alias("r"), boxes.distance(a, c).alias("d"), boxes.contains(a, b).alias("k"), boxes.intersection(a, c).alias("n"), boxes.union(a, c).alias("u")).first()
    assert (round(r["i"], 6), r["z"], r["o"], r["r"], r["d"], r["k"], r["n"]) == (round(50 / 150, 6), 0.0, True, 0.5, 0.0, False, None)
    assert tuple(r["u"]) == (0, 0, 20, 10)


@pytest.mark.parametrize("value", ["open src/main/app.py now", "a, b; c: d!", "We met Old Mira in Karth", "", "see www.site and notes.txt", "【0┏】 taken", "ZZNAME0ZZ stays", None])
def test_round_trips(spark, value):
    for rule, shape in ((protect.protect_paths, protect.PATH_TOKEN), (protect.protect_marks, protect.MARK_TOKEN), (protect.protect_names, protect.NAME_TOKEN)):
        df = spark.createDataFrame([(value,)], "t string").select("t", rule(F.col("t")).alias("p"))
        r = df.select(protect.restore(F.col("p.text"), F.col("p.taken"), shape).alias("back"), protect.survived(F.col("p.text"), F.col("p.taken"), shape).alias("ok")).first()
        assert r["back"] == (value or "") and r["ok"]


def test_what_is_taken():
    assert protect.take_paths("open src/main/app.py now")[1] == ["src/main/app.py"]
    assert protect.take_marks("a, b; c!")[1] == [",", ";"]
    assert protect.take_names("We met Old Mira in Karth.")[1] == ["Old Mira", "Karth"]


@pytest.mark.parametrize("a, b, want", [("is", "15", True), ("l0ok", "look", True), ("no", "is", False), ("same", "same", True), ("ab", "abc", False), ("", "", False), (None, "x", False)])
def test_confusable(spark, a, b, want):
    assert one(spark, labels.are_confusable(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize("value, want", [("core-en_ru.1", True), ("..", False), ("", False), ("a/b", False), ("x" * 65, False), (None, False)])
def test_safe_id(spark, value, want):
    assert one(spark, labels.is_safe_id(F.col("t")), t=value) is want


@pytest.mark.parametrize("text_, nav, header, prompt", [("Zoom In", True, True, True), ("What is new here", True, True, True), ("deals damage to enemies", False, False, False), ("Learn with free resources", False, True, True), ("The end of the day.", False, False, False), ("", False, False, False), (None, False, False, False)])
def test_labels(spark, text_, nav, header, prompt):
    got = tuple(one(spark, f(F.col("t")), t=text_) for f in (labels.is_nav_line, labels.is_section_header))
    assert got == (nav, header)
    if text_ in ("Zoom In", "deals damage to enemies", None):
        assert one(spark, labels.is_ui_prompt(F.col("t")), t=text_) is prompt


def test_zones_and_roles(spark):
    df = spark.sql("SELECT named_struct('x1',0,'y1',0,'x2',100,'y2',20) box, 'Zoom In' t, CAST(NULL AS STRING) k UNION ALL SELECT named_struct('x1',0,'y1',990,'x2',100,'y2',1000), 'x', 'loot'")
    zones = [{"x": 0, "y": 0, "w": 500, "h": 1080, "unit": "px", "role": "HUD"}, {"x": 0.0, "y": 0.9, "w": 1.0, "h": 0.1, "unit": "frac", "role": "DECOR"}]
    got = df.select(labels.zone_roles(df, zones, 1920, 1080).alias("z"), labels.role(F.col("k"), F.col("t"), F.col("box")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("HUD", "menu"), ("DECOR", "item")]
    assert df.select(labels.zone_roles(df, [], 1, 1).alias("z")).first()["z"] is None


def test_spread_words():
    for words, weights in ((12, [5, 1, 1]), (3, [1, 1, 1, 1]), (7, [100, 1]), (0, [1, 2]), (5, [])):
        text_ = " ".join(f"w{k}" for k in range(words))
        parts = labels.spread_words(text_, weights)
        assert len(parts) == len(weights)
        if weights:
            assert " ".join(p for p in parts if p) == text_
            assert words < len(weights) or all(parts)
