"""Dictionaries, stores, batches, layout and streams on small own inputs."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import batching, layout, lexicon, stores, tracking
from glyphmill.operators.layout import Line
from glyphmill.sources import dictionaries
from glyphmill.streaming import blocks

TERMS = "source string, target string, scope string, priority int, flags array<string>, pack string, ordinal long"


def terms(spark, rows):
    return spark.createDataFrame(rows, TERMS)


def test_precedence(spark):
    t = terms(spark, [("sword", "global", "global", 90, [], "core", 1), ("sword", "game", "game", 1, [], "core", 2), ("sword", "user", "user", 0, [], "mine", 3), ("shield", "first", "global", 5, [], "core", 4), ("shield", "second", "global", 5, [], "other", 5), ("bow", "bow", "global", 5, [], "core", 6), ("axe", None, "global", 5, [], "core", 7)])
    won = {r["source"]: r["target"] for r in lexicon.winners(t, "core", True).collect()}
    assert won == {"sword": "user", "shield": "first"}
    assert {r["source"]: r["target"] for r in lexicon.winners(t.where("scope <> 'user'"), "other", True).collect()}["sword"] == "global"


def test_first_of_equal_terms_stays(spark):
    t = terms(spark, [("a", "1", "global", 5, ["x", "y"], "p", 2), ("a", "2", "global", 5, ["y", "x"], "p", 1), ("a", "3", None, None, None, "p", 3)])
    assert sorted((r["target"], r["scope"], r["priority"]) for r in lexicon.distinct_terms(t).collect()) == [("2", "global", 5), ("3", "global", 0)]


def test_rules(spark):
    rules = [lexicon.Rule(r"(\d+) apples", "$1 fruits", "global", 1), lexicon.Rule(r"(?i)^lv (\d+)$", "Level $1", "user", 0), lexicon.Rule("第(\\d+)章", "Chapter $1", "global", 9)]
    df = spark.createDataFrame([("3 apples and 4 apples",), ("LV 9",), ("第3章",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in df.select(lexicon.rewrite(F.col("t"), rules)).collect()] == ["3 fruits and 4 apples", "Level 9", "Chapter 3", None, None]


@pytest.mark.parametrize("bad", ["", "(", "(a+)+", "x" * 201, None])
def test_refused_patterns(bad):
    with pytest.raises(ValueError):
        lexicon.check_pattern(bad)


def test_cascade_order(spark):
    t = terms(spark, [("gold", "Gold!", "global", 1, [], "core", 1), ("both", "term", "global", 1, [], "core", 2)])
    user = spark.createDataFrame([("both", "mine"), ("void", "")], "source string, target string")
    df = spark.createDataFrame([("both",), ("gold",), ("gold 125",), ("7/9",), ("void",), (None,)], "t string")
    got = {r["t"]: (r["resolved"], r["step"]) for r in lexicon.cascade(df, "t", user, t, [], "Level").collect()}
    assert got == {"both": ("mine", "user"), "gold": ("Gold!", "lexicon"), "gold 125": ("Gold! 125", "term_number"), "7/9": ("7/9", "number"), "void": (None, None), None: (None, None)}


def test_memory(spark):
    rows = [("a", "x", "en", "ru", "b1", 1), (" a ", "y", "en", "ru", "b2", 2), ("a", "a", "en", "ru", "b1", 3), ("", "z", "en", "ru", "b1", 4), (None, "z", "en", "ru", "b1", 5)]
    df = spark.createDataFrame(rows, "source_text string, translated_text string, source_lang string, target_lang string, backend_id string, created_at int")
    got = stores.remember(df, ["source_lang", "target_lang", "source_text"], ["created_at"]).collect()
    assert [(r["source_text"], r["translated_text"], r["backend_id"], r["use_count"]) for r in got] == [("a", "y", "b2", 2)]


def test_cache(spark):
    df = spark.createDataFrame([("k1", "v1", 1), ("k2", "", 2), ("k3", None, 3), ("k4", "v2", 4), (None, "v1", 5)], "cache_key string, glossary_version string, last_used_at int")
    assert {r["cache_key"] for r in stores.versioned_hits(df, "v1").collect()} == {"k1", "k2", "k3"}
    assert {r["cache_key"] for r in stores.evict(df.where("cache_key IS NOT NULL").withColumn("p", F.lit(1)), 2, ["p"], [F.desc("last_used_at")]).collect()} == {"k3", "k4"}
    reads = spark.createDataFrame([("k1", 9), ("k1", 7)], "cache_key string, read_at int")
    assert {r["cache_key"]: r["last_used_at"] for r in stores.touch(df, reads).collect()}["k1"] == 9
    assert {r["cache_key"] for r in stores.forget(df, df.where("cache_key = 'k1'"), ["cache_key"]).collect()} == {"k2", "k3", "k4", None}


def test_batches_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(c, k, " ".join(["w"] * rng.choice([1, 5, 100, 300, 600]))) for c in range(6) for k in range(28)]
    df = spark.createDataFrame(rows, "call int, k int, text string")
    got = {(r["call"], r["k"]): r["batch"] for r in batching.pack_batches(df, ["call"], "k", "text").collect()}
    for c in range(6):
        batch = n = tokens = 0
        for _, k, t in [r for r in rows if r[0] == c]:
            size = len(t.split())
            if n and (n >= 8 or tokens + size > 512):
                batch, n, tokens = batch + 1, 0, 0
            n, tokens = n + 1, tokens + size
            assert got[c, k] == batch


def test_backend(spark):
    df = spark.createDataFrame([("ab", "en", 1, 1), ("cd", "fr", 2, 1)], "text string, lang string, ordinal int, copies int")
    got = {r["text"]: r["answer"] for r in batching.run_backend(df, lambda texts, lang: [lang + t[::-1] for t in texts]).collect()}
    assert got == {"ab": "enba", "cd": "frdc"}


def test_matching_is_one_to_one(spark):
    box = lambda x: (x, 0, x + 20, 20)
    schema = "f int, id long, box struct<x1:int,y1:int,x2:int,y2:int>, lang string, text string"
    p = spark.createDataFrame([(1, 1, box(0), "en", "one"), (1, 2, box(22), "en", "two")], schema)
    q = spark.createDataFrame([(1, 10, box(1), "en", "one"), (1, 11, box(21), "en", "two"), (1, 12, box(500), "en", "far")], schema)
    assert {(r["prev_id"], r["line_id"]) for r in tracking.match_frames(p, q, ["f"]).collect()} == {(1, 10), (2, 11)}


def L(text, x1, y1, x2, y2, conf=0.9, i=0):
    return Line(text, x1, y1, x2, y2, conf, (i,))


def test_wraps():
    ls = [L("a long line that", 0, 0, 100, 12, i=1), L("goes on here.", 0, 15, 90, 27, i=2), L("Another one", 0, 30, 80, 42, i=3), L("far below", 0, 300, 80, 312, i=4)]
    assert [b.text for b in layout.soft_wraps(ls)] == ["a long line that goes on here.", "Another one", "far below"]


def test_vertical_order():
    ls = [L("右", 100, y, 120, y + 60, i=k) for k, y in enumerate((0, 70))] + [L("左", 40, y, 60, y + 60, i=9 + k) for k, y in enumerate((0, 70))] + [L("中", 70, 0, 90, 60, i=5)]
    assert [b.ids[0] for b in layout.reading_order(ls)] == [0, 1, 5, 9, 10]


def test_double_reads_and_rows():
    ls = [L("Chapter 3", 0, 0, 100, 20, 0.9, 1), L("Chanter 3", 1, 0, 101, 20, 0.5, 2), L("next", 110, 1, 150, 21, 0.9, 3)]
    assert [b.text for b in layout.stitch_rows(layout.drop_double_reads(ls))] == ["Chapter 3 next"]


def test_gutters():
    ls = [L("l", 60, y, 300, y + 10, i=y) for y in range(0, 100, 20)] + [L("r", 400, y, 700, y + 10, i=y + 1) for y in range(0, 100, 20)]
    assert layout.column_gutters(ls, 760) == [(300, 400)]
    assert layout.column_gutters(ls[:5], 760) == []


def test_plain_text():
    assert layout.plain_text([L("one", 0, 0, 50, 12), L("two", 64, 14, 90, 26), L("three", 0, 100, 50, 112), L(" ", 0, 200, 1, 201)]) == "one\n\t\ttwo\n\nthree\n"
    assert layout.plain_text([]) == ""


def test_components_and_rectangles():
    rng = random.Random(1)
    tiles = {(rng.randrange(12), rng.randrange(12)) for _ in range(40)}
    groups = layout.components(tiles)
    assert {t for g in groups for t in g} == tiles and sum(map(len, groups)) == len(tiles)
    for a in groups:
        for b in groups:
            if a is not b:
                assert all(max(abs(x - u), abs(y - v)) > 1 for x, y in a for u, v in b)
    assert layout.merge_near([(0, 0, 10, 10), (15, 0, 20, 10), (100, 0, 110, 10)], 6) == [(0, 0, 20, 10), (100, 0, 110, 10)]


def test_frames_survive_nulls(spark):
    schema = "f int, row_id long, text string, box struct<x1:int,y1:int,x2:int,y2:int>, conf double"
    df = spark.createDataFrame([(1, 1, None, (0, 0, 5, 5), None), (1, 2, "x", None, 0.5), (None, 3, "y", (0, 0, 5, 5), 0.5)], schema)
    for name in layout.PASSES:
        assert layout.run_pass(df, ["f"], name).count() >= 1
    assert layout.run_pass(df.where("false"), ["f"], "order").count() == 0


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("source\ttarget\tscope\tpriority\tflags\nsword\tмеч\tuser\t5\ta,b,a\n\nshort\tx\nbow\tлук\t\tbad\t\n", encoding="utf-8")
    t = dictionaries.read_terms(spark, str(tmp_path / "t.tsv"), "p").orderBy("ordinal").collect()
    assert [(r["source"], r["scope"], r["priority"], r["flags"]) for r in t] == [("sword", "user", 5, ["a", "b"]), ("bow", "global", 0, [])]
    (tmp_path / "s.jsonl").write_text('{"surface": "Mira"}\nbroken\n{"surface": ""}\n', encoding="utf-8")
    assert [r["source"] for r in dictionaries.read_speakers(spark, str(tmp_path / "s.jsonl"), "p").collect()] == ["Mira"]
    (tmp_path / "r.tsv").write_text("pattern\treplacement\tscope\tpriority\n^a(b)$\tx\\1\tuser\t7\n", encoding="utf-8")
    assert dictionaries.read_rules(str(tmp_path / "r.tsv"), "p") == [lexicon.Rule("^a(b)$", "x$1", "user", 7, "p")]
    (tmp_path / "x.txt").write_text("// note\n[set game]\nsr:^(?i)go (.+)$=идти $1\nopen\\=it=открыть\nsame=same\nloose\n", encoding="utf-8")
    got = {r["line_no"]: (r["kind"], r["source"], r["target"]) for r in dictionaries.read_foreign(spark, str(tmp_path / "x.txt")).collect()}
    assert got[2][0] == "rule" and got[4] == ("skipped", "same=same", "empty or equal sides") and got[5][2] == "unparsed" and got[1][2] == "directive"
    (tmp_path / "g.toml").write_text('[ui]\nOK = "Да"\n[game]\nOK = "Ок"\n', encoding="utf-8")
    assert dictionaries.read_glossary(spark, str(tmp_path / "g.toml")).count() == 2
    assert dictionaries.read_glossary(spark, str(tmp_path / "none.toml")).count() == 0
    dictionaries.write_terms(dictionaries.read_terms(spark, str(tmp_path / "t.tsv"), "p"), str(tmp_path / "out"))
    assert dictionaries.read_terms(spark, str(tmp_path / "out"), "p").count() == 2


LINES = "session_id string, frame_id long, line_no int, text string, x1 int, y1 int, x2 int, y2 int"


def session_rows():
    out = []
    for f in range(6):
        out.append(("s", f, 0, "label", 0, 0, 40, 12))
        if f in (1, 2):
            out.append(("s", f, 1, f"line {f}", 0, 50, 60, 62))
    return out


def test_tracker_replay(spark, tmp_path):
    df = spark.createDataFrame(session_rows(), LINES)
    want = sorted(tuple(r) for r in blocks.track_batch(df).collect())
    assert [(e[1], e[3]) for e in want] == [(0, "appeared"), (1, "appeared"), (2, "changed"), (4, "gone")]
    for f in range(6):
        df.where(f"frame_id = {f}").coalesce(1).write.parquet(str(tmp_path / "in" / f"f={f}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = blocks.track(stream).writeStream.format("memory").queryName("events_seen").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("events_seen").collect())
    assert {e[3] for e in got} <= {"appeared", "changed", "gone"} and got


def test_upsert_stream(spark, tmp_path):
    merge = blocks.upsert_into(str(tmp_path / "t"), ["k"], ["at"])
    a = spark.createDataFrame([("x", "1", 1), ("y", "1", 1)], "k string, v string, at int")
    b = spark.createDataFrame([("x", "2", 2), ("x", "0", 0)], "k string, v string, at int")
    merge(a, 0)
    merge(b, 1)
    merge(b, 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "v1")).select("k", "v").collect()) == [("x", "2"), ("y", "1")]


def line(text, x1, y1, x2, y2, k):
    from glyphmill.operators.layout import Line

    return Line(text, x1, y1, x2, y2, 0.9, (k,))


def test_flow_and_tails():
    from glyphmill.operators import layout

    rows = [line("A river runs past the", 10, 0, 200, 20, 1), line("old mill and the", 10, 18, 190, 38, 2), line("bridge.", 10, 36, 90, 56, 3), line("Start", 10, 120, 60, 140, 4)]
    assert [p.text for p in layout.flow_paragraphs(rows)] == ["A river runs past the old mill and the bridge.", "Start"]
    short = layout.flow_paragraphs(rows[:2]) + [line("bridge first.", 12, 46, 90, 62, 3), line("a new line of four", 12, 64, 90, 80, 4)]
    assert [p.text for p in layout.merge_tails(short)] == ["A river runs past the old mill and the bridge first.", "a new line of four"]
    assert layout.flow_paragraphs([]) == [] and layout.merge_tails([]) == []


def test_columns_keep_apart():
    from glyphmill.operators import layout

    rows = [line(f"left {k},", 10, 20 * k, 190, 20 * k + 18, k) for k in range(3)] + [line(f"right {k}", 700, 20 * k, 900, 20 * k + 18, 10 + k) for k in range(3)]
    assert layout.column_bounds(rows, 1000) == [(0, 450), (450, 1000)]
    assert all(not ("left" in p.text and "right" in p.text) for p in layout.column_paragraphs(rows))
    assert layout.column_paragraphs([]) == []


def test_reading_aids_are_dropped():
    from glyphmill.operators import layout

    rows = [line("利用方法", 10, 20, 200, 60, 1), line("りようりようりよう", 10, 4, 150, 16, 2), line("設定", 300, 20, 400, 60, 3), line("ストーリー", 300, 80, 400, 120, 4)]
    assert [b.ids[0] for b in layout.without_aids(rows)] == [1, 3, 4]
    assert [b.ids[0] for b in layout.without_aids(rows[:3])] == [1, 2, 3]


def test_speaker_scores(spark):
    from glyphmill.operators import speakers

    rows = [(1, "f", "Mira", (100, 100, 180, 124), "name", 4), (2, "f", "Mira: we have to leave before the storm comes", (100, 130, 700, 160), "dialogue", 4), (3, "f", "Settings", (900, 10, 1000, 40), None, None), (4, "g", None, (0, 0, 10, 10), None, 0)]
    df = spark.createDataFrame(rows, "id long, frame string, text string, box struct<x1:int,y1:int,x2:int,y2:int>, kind string, stable_passes int")
    scored = speakers.score(df, ["frame"], "id")
    got = {r["id"]: r["score"] for r in scored.collect()}
    assert got[2] == 0.0 and got[1] > 2.2 > got[3]
    assert [r["id"] for r in speakers.detect(scored, ["frame"], "id").collect()] == [1]
    assert speakers.score(df.where("false"), ["frame"], "id").count() == 0


def test_line_rules_on_odd_texts(spark):
    from pyspark.sql import functions as F

    from glyphmill.functions import lines

    df = spark.createDataFrame([(None,), ("",), ("  ",), ("word " * 20_000,), ("Obtained 350 x Col",), ("Confirm",), ("日本語のテキストです。",)], "t string")
    t, no = F.col("t"), F.lit(False)
    box = F.struct(*(F.lit(v).alias(k) for k, v in (("x1", 0), ("y1", 0), ("x2", 1900), ("y2", 20))))
    got = df.select(
        lines.is_junk_line(t).alias("junk"), lines.is_choice(t, no, no).alias("choice"), lines.is_screen_line(t, no, no, no).alias("screen"), lines.is_japanese_noise(t).alias("scrap"), lines.stays_as_is(t, F.lit("ru")).alias("as_is"),
        lines.is_known_phrase(t, ("Obtained",), (r"\b\d+\s*x\s*col\b",)).alias("known"), lines.fitted_box(t, box, 1920, 1080).alias("box"), lines.words_in_range(t, F.lit(0), F.lit(100), F.lit(0), F.lit(50)).alias("half"), lines.strip_tail(t, "col").alias("tail"),
    ).collect()
    assert [r["junk"] for r in got[:3]] == [True] * 3 and [r["choice"] for r in got] == [False, False, False, False, True, True, False]
    assert got[4]["known"] and got[4]["tail"] == "Obtained 350 x" and got[4]["half"] == "Obtained" and all(r["box"] is None for r in got[:3])
    assert not any(r["scrap"] for r in got[4:]) and not got[6]["as_is"] and got[0]["as_is"]
