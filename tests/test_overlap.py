"""Two reads of a frame, name plates, settings."""

import pytest

from glyphmill.operators import overlap
from glyphmill.settings import Settings, fill_template, may_clear_all

S = "f int, id long, text string, box struct<x1:int,y1:int,x2:int,y2:int>, conf double"


def df(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], S)


def ids(d, col="id"):
    return sorted(r[col] for r in d.collect())


def test_places(spark):
    a = df(spark, [(1, "one", (0, 0, 50, 12), 0.9), (2, "two", (0, 100, 50, 112), 0.9), (3, None, None, None)])
    b = df(spark, [(10, "uno", (2, 1, 52, 13), 0.5)])
    assert ids(overlap.without_overlapping(a, b, ["f"])) == [2, 3]
    assert ids(overlap.merge_by_place(a.where("id < 3"), b, ["f"])) == [2, 10]
    assert ids(overlap.best_in_band(a.where("id < 3"), b, ["f"])) == [1, 2]
    assert ids(overlap.without_overlapping(a, b.where("false"), ["f"])) == [1, 2, 3]


def test_echoes_and_reads(spark):
    a = df(spark, [(1, "the lantern hangs on the wall", (0, 0, 200, 12), 0.9), (2, "another thing altogether", (0, 50, 200, 62), 0.9)])
    p = df(spark, [(9, "the lantern hangs on the wail", (0, 0, 210, 14), 0.9)])
    assert ids(overlap.drop_echoes(a, p, ["f"])) == [2]
    r = df(spark, [(1, "The lantern hangs", (0, 0, 9, 9), 0.9), (2, "The lantern hangs on the wall", (0, 1, 9, 9), 0.9), (3, "Else", (0, 0, 9, 9), 0.9)])
    assert ids(overlap.longest_reads(r, ["f"])) == [2, 3]


def test_reads_by_the_reference(spark):
    """Within 4 pixels across a bucket's edge; a start that is too short a share; a line inside a paragraph."""
    rows = [
        (1, "The lantern hangs", (0, 3, 90, 12), 0.9), (2, "The lantern hangs on the wall", (0, 4, 90, 13), 0.9),
        (3, "Veska the merchant buys a boat and sails it down the river", (0, 40, 90, 49), 0.9), (4, "Veska the merchant never came home again, says the old man", (0, 41, 90, 50), 0.9),
        (5, "First line of the codex\nsecond line of the codex", (0, 100, 90, 120), 0.9), (6, "Second line of the codex", (0, 109, 90, 119), 0.9), (7, "Second thoughts", (0, 110, 90, 119), 0.9),
    ]
    assert ids(overlap.longest_reads(df(spark, rows), ["f"])) == [2, 3, 4, 5, 7]


def test_union_of_halves(spark):
    a = df(spark, [(1, "one", (0, 0, 50, 12), 0.1), (2, "two", (100, 0, 150, 12), 0.9)])
    b = df(spark, [(10, "uno", (3, 3, 52, 13), 0.9), (11, "tres", (4, 0, 50, 12), 0.5), (12, "dos", (100, 4, 150, 16), 0.5)])
    assert ids(overlap.union_of_halves(a, b, ["f"])) == [1, 2, 11, 12]


def test_name_plates(spark):
    a = df(spark, [(1, "Mira", (0, 0, 40, 14), 0.9), (2, "I have seen the lantern on the wall last night", (120, 0, 500, 14), 0.9), (3, "Oak", (0, 100, 40, 114), 0.9), (4, "Nobody crossed the river before the winter storm", (0, 120, 400, 134), 0.9)])
    assert sorted(tuple(r)[1:] for r in overlap.name_plates(a, ["f"]).collect()) == [(1, 2, "side"), (3, 4, "above")]


def test_finish(spark):
    a = df(spark, [(1, "Same", (0, 0, 9, 9), 0.9), (2, "s a m e", (0, 50, 9, 59), 0.9), (3, "Other", (0, 20, 9, 29), 0.9), (4, " ", (0, 20, 9, 29), 0.9)])
    assert ids(overlap.finish_frame(a, ["f"])) == [1, 3] and ids(overlap.finish_frame(a, ["f"], 1)) == [1]


def test_settings():
    assert Settings().with_profile({"call_cap": 5, "unknown": 1, "game": None}).call_cap == 5
    for bad in ({"call_cap": 0}, {"likeness": 1.5}, {"target_lang": " "}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert may_clear_all("empty_scene") and not may_clear_all("retry") and not may_clear_all(None)
    assert fill_template({"q": ["{text}", "{other}"], "n": 1}, {"text": "a{source}", "source": "x"}) == {"q": ["a{source}", "{other}"], "n": 1}
