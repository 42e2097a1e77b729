"""The operators on DataFrames: brute force, and the cases every one must stand."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import bpe, copies, languages, lookalikes, near_copies, packing, queries, residue, responses, scans, truncation

MEMORY = "memory_id long, source_text string, translated_text string, source_lang string, target_lang string, tbl string, row_id string, items string, cid string, _id string, text string"
LONG = "word " * 40_000


def memory(spark, rows):
    return spark.createDataFrame([(*r, "t", "r", "i", "c", "d", "x") for r in rows], MEMORY)


BASE = "one two three four five six seven eight nine ten"


def odd_rows():
    return [
        (1, BASE, "x y z", "en", "ru"), (2, BASE + " eleven", "q r s", "en", "ru"), (3, BASE, "x y z", "en", "ru"), (3, BASE, "x y z", "en", "ru"), (4, None, None, "en", "ru"), (5, "", "", None, None),
        (6, "  ", "...", "en", None), (7, LONG, LONG, "en", "ru"), (8, BASE, None, None, "ru"), (9, BASE + " twelve", None, None, "ru"), (None, BASE, "x", "en", "ru"), (10, "日本語の文章です", "x y z", "ja", "ru"), (11, "日本語の文章です。", "k", "ja", "ru"),
    ]


def group_key():
    return copies.memory_key(F.col("source_text"), F.col("source_lang"), F.col("target_lang"))


def brute_pairs(rows, keys):
    out = set()
    rows = [r for r in rows if r[0] is not None]
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            if a[0] == b[0] or a[3:] != b[3:]:
                continue
            if keys.get(a[0]) is not None and keys.get(a[0]) == keys.get(b[0]):
                continue
            for col, lang in ((1, a[3]), (2, a[4])):
                x, y = set(near_copies.items_of(a[col], lang)), set(near_copies.items_of(b[col], lang))
                if x and y and len(x & y) >= 0.73 * len(x | y):
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_near_copies_on_odd_rows(spark):
    rows = odd_rows()
    df = memory(spark, rows)
    keys = {r["memory_id"]: r["k"] for r in df.select("memory_id", group_key().alias("k")).collect()}
    got = {tuple(r) for r in near_copies.near_copy_pairs(df, group_key()).collect()}
    assert got == brute_pairs(rows, keys)


def test_near_copies_by_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(150)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(25)]
        for _ in range(rng.randrange(1, 6)):
            edited = [w if rng.random() > 0.05 else rng.choice(vocab) for w in base]
            k += 1
            rows.append((k, " ".join(edited), " ".join(rng.choice(vocab) for _ in range(20)), "en", "ru"))
    df = memory(spark, rows)
    want = brute_pairs(rows, {r["memory_id"]: r["k"] for r in df.select("memory_id", group_key().alias("k")).collect()})
    assert {tuple(r) for r in near_copies.near_copy_pairs(df, group_key(), exact=True).collect()} == want
    # crowded bands in cells of small blocks give the same pairs
    whole, cells = ({tuple(r) for r in near_copies.near_copy_pairs(df, group_key(), rows=2, bands=24, block=block, slot_bits=4).collect()} for block in (10**9, 8))
    assert cells == whole <= want and len(whole) >= 0.99 * len(want) > 20


def edited_pairs(n, vocab_size=200):
    """Pairs of texts that are alike by 0.73 to 0.80, with their edits in rare words, while the shared words stand in every tenth text."""
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(vocab_size)]
    rows = []
    for k in range(n):
        base = rng.sample(vocab, 17 + k % 7)
        rows += [(2 * k + h, " ".join(base + [f"rare{k}x{h}x{j}" for j in range(3)]), f"t{k}h{h}", "en", "ru") for h in (0, 1)]
    return rows, {(2 * k, 2 * k + 1) for k in range(n)}


def test_near_copies_at_the_threshold(spark):
    rows, want = edited_pairs(150)
    assert {tuple(r) for r in near_copies.near_copy_pairs(memory(spark, rows), group_key(), exact=True).collect()} == want


def test_near_copies_recall_of_the_default_parameters(spark):
    rows, want = edited_pairs(1500)
    got = {tuple(r) for r in near_copies.near_copy_pairs(memory(spark, rows), group_key()).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_near_copies_links(spark):
    rows = [(1, BASE, "x y z", "en", "ru"), (2, BASE + " eleven", "q r s", "en", "ru"), (3, BASE, "x y z", "en", "ru"), (4, None, "", "en", "ru")]
    got = sorted(tuple(r) for r in near_copies.NearCopies(memory(spark, rows), group_key()).links().collect())
    assert got == [(1, 2, 0), (1, 2, 1), (2, 1, 0), (2, 1, 1)]


def test_near_copies_hot_copy_group(spark):
    """A text that a third of the rows repeat is one class; pairs stay between formatting groups."""
    rows = [(k, "the same long sentence about a river and a lantern", f"t{k} u{k} v{k}", "en", "ru") for k in range(200)] + [(1000, "the same long sentence about a river and a big lantern", "z", "en", "ru")]
    got = {tuple(r) for r in near_copies.near_copy_pairs(memory(spark, rows), group_key()).collect()}
    assert got == {(k, 1000) for k in range(200)}


def test_near_copies_meet_in_blocks(spark):
    """The bands' keys travel in blocks, not as a row for each class and band; the pairs are those of all keys by brute force."""
    rng = random.Random(5)
    signed, of = [], {}
    for _ in range(400):
        low, high, n = rng.getrandbits(56), rng.getrandbits(64), rng.choice([12, 14, 30, 254, 255])
        for _ in range(3):
            low, high = low ^ 1 << rng.randrange(56), high ^ 1 << rng.randrange(64)
            sketch = [x - (x >> 63 << 64) for x in (low << 8 | n - rng.randrange(2), high)]
            keys = [rng.randrange(40) * 0x6000000 - (1 << 31) for _ in range(4)]
            signed.append((*sketch, keys))
            for k in keys:
                of.setdefault(k, set()).add(tuple(sketch))
    want = set()
    for there in of.values():
        for a in there:
            for b in there:
                differ = ((a[0] ^ b[0]) >> 8 & (1 << 56) - 1).bit_count() + ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count()
                small, large = sorted((a[0] & 255, b[0] & 255))
                if a < b and small >= 0.73 * large - 1e-6 and (large == 255 or differ <= (small + large) * 0.27 / 1.73 + 1e-6):
                    want.add((*a, *b))
    df = spark.createDataFrame(signed + signed[:50], "low long, high long, keys array<int>")
    for block in (10**9, 20):
        met = near_copies._banded_pairs(df, 4, 0.73, block, 8)
        assert {tuple(r) for r in met.collect()} == want
        plan = met._jdf.queryExecution().toString()
        assert "Generate" not in plan and "Join" not in plan
    assert len(want) > 1000


def test_near_copies_items_of_many_texts_at_once():
    texts = ["A b, a! B_c", "", "...", "Straße STRASSE ß", "日本、語の 日本", "x" * 5000 + " y", "a\x00b ab\ud800c", "１２ ①② é e\u0301", "ﬁne İi", "語"] + [LONG]
    for paired in (False, True):
        codes, sizes = near_copies._item_hashes(texts, paired)
        ends, named = sizes.cumsum(), {}
        for text, n, end in zip(texts, sizes.tolist(), ends.tolist()):
            items = near_copies.items_of(text, "ja" if paired else "en")
            assert n == len(items)
            for item, code in zip(items, codes[end - n : end].tolist()):
                assert named.setdefault(item, code) == code
        assert len(set(named.values())) == len(named)
    assert [len(x) for x in near_copies._item_hashes([], False)] == [0, 0]


def test_copies(spark):
    m = memory(spark, odd_rows() + [(20, "Mira Oak: HP 5 | ATK 6 | DEF 7", "", "en", "ru"), (21, "MIRA OAK - def 7, hp 5 / atk 6", "", "en", "ru"), (22, "Mira Oak: HP 6 | ATK 5 | DEF 7", "", "en", "ru"), (23, "STRASSE nine!", "", "de", "ru"), (24, "straße, nine", "", "de", "ru"), (25, "first second.", "", "en", "ru"), (26, "second first.", "", "en", "ru")])
    t = spark.createDataFrame([(1, "en\x1fru\x1fRed map 7"), (2, "Red map, 7||en||ru"), (3, "EN::red MAP 7::RU"), (4, "en\tde\tRed map 7"), (5, "\x1fru\x1fRed map 7"), (6, "|ru|Red map 7!"), (7, None), (8, ""), (9, "en \x1f Red map 7 \x1f ru")], "entry_id long, cache_key string")
    got = {tuple(r) for r in copies.find_copies(copies.all_fingerprints(m, t)).collect()}
    assert {x for x in got if x[0] == "translations"} == {("translations", 1, 2), ("translations", 1, 3), ("translations", 1, 9), ("translations", 5, 6)}
    mem = {(a, b) for tbl, a, b in got if tbl == "memory"}
    assert {(1, 3), (20, 21), (23, 24), (10, 11)} <= mem and not {(20, 22), (25, 26), (1, 8)} & mem
    counts = {(r["tbl"], r["kept_id"]): r["n_copies"] for r in copies.collapse(copies.all_fingerprints(m, t)).collect()}
    assert counts["translations", 1] == 3
    assert {r["tbl"]: r["n_collisions"] for r in copies.collisions(copies.all_fingerprints(m, t)).collect()} == {"memory": 0, "translations": 0}


def test_hot_copy_group_runs_in_several_tasks(spark):
    """Half of all rows in one group: its copies come from as many tasks as read them."""
    rows = spark.range(0, 40_000, 1, 8).select(F.lit("t").alias("tbl"), F.col("id").alias("row_id"), F.expr("unhex(md5(if(id % 2 = 0, 'hot', cast(id div 4 as string))))").alias("h128"), F.expr("xxhash64(if(id % 2 = 0, 'hot', cast(id div 4 as string)))").alias("h64"))
    got = copies.find_copies(rows).withColumn("task", F.spark_partition_id()).cache()
    assert got.count() == got.where("kept_id = 0").count() + 10_000 and got.where("kept_id = 0").count() == 19_999
    assert got.where("kept_id = 0").select("task").distinct().count() == 8


ROWS = [(1, "An ordinary sentence about rivers and lanterns near the village.", "Ein gewöhnlicher Satz über Flüsse und Laternen nahe beim Dorf.", "en", "de"), (2, None, None, None, None), (3, "", "", "", ""), (4, "  ", "\n", "auto", "xx"), (5, LONG, LONG, "en", "de"), (1, "An ordinary sentence about rivers and lanterns near the village.", "x", "en", "de"), (6, "퟿​\u0000é", "日本語", "ja", "ja")]
SCHEMA = "id long, a string, b string, la string, lb string, row_id string, tbl string, text string, _id string, _text string, word string, lang string, n string"


def odd(spark):
    return spark.createDataFrame([(*r, "r", "t", "x", "i", "y", "w", "l", "n") for r in ROWS], SCHEMA)


@pytest.mark.parametrize("empty", [False, True])
def test_text_operators_stand_everything(spark, empty):
    df = odd(spark).where("false") if empty else odd(spark)
    n = 0 if empty else len(ROWS)
    assert truncation.score(df, truncation.fit([(df, "a")]), "id", "a", F.col("la")).count() == n
    model = languages.fit_model([(df, "la", "a")])
    found = languages.detect(df, model, "id", "la", "a").collect()
    assert {r["row_id"] for r in found} <= {1, 5}
    canon = lookalikes.canonical(df, lookalikes.fit([(df, "a")]), "id", "a").collect()
    assert len(canon) == n and all(r["text"] is None for r in canon if r["row_id"] == 2)
    named = df.select(F.col("id").alias("entry_id"), F.col("a").alias("source_text"), F.col("b").alias("translated_text"), F.col("lb").alias("target_lang"), "text", "_id")
    assert {(r["entry_id"], r["defect"]) for r in responses.find_defects(named).collect()} >= (set() if empty else {(2, "empty"), (3, "empty"), (4, "empty")})
    assert {r["id"]: r["is_residue"] for r in residue.find_residue(df, "id", "a").collect() if r["id"] in (2, 3, 4)} == ({} if empty else {2: False, 3: False, 4: False})
    ids = {r["id"]: r["ids"] for r in bpe.encode_ids(df, "id", "a").collect()}
    assert len(ids) == (0 if empty else 6) and (empty or (ids[2] == [] and ids[3] == [] and len(ids[4]) > 0))
    texts = df.select(F.lit("t").alias("tbl"), F.col("id").alias("row_id"), F.col("a").alias("text"))
    s = scans.Scans(texts)
    assert s.found().count() == 0 and s.repaired().count() == 0
    packed = packing.pack_texts(df.select("id", "a"), [("s", 16), ("l", 1000), ("none", 0), (None, None)], "id", "a")
    if not empty:
        sums = {(r["kind"]): r["t"] for r in packed.groupBy("kind").agg(F.sum("n_tokens").alias("t")).collect()}
        assert set(sums) == {"s", "l"} and len(set(sums.values())) == 1
    else:
        assert packed.count() == 0


def test_misread_words(spark):
    rng = random.Random(3)
    words = "captain harbour lantern village market winter storm river forest soldier mountain merchant".split()
    rows = [("t", k, " ".join(rng.choice(words) for _ in range(12)) + ".") for k in range(120)]
    page = "The capta!n crossed the old harb0ur\nbefore the storm and left one lantcrn\non the wall behind the village market\nin the winter of the rniddle year and\nthe merchant from the mountain wept."
    rows.append(("t", 999, page))
    s = scans.Scans(spark.createDataFrame(rows, "tbl string, row_id long, text string"))
    assert {(r["word"], r["fix"]) for r in s.misread().collect()} == {("capta!n", "captain"), ("harb0ur", "harbour"), ("lantcrn", "lantern")}
    assert [r["row_id"] for r in s.found().collect()] == [999]
    assert s.repaired().first()["text"].startswith("The captain crossed the old harbour before the storm and left one lantern on the wall")


def test_packing_is_whole(spark):
    rng = random.Random(5)
    sizes = [(k, rng.choice([0, 1, 5, 30, 99, 100, 101, 350])) for k in range(500)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int")
    for mixed in (True, False):
        rows = packing.pack(df, [("c", 100)], mixed).collect()
        room, total = {}, {}
        for r in rows:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
            if r["container_id"] is not None:
                room[r["container_id"]] = room.get(r["container_id"], 0) + r["n_tokens"]
        assert total == dict(sizes) and max(room.values()) <= 100
        pieces = {}
        for r in rows:
            pieces.setdefault(r["doc_id"], []).append(r["n_tokens"])
        assert all(len(p) == max(1, -(-n // 100)) for (k, n) in sizes for p in [pieces[k]])
        if mixed:
            assert sum(room.values()) / (len(room) * 100) > 0.95


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, small, name):
    df = queries.queries()[name](spark, small)
    rows = df.count()
    assert rows >= 0 and df.columns
    if name.endswith("_found"):
        assert df.distinct().count() == rows
