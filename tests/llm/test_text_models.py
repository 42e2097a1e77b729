"""Models and rules of the text operators: exact round trips, brute force, held-out accuracy."""

import random
import textwrap
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import bpe, languages, lookalikes, near_copies, ngrams, packing, residue, responses, scans, truncation

VOCAB = f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json"
SENTENCES = {
    "en": "The {a} crossed the {b} river before the winter storm and nobody followed the trail.",
    "de": "Der {a} überquerte den {b} Fluss vor dem Sturm, und niemand folgte der Spur im Schnee.",
    "fr": "Le {a} traversa la rivière {b} avant la tempête et personne ne suivit les traces.",
    "es": "El {a} cruzó el río {b} antes de la tormenta y nadie siguió las huellas del camino.",
    "ru": "Старый {a} перешёл реку {b} перед бурей, и никто не пошёл по следу в снегу.",
    "ja": "{a}は嵐の前に{b}川を渡ったが、誰もその足跡を追わなかったようだ。",
    "zh": "{a}在暴风雨之前渡过了{b}河，可是没有人跟踪他的足迹。",
    "ko": "{a}은 폭풍 전에 {b} 강을 건넜지만 아무도 발자국을 따라가지 않았다.",
}


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    names = ["Marel", "Todrin", "Veska", "Lorin", "Pakel", "Rudo", "Sennit", "Galor"]
    return [(k, s.format(a=rng.choice(names), b=rng.choice(names))) for k, s in SENTENCES.items() for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.BytePairEncoder(VOCAB)


def test_bpe_equals_the_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    rng = random.Random(5)
    texts = [s for _, s in corpus(3)] + ["", " ", "a  b", "a \n b", " x", "\n \n", "x ", "it's  don't", "aaaaaaa aaaa", "日本語　<|endoftext|>", "​a​", "\x00a b", "é", "a\x85 b", "1  2\t\t3", "\r\n \r\n"]
    texts += ["".join(rng.choice(" \n\t 　ab1.é日🙂") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    texts.append(" ".join(rng.choice("alpha beta gamma".split()) for _ in range(30_000)))
    flat, sizes = encoder.encode(texts)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    for text, ids in zip(texts, parts):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_bpe_empty(encoder):
    flat, sizes = encoder.encode([None, ""])
    assert len(flat) == 0 and sizes.tolist() == [0, 0]


def test_sampling_estimates_weighted_jaccard():
    s = near_copies.WeightedSampler(4000)
    items = np.arange(40, dtype=np.uint32)
    w = np.random.default_rng(1).uniform(0.2, 5, 40)
    v = s.values(items, w)
    a, b = np.arange(0, 30), np.arange(10, 40)
    want = w[10:30].sum() / w.sum()
    got = (v[a].min(0) == v[b].min(0)).mean()
    assert abs(got - want) < 0.03


def test_items():
    assert near_copies.items_of("A b, a! B_c", "en") == ["a", "b", "c"]
    assert near_copies.items_of("日本、語", "ja") == ["日本", "本語"]
    assert near_copies.items_of(None, "en") == [] and near_copies.items_of("語", "ja") == []


def test_language_model_on_held_out_sentences():
    rows = corpus(60)
    m = languages.train([s for _, s in rows], np.array([languages.LANGS.index(k) for k, _ in rows]))
    test = corpus(10, seed=9)
    found = m.languages([s for _, s in test])
    right = sum(f[0][0] == k and len(f) == 1 for (k, _), (_, f) in zip(test, found))
    assert right / len(test) >= 0.95
    both = SENTENCES["ru"].format(a="Marel", b="Veska") + " " + SENTENCES["fr"].format(a="Marel", b="Veska")
    assert [x[0] for x in m.languages([both])[0][1]] == ["ru", "fr"]
    assert m.languages(["", "12 34"]) == [(0, []), (0, [])]


def test_each_stretch_has_a_language(spark):
    rows = corpus(60)
    m = languages.train([s for _, s in rows], np.array([languages.LANGS.index(k) for k, _ in rows]))
    ru, fr = (SENTENCES[k].format(a="Marel", b="Veska") for k in ("ru", "fr"))
    short = "Да. Нет. Кто там? Иди. Стой. Жди. Всё."
    texts = [f"{ru} Да. {fr}", "Нет", short, "12 34", "", None, "İİ " + ru, "Да. " + fr]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in languages.stretches(df, m, "id", "text").orderBy("row_id", "start").collect():
        got.setdefault(r["row_id"], []).append(r)
    assert set(got) == {0, 1, 2, 3, 4, 6, 7}
    for k, parts in got.items():
        assert "".join(texts[k][r["start"] : r["start"] + r["length"]] for r in parts) == texts[k]
    assert [r["lang"] for r in got[0]] == ["ru", "fr"] and texts[0][: got[0][0]["length"]] == f"{ru} Да."
    assert [r["lang"] for r in got[2]] == ["ru"] and [r["lang"] for r in got[7]] == ["fr"]
    assert got[1][0]["lang"] is not None and got[1][0]["text_lang"] is not None and 0 < got[1][0]["confidence"] <= 1
    assert got[3][0]["lang"] is None and got[4][0]["length"] == 0
    labelled = df.withColumn("label", F.lit(None).cast("string"))
    assert {(r["row_id"], r["lang"]) for r in languages.detect(labelled, m, "id", "label", "text").where("wrong").collect()} >= {(2, "ru")}


@pytest.mark.parametrize("label, want", [("EN", "en"), ("en-US", "en"), ("jpn", "ja"), ("jp", "ja"), ("zh_Hans", "zh"), (" ger ", "de"), ("auto", None), ("", None), (None, None), ("und", None)])
def test_label_spellings(label, want):
    assert languages.language_code(label) == want


def long_texts(seed):
    rng = random.Random(seed)
    nouns = "river castle harbour market lantern garden forest mountain village captain merchant soldier".split()
    verbs = "crosses guards leaves repairs watches remembers follows finds".split()
    return [" ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} near the {rng.choice(nouns)}." for _ in range(rng.randrange(1, 4))) for _ in range(900)]


@pytest.mark.parametrize("kind", [truncation.TruncationModel, truncation.EndLikelihood])
def test_truncation_on_held_out_cuts(kind):
    m = kind(long_texts(1))
    good, rng = long_texts(2)[:200], random.Random(4)
    bad = []
    for t in good:
        at = rng.randrange(10, len(t) - 3)
        while not (t[at - 1].isalpha() and t[at].isalpha()):
            at = rng.randrange(10, len(t) - 3)
        bad.append(t[:at] + rng.choice(["", "", "…", " [...]", "�"]))
    assert m.cut(good).mean() <= 0.02
    assert m.cut(bad).mean() >= 0.9
    assert not m.cut(["", "  ", "River Lantern 12"]).any()


def test_truncation_without_a_sample():
    assert not truncation.TruncationModel([]).cut(["half a wo"]).any()


def test_truncation_counts_all_texts(spark):
    """Words and a field limit of five texts among 30,000, and a regression of several parts."""
    usual = spark.range(30_000).selectExpr("concat('The old river ', id, ' passes the mill.') AS t")
    rare = spark.createDataFrame([(t,) for t in [f"The quokka of number {k} sleeps beside the old mill wall." for k in range(5)] + [f"{c * 3} walks over the long bridge without a word to an{c}" for c in "abcde"]], "t string")
    m = truncation.fit([(usual.unionByName(rare), "t")])
    assert m.words["quokka"] == 5 and m.words["river"] == truncation.WELL_KNOWN
    assert m.limits == {len("aaa walks over the long bridge without a word to ana")}
    df = spark.createDataFrame([(t,) for t in long_texts(1)], "t string")
    m, good = truncation.fit([(df, "t")], part_texts=300), long_texts(2)[:200]
    assert m.cut(good).mean() <= 0.02
    assert m.cut([t[:-4] for t in good]).mean() >= 0.9


PROSE = [f"{s} Last week the server answered with a 404 error, and we wrote about it." if k == "en" else s for k, s in corpus(40)]


def test_residue():
    docs = PROSE + ["404 Not Found\nBack to start"] * 3 + ["Lorem ipsum dolor sit amet, consectetur. Lorem ipsum dolor sit amet."] * 3
    m = residue.fit(docs)
    share = m.coverage(["Error 503: Service Unavailable", "Text goes here. Text goes here.", SENTENCES["zh"].format(a="Veska", b="Lorin"), PROSE[0], "", "\n \n"])
    assert share[0] > 0.6 and share[1] > 0.6 and share[2] < 0.5 and share[3] < 0.5 and share[4] == 0 and share[5] == 0


@pytest.mark.parametrize(
    "text, want",
    [("Dear {{ name }}, welcome", True), ("Dear %FIRST_NAME%, hi", True), ("code ${date}.", True), ("Posted by <%= player %>", True), ("[INSERT DATE HERE]", True), ("(your price here)", True), ("on {0}", True), ("@@ID@@", True), ("__PLACE__", True), ("[[x]]", True),
     ("Strings such as `%d coins` or `${hero}` stay", False), ("the token `{{0}}`", False), ("{name}-style marks", False), ("a < b and c > d", False), ("50 % off, 20 %", False), ("", False)],
)
def test_placeholders(text, want):
    assert residue.has_placeholder(text) is want


@pytest.mark.parametrize("seed", range(3))
def test_plain_forms_against_the_definition(seed):
    rng = random.Random(seed)
    pool = "abcéñ ﬁＡ１ｶﾞ한글́​ 　日本…！？-"
    for _ in range(300):
        raw = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))
        out = lookalikes.plain_forms(raw)
        assert unicodedata.is_normalized("NFC", out)
        assert not any(unicodedata.category(c) == "Cf" or (unicodedata.category(c) == "Zs" and c != " ") for c in out)
        assert not any(unicodedata.category(c)[0] in "LN" and unicodedata.normalize("NFKC", c) != c for c in out)
        assert lookalikes.plain_forms(out) == out
        assert all(c in out for c in raw if c in "…！？")


def disguise(word, rng):
    pairs = dict(zip(lookalikes.LATIN_C, lookalikes.CYRILLIC))
    at = [k for k, c in enumerate(word) if c in pairs]
    k = rng.choice(at)
    return word[:k] + pairs[word[k]] + word[k + 1 :]


def test_disguised_words_come_back():
    texts = [s for _, s in corpus(20)]
    canon, rng = lookalikes.Canon(texts * 3), random.Random(2)
    for t in texts[:40]:
        words = t.split(" ")
        k = rng.choice([i for i, w in enumerate(words) if any(c in lookalikes.LATIN_C for c in w)])
        words[k] = disguise(words[k], rng)
        assert canon.text(" ".join(words)) == (t, True)
    for t in texts:
        assert canon.text(t) == (t, False)
    assert canon.text("The river ΤΗΕ road and more") == ("The river THE road and more", True)
    many = lookalikes.Canon(texts + ["The river ΤΗΕ road and more"] * 500)
    assert many.text("The river ΤΗΕ road and more") == ("The river THE road and more", True)
    assert canon.text("код T-40b2 и ещё слова") == ("код T-40b2 и ещё слова", False)
    assert canon.text("Первый текст здесь. Second text is here too.") == ("Первый текст здесь. Second text is here too.", False)


def test_bigrams_of_all_texts(spark):
    """One text in 30,000 with letter pairs of its own; equal texts count once."""
    df = spark.range(30_000).selectExpr("CASE WHEN id = 17 THEN 'Zwqvkk' WHEN id % 2 = 0 THEN 'the same river' ELSE concat('river ', id) END AS t")
    got = lookalikes.fit([(df, "t")]).bigrams
    want = lookalikes.Canon(sorted({r[0] for r in df.collect()})).bigrams
    assert got.count == want.count and got.total == want.total and got.seen == want.seen
    assert got.count["latin"]["q", "v"] == 1 and got.count["latin"]["r", "i"] == 15_000


def test_header_of_one_book_in_a_large_corpus(spark):
    """A header on three of 31,000 pages."""
    body = "The captain crossed the old bay.\nBefore the storm and he left it\nthe lantern on the wall is near\nthe village market in winter."
    df = spark.range(31_000).selectExpr("'t' AS tbl", "id AS row_id", f"concat(CASE WHEN id % 10000 = 5 AND id < 30000 THEN 'Zarkon Almanac\\n' ELSE '' END, '{body}') AS text".replace("\n", "\\n"))
    laid = scans.lay_out(df)
    assert {r["row_id"] for r in laid.where("page AND furniture").collect()} == {5, 10005, 20005}


def test_layout_of_a_page():
    page = "Karth Field Guide\nThe captain crossed the old har-\nbour before the storm and left\n— 12 —\nthe lantern on the wall behind\nthe village market in winter."
    x = scans.Layout(page)
    x.find_headers(frozenset({"field", "guide"}))
    assert x.is_page() and x.header[0] and x.number[3]
    lines, split = x.flow()
    assert split and scans.join_lines(lines) == "The captain crossed the old harbour before the storm and left the lantern on the wall behind the village market in winter."
    assert "har-bour" in scans.join_lines(lines, frozenset({"har-bour"}))
    for t in ("HP 70 - LV 10\nOne whole message stands in this line.\nAnother message stands in this one.\nAnd a third.", "", "a\nb", "LV 3/12\nx\ny\nz"):
        y = scans.Layout(t)
        assert not (y.is_page() and y.furniture())


@pytest.mark.parametrize("capacity", [1, 7, 64, 500])
@pytest.mark.parametrize("mixed", [True, False])
def test_patterns_keep_the_capacity(capacity, mixed):
    rng = random.Random(capacity)
    bounds = packing.class_bounds(capacity, mixed).tolist()
    counts = {u: rng.randrange(0, 30) for u in bounds}
    plan = packing.plan_patterns(counts, capacity, mixed)
    room, seen = {}, dict.fromkeys(counts, 0)
    for u, start, per, first, times in plan:
        assert start == seen[u] or not mixed
        n = per * times if mixed else counts[u]
        seen[u] += n
        for r in range(n):
            room[first + r // per] = room.get(first + r // per, 0) + u
    assert all(v <= capacity for v in room.values())
    assert all(seen[u] == n for u, n in counts.items() if n)


def test_responses():
    rows = corpus(50)
    good = [(a, b, kb) for (_, a), (kb, b) in zip(rows, random.Random(3).sample(rows, len(rows)))]
    m = responses.ResponseModel(good + [("x y z", "I'm sorry, but I cannot translate this text.", "de")] * 2)
    src, en, ru = SENTENCES["de"].format(a="Marel", b="Rudo"), SENTENCES["en"].format(a="Marel", b="Rudo"), SENTENCES["ru"].format(a="Марел", b="Рудо")
    got = m.defects([src] * 8, [en, None, " … ", src.upper(), "Sorry, I'm unable to help with that request. [P903]", ru, "I'm sorry", en], ["en", "en", "en", "en", "en", "en", None, "xx"])
    assert got[:6] == [None, "empty", "empty", "copy", "refusal", "wrong_language"]
    assert m.defects(["Altar 1057"], ["Altar 1057"], ["de"]) == [None]


# Refusals in wordings of their own, of which none is built from the grammar's parts.
UNSEEN_REFUSALS = {
    "en": ["I'm afraid I am unable to translate this passage.", "Regrettably, I can't provide a translation of this.", "I must say no: I cannot help you translate it."],
    "ru": ["К сожалению, перевести это я не смогу.", "Простите, я не имею права переводить такое.", "Я не смогу вам помочь с таким переводом."],
    "de": ["Leider kann ich Ihnen das nicht übersetzen.", "Verzeihung, aber diesen Inhalt darf ich nicht bearbeiten.", "Es ist mir nicht möglich, dabei zu helfen."],
    "fr": ["Malheureusement, je ne suis pas en mesure de vous aider.", "Désolé, je ne peux pas traduire cela.", "Je suis navré, mais ce contenu ne peut pas être traité."],
    "es": ["Lo lamento, pero no soy capaz de traducir esto.", "Por desgracia, no puedo ayudarle con eso.", "Me resulta imposible procesar este contenido."],
    "ja": ["すみませんが、これを訳すことはできません。", "残念ですが、お手伝いできません。", "申し訳ないのですが、ご要望にはお応えしかねます。"],
    "zh": ["很抱歉，我不能翻译这样的内容。", "遗憾的是，我无法帮助您处理。", "请原谅，我没有办法提供翻译。"],
    "ko": ["죄송하지만 이것을 번역해 드릴 수 없습니다.", "아쉽게도 도움을 드릴 수 없습니다.", "이런 요청은 처리할 수 없습니다."],
}


def test_refusals_in_unseen_wordings(small):
    targets = sorted({t for t in pq.read_table(f"{small}/translations.parquet").to_pydict()["translated_text"] if t})
    model = responses.RefusalModel(targets)
    assert not {t.lower() for ts in UNSEEN_REFUSALS.values() for t in ts} & {t.lower() for t in responses.REFUSALS}
    for lang, texts in UNSEEN_REFUSALS.items():
        share = model.share(texts)
        assert (share >= responses.REFUSING).mean() >= 0.95, (lang, share)


def test_refusals_are_learnt_from_the_corpus(spark):
    prompts = ["A river runs past the old mill.", "Bring ten ropes to the harbour guard!", "Whoever holds the bell may open the gate.", "Snow fell on the market all night."]
    said = [(p, "Nope, the oracle stays silent today [C12]", "en") for p in prompts] + [(f"{p} {k}", "Der Fluss fließt an der alten Mühle vorbei.", "de") for k in range(4) for p in prompts[:1]] + [(None, None, None), ("x", "", "en")]
    df = spark.createDataFrame(said, "source_text string, translated_text string, target_lang string")
    assert responses.repeated_responses(df) == ["nope, the oracle stays silent today"]
    assert responses.repeated_responses(df.where("false")) == []


def test_rare_refusals_among_many_repeats(spark):
    """A refusal on three rows, beside more than 5,000 responses that repeat more often."""
    usual = spark.range(4 * 5_200).selectExpr("concat('The old bridge number ', id div 4, ' carries travellers over river ', id % 4) AS source_text", "concat('Die alte Brücke ', id div 4, ' trägt Reisende') AS translated_text")
    prompts = ["A river runs past the old mill.", "Bring ten ropes to the harbour guard!", "Snow fell on the market all night."]
    rare = spark.createDataFrame([(p, "Nope, the oracle stays silent today") for p in prompts], "source_text string, translated_text string")
    assert responses.repeated_responses(usual.unionByName(rare)) == ["nope, the oracle stays silent today"]


def test_all_prompts_of_a_response_are_compared(spark):
    """One unlike prompt among forty, at every place of the hashes by which a few are picked first."""
    alike = [f"A river runs past the old mill and the quiet village number {k}." for k in range(40)]
    said = [(p, f"Nope, oracle {j} stays silent") for j in "abcdefgh" for p in [*alike, f"Bring ten ropes to harbour guard {j}!"]] + [(p, "Der Fluss an der Mühle") for p in alike]
    df = spark.createDataFrame(said, "source_text string, translated_text string")
    assert responses.repeated_responses(df) == [f"nope, oracle {j} stays silent" for j in "abcdefgh"]


@pytest.mark.parametrize("seed", range(5))
def test_unlike_prompts_by_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        pool = rng.sample("abcdefghijklmnop", rng.randrange(4, 17))
        prompts = [" ".join(rng.sample(pool, rng.randrange(1, min(len(pool), 9)))) for _ in range(rng.randrange(2, 9))]
        sets = [set(p.split()) for p in prompts]
        want = any(min(len(a), len(b)) >= 3 and len(a & b) < responses.UNLIKE * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
        assert responses.unlike(prompts) is want


def test_residue_is_learnt_from_the_corpus(spark):
    notice = "Oops, the gremlins chewed this parchment"
    rng = random.Random(4)
    words = "road village bread bridge town river harbour lantern winter storm soldier merchant takes builds crosses finds follows carries the a an old long quiet and with under past".split()
    docs = [f"{notice}\nCode {k}" for k in range(5)] + [". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(8)) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert "oops, the gremlins chewed this parchment" in residue.dominant_windows(df)
    assert {r["doc_id"] for r in residue.find_residue(df).where("is_residue").collect()} == set(range(5))


def test_windows_beyond_five_thousand(spark):
    """A notice on three documents, beside more than 5,000 windows that dominate more."""
    usual = spark.range(4 * 5_200).selectExpr("concat('harbour ', translate(cast(id div 4 AS string), '0123456789', 'abcdefghij')) AS text")
    rare = spark.createDataFrame([(f"Oops, the gremlins chewed this parchment\n{k}",) for k in range(3)], "text string")
    assert "oops, the gremlins chewed this parchment" in residue.dominant_windows(usual.unionByName(rare))


def test_residue_models_count_all_documents_and_their_ends(spark):
    """The n-grams of whole texts of 7,000 documents, where a sample had the first 3,000 characters of 6,000."""
    df = spark.range(7_000).selectExpr("concat(repeat('The old river passes the mill. ', 100), 'Quokka ', id) AS text")
    got = ngrams.summed(df, residue._counts, 1 << residue.BITS)
    texts = [r[0] for r in df.collect()]
    assert got.sum() == sum(len(t) + 1 for t in texts)
    (slot,) = {ngrams.hashed(ngrams.code_points(["quok"])[0], residue.GRAM, residue.BITS)[-1]}
    assert got[slot] >= 7_000


@pytest.mark.parametrize("width", [60, 100, 112, 120, 200])
def test_pages_of_any_width(width):
    text = "The captain crossed the old harbour before the storm and left one lantern on the wall behind the village market while nobody in the whole town had seen the ship that came from the northern islands " * 8
    assert scans.Layout("\n".join(textwrap.wrap(text, width)) + "\n- 12 -").is_page()


def test_short_pages():
    page = scans.Layout("The merchant carried the heavy lan-\ntern down to the river and\n- 7 -")
    assert page.is_page() and page.flow()[1] and page.furniture()
    assert scans.Layout("The merchant carried the heavy lan-\ntern down to the river").is_page()
    assert not scans.Layout("A short title\nThen one sentence that stands alone.").is_page()
    assert not scans.Layout("Mira Oak\nHP 5\nLV 3/12").is_page()
