"""Problem 5: the language of each text and of each of its stretches.

A text is the average of the embeddings of its hashed character n-grams, and a
linear softmax over that average names the language; both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled sentences.
Since everything after the embedding is linear, the trained model collapses to
one row of logits for each n-gram, and scoring is a table look-up and a sum.
A temperature fitted on held-out sentences calibrates the confidence, and a
stretch below the rejection level takes the language of its neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import ngrams

#: Sentences the model is fitted on, taken from at most this many rows of each table.
SAMPLE_ROWS = 9_000
SAMPLE_SENTENCES, SAMPLE_CHARS = 24_000, 400
#: Steps of the descent, at least.
LEAST_STEPS = 250
#: Orders of the n-grams; order 0 is the block of the character set that a character beyond Latin belongs to.
ORDERS, BITS, DIMS = (0, 1, 2, 3, 4), 16, 16
#: Letters below which a text is no case, and a stretch has no language of its own.
LEAST_LETTERS, LEAST_STRETCH = 20, 10
#: Letters below which a language beside another one doesn't count.
LEAST_PASSAGE = 28
#: Calibrated confidence below which a stretch is rejected.
REJECT = 0.6

# The codes of the languages (two letters, then other spellings of the first part).
CODES = {
    "en": ("en", "eng"), "ru": ("ru", "rus"), "ja": ("ja", "jpn", "jp"), "de": ("de", "deu", "ger"), "fr": ("fr", "fra", "fre"), "es": ("es", "spa"), "zh": ("zh", "zho", "chi", "cn", "cmn"), "ko": ("ko", "kor", "kr"),
}
LANGS = tuple(CODES)
_OF = {c: lang for lang, codes in CODES.items() for c in codes}
_STOPS = np.zeros(0x10000, dtype=bool)
_STOPS[[ord(c) for c in "\n.!?。！？…"]] = True


def language_code(label: str | None) -> str | None:
    """The two-letter code that a label spells, or None."""
    return _OF.get((label or "").strip().lower().replace("_", "-").split("-")[0])


def label_code(label: Column) -> Column:
    """``language_code`` as a Spark expression."""
    first = F.split(F.regexp_replace(F.lower(F.trim(label)), "_", "-"), "-")[0]
    pairs = [x for c, lang in _OF.items() for x in (F.lit(c), F.lit(lang))]
    return F.try_element_at(F.create_map(*pairs), first)


_LETTER = None


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x20000)), dtype=bool, count=0x20000)
    return _LETTER[np.minimum(codes, 0x1FFFF)]


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    return [ngrams.hashed(codes if n else np.where(codes < 0x370, codes, codes >> np.uint32(8)), max(n, 1), BITS).astype(np.int64) + (k << BITS) for k, n in enumerate(ORDERS)]


def _plain(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # places must stay those of the text
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low + "\n"


class LanguageModel:
    """Averaged hashed subword embeddings with a linear softmax."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, temperature: float):
        self.table, self.bias, self.temperature = table, bias, temperature

    @classmethod
    def fit(cls, sentences: list[str], label: np.ndarray, epochs: int = 4, rate: float = 4.0, batch: int = 128, seed: int = 5) -> LanguageModel:
        rng = np.random.default_rng(seed)
        rows = len(ORDERS) << BITS
        embed = rng.normal(0, 0.1, (rows, DIMS)).astype(np.float32)
        weight, bias = rng.normal(0, 0.1, (DIMS, len(LANGS))).astype(np.float32), np.zeros(len(LANGS), np.float32)
        codes, sizes = ngrams.code_points([_plain(s) for s in sentences])
        slots = np.stack(_slots(codes), axis=1)
        start = np.concatenate(([0], np.cumsum(sizes)))
        order = rng.permutation(len(sentences))
        held, used = order[: len(order) // 10], order[len(order) // 10 :]
        # a small sample is passed more often, so that the fit gets enough steps
        epochs = max(epochs, -(-LEAST_STEPS // (len(used) // batch + 1)))
        steps, done = epochs * (len(used) // batch + 1), 0
        for _ in range(epochs):
            used = rng.permutation(used)
            for at in range(0, len(used), batch):
                pick = used[at : at + batch]
                n = sizes[pick]
                pos = np.repeat(start[pick] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                slot, many = slots[pos].ravel(), n * len(ORDERS)
                mean = np.add.reduceat(embed[slot], np.concatenate(([0], np.cumsum(many)[:-1])), axis=0) / many[:, None]
                z = mean @ weight + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), label[pick]] -= 1
                lr = rate * (1 - done / steps)
                back = p @ weight.T / many[:, None]
                weight -= lr * (mean.T @ p) / len(pick)
                bias -= lr * p.mean(0)
                # every n-gram of a sentence gets the same step, so the steps add up by slot
                by = np.argsort(slot, kind="stable")
                cut = np.flatnonzero(np.concatenate(([True], np.diff(slot[by]) > 0)))
                owner = np.repeat(np.arange(len(pick)), many)
                embed[slot[by][cut]] -= lr * np.add.reduceat(back[owner[by]], cut, axis=0)
                done += 1
        model = cls(embed @ weight, bias, 1.0)
        if len(held):
            z = model.logits(slots[np.repeat(start[held] - np.concatenate(([0], np.cumsum(sizes[held])[:-1])), sizes[held]) + np.arange(sizes[held].sum())], sizes[held])
            loss = lambda t: -np.mean((z / t - np.log(np.exp(z / t - (z / t).max(1, keepdims=True)).sum(1, keepdims=True)) - (z / t).max(1, keepdims=True))[np.arange(len(held)), label[held]])
            model.temperature = float(min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss))
        return model

    def logits(self, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.add.reduceat(self.table[slots].sum(1), at, axis=0) / (sizes * len(ORDERS))[:, None] + self.bias

    def _grams(self, codes: np.ndarray) -> np.ndarray:
        parts = _slots(codes)
        out = self.table[parts[0]]
        for s in parts[1:]:
            out += self.table[s]
        return out

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentences of all texts: owner, size in code points, letters, language index and calibrated confidence.

        Every text ends a sentence. A sentence that is short or uncertain has the language -1.
        """
        owner, size, count, z = self._scored(texts)
        p = self._shares(z)
        lang, sure = p.argmax(1), p.max(1)
        lang = np.where((count < LEAST_STRETCH) | (sure < REJECT), -1, lang)
        return owner, size, count, lang, sure

    def _shares(self, z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(-1, keepdims=True))
        return p / p.sum(-1, keepdims=True)

    def _scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, size, letters and logits over the temperature of each sentence; those of a passage are the mean by size."""
        plain = [_plain(t) for t in texts]
        codes, sizes = ngrams.code_points(plain)
        stop = _STOPS[np.minimum(codes, 0xFFFF)]
        stop[np.cumsum(sizes) - 1] = True
        end = np.flatnonzero(stop) + 1
        size = np.diff(np.concatenate(([0], end)))
        owner = np.searchsorted(np.cumsum(sizes), end, side="left")
        count = ngrams.segment_sums(letters(codes), size)
        z = np.add.reduceat(self._grams(codes), end - size, axis=0) / (size * len(ORDERS))[:, None] + self.bias
        return owner, size, count, z / self.temperature

    def languages(self, texts: list[str]) -> list[tuple[int, list[tuple[str, float, int]]]]:
        """Of each text its letters, and its languages with confidence and letters, in order of appearance."""
        if not texts:
            return []
        owner, _, count, lang, sure = self.stretches(texts)
        out: list[tuple[int, list]] = [(0, []) for _ in texts]
        total = np.bincount(owner, weights=count, minlength=len(texts)).astype(int)
        ids = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))).tolist() + [len(owner)]
        for a, b in zip(ids[:-1], ids[1:]):
            own, found = lang[a:b], {}
            for k in np.flatnonzero(own >= 0):
                have = found.setdefault(int(own[k]), [0.0, 0])
                have[0] += float(sure[a + k] * count[a + k])
                have[1] += int(count[a + k])
            # a name or a heading amid another language isn't a passage of its own
            if len(found) > 1:
                most = max(n for _, n in found.values())
                found = {j: v for j, v in found.items() if v[1] >= min(LEAST_PASSAGE, most)}
            out[owner[a]] = (total[owner[a]], [(LANGS[j], w / n, n) for j, (w, n) in found.items()])
        return out


    def passages(self, texts: list[str]) -> list[tuple[str | None, float, list[tuple[int, int, str | None, float, int]]]]:
        """Of each text its language and confidence, and its stretches: start, length, language, confidence and letters.

        Stretches cover the text. A sentence that is short, uncertain or in a
        language that doesn't count takes the language of the sentence before
        it, at the beginning of the one after it, and without any the whole
        text's. Without letters the language is None and the confidence 0.
        """
        if not texts:
            return []
        owner, size, count, z = self._scored(texts)
        p = self._shares(z)
        best = np.where((count < LEAST_STRETCH) | (p.max(1) < REJECT), -1, p.argmax(1))
        ids = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))).tolist() + [len(owner)]
        out = []
        for a, b in zip(ids[:-1], ids[1:]):
            n, m, own = size[a:b], count[a:b], best[a:b]
            whole = self._shares(n @ z[a:b] / n.sum())
            top = int(whole.argmax())
            if not m.any():
                out.append((None, 0.0, [(0, int(n.sum()) - 1, None, 0.0, 0)]))
                continue
            have = np.bincount(own[own >= 0], weights=m[own >= 0], minlength=len(LANGS))
            counts = have >= min(LEAST_PASSAGE, have.max()) if (have > 0).sum() > 1 else have > 0
            named = np.flatnonzero((own >= 0) & counts[own])
            if len(named):
                own = own[named[np.maximum(np.searchsorted(named, np.arange(len(own)), side="right") - 1, 0)]]
            else:
                own = np.full(len(own), top)
            cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))).tolist() + [len(own)]
            at, found = 0, []
            for i, j in zip(cut[:-1], cut[1:]):
                long = int(n[i:j].sum())
                sure = self._shares(n[i:j] @ z[a + i : a + j] / long)[own[i]]
                # the last sentence holds the line end that was added
                found.append((at, long - (j == len(own)), LANGS[own[i]], float(sure), int(m[i:j].sum())))
                at += long
            out.append((LANGS[top], float(whole[top]), found))
        return out


def sentences_of(text: str) -> list[str]:
    """Sentences of a text with enough letters to tell a language, for the fit; of very long ones the beginning."""
    import re

    return [s[:SAMPLE_CHARS] for s in re.split(r"(?<=[.!?。！？\n])\s*", text) if sum(map(str.isalpha, s[:SAMPLE_CHARS])) >= LEAST_STRETCH]


def fit_model(tables: list[tuple[DataFrame, str, str]], sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from the labelled rows of some tables, given with label and text column.

    Labels are partly wrong, so the fit runs twice: the second one leaves out
    sentences that the first one contradicts with confidence.
    """
    sentences, label = [], []
    for df, lang, text in tables:
        rows = df.select(label_code(F.col(lang)).alias("l"), F.col(text).alias("t")).where("l IS NOT NULL AND t IS NOT NULL")
        for r in ngrams.bounded_sample(rows, F.col("t"), sample_rows).collect():
            own = sentences_of(r["t"])
            sentences += own
            label += [LANGS.index(r["l"])] * len(own)
    return train(sentences, np.array(label, dtype=np.int64))


def train(sentences: list[str], label: np.ndarray, most: int = SAMPLE_SENTENCES, seed: int = 3) -> LanguageModel:
    if not len(sentences):
        return LanguageModel(np.zeros((len(ORDERS) << BITS, len(LANGS)), np.float32), np.zeros(len(LANGS), np.float32), 1.0)
    rng = np.random.default_rng(seed)
    # languages weigh the same: the rarer ones are drawn more often
    share = 1.0 / np.bincount(label, minlength=len(LANGS))[label] ** 0.7
    pick = rng.choice(len(sentences), size=min(most, len(sentences)), replace=False, p=share / share.sum())
    some, own = [sentences[i] for i in pick], label[pick]
    model = LanguageModel.fit(some, own, epochs=2)
    first = [k[0] for k in _best(model, some)]
    keep = [i for i, k in enumerate(first) if k < 0 or k == own[i]]
    return LanguageModel.fit([some[i] for i in keep], own[keep])


def _best(model: LanguageModel, sentences: list[str]) -> list[tuple[int, float]]:
    out = []
    for at in range(0, len(sentences), 2000):
        for n, found in model.languages(sentences[at : at + 2000]):
            out.append((LANGS.index(max(found, key=lambda x: x[2])[0]), 1.0) if found else (-1, 0.0))
    return out


def detect(df: DataFrame, model: LanguageModel, id_col: str, label_col: str, text_col: str) -> DataFrame:
    """``(row_id, label, lang, confidence, letters, n_langs, wrong)``: one row for each language of each text.

    ``wrong`` tells whether the row's label is missing, names another language,
    or the text holds several. A text without a sure sentence has the language
    of the whole; below the rejection level that doesn't contradict a label.
    Null texts and those with fewer than 20 letters have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2500):
                yield one(b.slice(at, 2500))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        column = b.column(2).dictionary_encode()
        texts = [t or "" for t in column.dictionary.to_pylist()]
        found = model.languages(texts)
        unsure = [k for k, (n, langs) in enumerate(found) if n >= LEAST_LETTERS and not langs]
        for k, (lang, sure, _) in zip(unsure, model.passages([texts[k] for k in unsure])):
            found[k] = found[k][0], [(lang, sure, found[k][0])]
        out: dict[str, list] = {k: [] for k in ("row_id", "label", "lang", "confidence", "letters", "n_langs", "wrong")}
        for i, label, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), column.indices.to_pylist()):
            n, langs = found[k] if k is not None else (0, [])
            if n < LEAST_LETTERS:
                continue
            code = language_code(label)
            wrong = code is None or len(langs) > 1 or (langs[0][0] != code and langs[0][1] >= REJECT)
            for lang, sure, letters_ in langs:
                for key, v in zip(out, (i, label, lang, sure, letters_, len(langs), wrong)):
                    out[key].append(v)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(label_col).alias("_label"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "row_id long, label string, lang string, confidence double, letters int, n_langs int, wrong boolean")


def stretches(df: DataFrame, model: LanguageModel, id_col: str, text_col: str) -> DataFrame:
    """``(row_id, start, length, lang, confidence, letters, text_lang, text_confidence)``: one row for each stretch of each text.

    ``start`` counts code points from 0. Each text that is not null has a row;
    one without letters has a single stretch with a null language.
    """
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.float64())
    names = ["row_id", "start", "length", "lang", "confidence", "letters", "text_lang", "text_confidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2500):
                yield one(b.slice(at, 2500))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        column = b.column(1).dictionary_encode()
        found = model.passages(column.dictionary.to_pylist())
        out = []
        for i, k in zip(b.column(0).to_pylist(), column.indices.to_pylist()):
            lang, sure, parts = found[k]
            out += [(i, *part, lang, sure) for part in parts]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    return rows.mapInArrow(run, "row_id long, start int, length int, lang string, confidence double, letters int, text_lang string, text_confidence double")
