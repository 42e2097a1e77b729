"""Problem 8: token ids of a public byte-level BPE vocabulary.

The merges run in numpy over the symbols of many words at once. All words of a
batch lie in one flat array; each round looks up every neighbouring pair by
binary search among the sorted pair keys, takes the lowest rank of each word,
joins its occurrences from the left and drops the words that have no pair left.
Words and blank-separated pieces that were seen before come from a bounded
memo of the Python worker, so a corpus mostly costs dictionary look-ups.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of the public tokenizers lie.
TOKENIZER_DIR = "/opt/tokenizers"
#: Entries a worker's memo may hold before it is emptied.
MEMO_ENTRIES = 300_000
#: Characters handled at once inside a worker.
CHUNK_CHARS = 4_000_000

# The public pre-tokenisation pattern of this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BIG = np.int64(1) << 40
_words = regex.compile(WORDS)
_odd_blank = regex.compile(r"[\x00\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def _byte_symbols() -> list[str]:
    """The visible character that stands for each byte in the vocabulary file."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shift = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shift)) for b in range(256)]


class BytePairEncoder:
    """Encodes texts by a vocabulary file in the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first = np.array([vocab[s] for s in _byte_symbols()], dtype=np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(order.astype(np.int64), _BIG)
        self.joined = np.append(np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order], 0)
        self.word_memo: dict[str, np.ndarray] = {}
        self.piece_memo: dict[str, np.ndarray] = {}

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, all words merged together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ids = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        done_ids, done_words = [], []
        while len(ids):
            pair = np.full(len(ids), np.iinfo(np.int64).max, dtype=np.int64)
            inside = word[1:] == word[:-1]
            pair[:-1][inside] = ids[:-1][inside] * self.width + ids[1:][inside]
            at = np.searchsorted(self.keys, pair)
            rank = np.where(self.keys[at] == pair, self.rank[at], _BIG)
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(start, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, start), length)
            over = least == _BIG
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                left = ~over
                ids, word, at, rank, least = ids[left], word[left], at[left], rank[left], least[left]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == least)
            # overlapping occurrences (aaa): every second one of a run counts, from its left end
            fresh = np.concatenate(([True], np.diff(hit) > 1))
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            ids[hit] = self.joined[at[hit]]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        flat, owner = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(raw))
        return np.split(flat[order].astype(np.int32), np.cumsum(counts)[:-1])

    def _learn(self, pieces: list[str]) -> None:
        split = [_words.findall(p) for p in pieces]
        memo = self.word_memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        new = list({w for ws in split for w in ws if w not in memo})
        if new:
            memo.update(zip(new, self.merge_words(new)))
        for p, ws in zip(pieces, split):
            self.piece_memo[p] = memo[ws[0]] if len(ws) == 1 else np.concatenate([memo[w] for w in ws])

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        pieces: list[str] = []
        many = []
        for t in texts:
            if not t:
                many.append(0)
                continue
            # A blank between two visible characters always begins a token, so the text may be cut
            # there; runs of white space that a cut could part go through the pattern as a whole.
            if "  " in t or " \n" in t or " \t" in t or " \r" in t or t[-1] == " " or _odd_blank.search(t):
                own = [t]
            else:
                own = t.replace(" ", "\x00 ").split("\x00")
                if not own[0]:
                    own = own[1:]
            many.append(len(own))
            pieces += own
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(many), np.int64)
        memo = self.piece_memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        new = list({p for p in pieces if p not in memo})
        if new:
            self._learn(new)
        found = list(map(memo.__getitem__, pieces))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(many)]
        return np.concatenate(found), np.diff(np.concatenate(([0], ends)))


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def _chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_CHARS bytes."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_CHARS)))
        yield at, to
        at = to


def encode_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, ids array<int>)`` of every row, without special tokens.

    Null and empty texts have the empty list; blank ones are encoded like any
    other. Strings of special tokens inside a text are ordinary text.
    """
    path = os.path.join(tokenizer_dir, vocabulary + ".json")
    out = pa.schema([("_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at, to in _chunks(b.column(1)):
                part = b.slice(at, to - at)
                ids, sizes = enc.encode(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], schema=out)

    pairs = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return pairs.mapInArrow(run, "_id long, ids array<int>").select(F.col("_id").alias(id_col), "ids")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, n_tokens int)`` of every row; 0 for null and empty texts."""
    path = os.path.join(tokenizer_dir, vocabulary + ".json")
    out = pa.schema([("_id", pa.int64()), ("n_tokens", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at, to in _chunks(b.column(1)):
                part = b.slice(at, to - at)
                _, sizes = enc.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int32))], schema=out)

    pairs = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return pairs.mapInArrow(run, "_id long, n_tokens int").select(F.col("_id").alias(id_col), "n_tokens")
