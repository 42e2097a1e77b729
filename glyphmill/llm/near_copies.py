"""Problem 1: near-duplicate messages.

Each text becomes the set of its items (words, or pairs of characters in
Japanese and Chinese). Texts with the same set form one class, and only the
classes are searched:

1. IDF weights of the items above a share of a language's texts, at most
   ``mean items / FLOOR`` per language;
2. improved consistent weighted sampling of each set under damped weights, its
   samples put into bands;
3. in a band a class stands as a sketch of 120 parities of its hashed items. Bands
   in which very many sketches stand are cut into cells of two blocks, so that no
   task gets all of one. The sketches travel in blocks, one from each task to each
   range of band keys, and are sorted and compared there in numpy. Of two sketches
   that meet, those with too many different
   parities are dropped at once; that bound is exact, since one odd parity takes
   one item that isn't shared. Classes of one sketch meet too;
4. verification of each candidate pair of classes by weighted Jaccard with
   unit weights, which is the alikeness that TESTDATA.md fixes;
5. membership joins that turn alike classes into pairs of rows, leaving out
   pairs of the same formatting group.

Two sets of weighted similarity w meet with probability ``1 - (1 - w**ROWS) **
BANDS``. Edits in rare items make w lower than the alikeness, which is why the
weights are damped: pairs at the threshold meet with 0.99 and more. With
``exact`` the candidates come from the rarest items instead: two sets alike by
the threshold share one of their ``n - ceil(threshold * n) + 1`` rarest items,
whatever the order of rarity, so that no pair is lost, at a cost that grows with
the square of the texts where the vocabulary stays the same.

A class is named by a 64-bit hash of its set. Among n classes about n^2 / 2^65
pairs share a name by chance; these would be taken for one class.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.ngrams import code_points
from glyphmill.session import materialize

#: Alikeness from which two texts belong together.
THRESHOLD = 0.73
#: Bits of the hash under which items are counted for the order of rarity.
COUNT_BITS = 20
#: Samples in a band, and bands.
ROWS, BANDS = 4, 16
#: Exponent on the IDF weight.
SHARPNESS = 0.5
#: Items in fewer than this share of a language's texts weigh the same.
FLOOR = 1 / 20
#: Bits of the filter that keeps sets without a candidate out of the verification.
FILTER_BITS = 1 << 23
#: Classes that one block of a crowded band holds, and bits of the hash under which bands are counted.
BLOCK, SLOT_BITS = 4000, 16
#: Keys of one part of the bands, classes that a task deals to the parts at once, and pairs of sketches that it compares at once.
PART_KEYS, ROUND, MEETINGS = 1_000_000, 100_000, 500_000
#: Bytes of text that are made into items at once, and the base of the items' hashes.
CHARACTERS, BASE = 1 << 20, np.uint64(0x9FB21C651E98DF25)
#: Entries of a worker's memo.
MEMO_ENTRIES = 60_000

_word = re.compile(r"[^\W_]+")
_PAIRED = ("ja", "zh")


def items_of(text: str | None, lang: str | None) -> list[str]:
    """Distinct items of a text, by the definition in TESTDATA.md, in the order of the text."""
    if text is None:
        return []
    words = _word.findall(text.casefold())
    if (lang or "").lower()[:2] in _PAIRED:
        joined = "".join(words)
        return list(dict.fromkeys([joined[i : i + 2] for i in range(len(joined) - 1)]))
    return list(dict.fromkeys(words))


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter or digit, and its value in the hashes of items."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000), _mix(np.arange(0x110000, dtype=np.uint64))


def _item_hashes(texts: list[str], paired: bool) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit hashes of the distinct items of all texts, in the order of the texts, and the number in each; what ``items_of`` gives one by one.

    The hash of an item is that of the polynomial of its characters' values.
    """
    letter, value = _characters()
    chars, length = code_points([t.casefold() for t in texts])
    at = np.flatnonzero(letter[chars])
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), length)[at]
    values = value[chars[at]]
    apart = owner[1:] != owner[:-1]
    with np.errstate(over="ignore"):
        if paired:
            begin = np.flatnonzero(~apart)
            values = values[begin] + values[begin + 1] * BASE if len(begin) else values[:0]
        else:
            begin = np.flatnonzero(np.append(True, apart | (at[1:] != at[:-1] + 1))[: len(at)])
            place = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
            powers = np.full(place.max(initial=0) + 1, BASE)
            powers[0] = 1
            values = np.add.reduceat(values * np.multiply.accumulate(powers)[place], begin) if len(begin) else values
        code = _mix(values) >> np.uint64(32)
    keyed = (owner[begin] << np.uint64(32)) | code
    order = np.argsort(keyed)
    keyed = keyed[order]
    runs = np.flatnonzero(np.append(True, keyed[1:] != keyed[:-1])[: len(keyed)])
    first = np.sort(np.minimum.reduceat(order, runs)) if len(runs) else order
    return code[first].astype(np.uint32), np.bincount(owner[begin][first].astype(np.int64), minlength=len(texts))


def _itemise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to sides: the 32-bit hashes of a side's items as bytes, and the 64-bit name of its class.

    The hashes stay in the order of the text, where phrases that texts share make them compress.
    """
    named: dict[tuple, int] = {}

    def sides(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, grp = b.column(0), b.column(1)
        slang, tlang = b.column(2).to_pylist(), b.column(3).to_pylist()
        for k in set(zip(slang, tlang)) - {k[:2] for k in named}:
            named.update({(*k, side): xxhash.xxh3_64_intdigest(f"{k[0]}\x1f{k[1]}\x1f{side}") for side in (0, 1)})
        for side, langs in ((0, slang), (1, tlang)):
            texts = b.column(4 + side).to_pylist()
            two = [(lang or "").lower()[:2] in _PAIRED for lang in langs]
            for paired in (False, True):
                rows = [i for i, (t, p) in enumerate(zip(texts, two)) if t is not None and p == paired]
                codes, size = _item_hashes([texts[i] for i in rows], paired)
                rows, size = np.array(rows, dtype=np.int64)[size > 0], size[size > 0]
                if not len(rows):
                    continue
                pair = np.array([named[slang[i], tlang[i], side] for i in rows.tolist()], dtype=np.uint64)
                ends = np.cumsum(size)
                with np.errstate(over="ignore"):
                    cid = _mix(np.add.reduceat(_mix(codes.astype(np.uint64) | np.uint64(1 << 32)), ends - size) ^ pair)
                low, high = _sketch(codes, size, pair)
                items = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32)), pa.py_buffer(codes)])
                own = pa.array([langs[i] or "" for i in rows.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in (ids, grp)), own, pa.array(cid.view(np.int64)), pa.array(pair.view(np.int64)), pa.array(low), pa.array(high), items], names=["row_id", "grp", "lang", "cid", "pair", "low", "high", "items"])

    for b in batches:
        read = np.cumsum(np.sum([pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (4, 5)], axis=0))
        at = 0
        while at < b.num_rows:
            # rows with CHARACTERS bytes of text at once, one at least
            stop = max(int(np.searchsorted(read, (read[at - 1] if at else 0) + CHARACTERS, side="right")), at + 1)
            yield from sides(b.slice(at, stop - at))
            at = stop


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All item hashes of a column of sets, and the number in each."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]) // 4
    first = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[first : first + 4 * sizes.sum()].view(np.uint32), sizes.astype(np.int64)


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a partition, by language; item -1 counts the texts."""
    seen: dict[str, list] = {}
    for b in batches:
        langs = np.array(b.column(0).to_pylist(), dtype=object)
        flat, sizes = _codes(b.column(1))
        for lang in set(langs):
            pick = langs == lang
            code, n = np.unique(flat[np.repeat(pick, sizes)], return_counts=True)
            seen.setdefault(lang, []).append((code.astype(np.int64), n))
            seen[lang].append((np.array([-1]), np.array([pick.sum()])))
    for lang, parts in seen.items():
        code, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "item", "df"])


def _verify(threshold: float):
    """Weighted Jaccard similarity with unit weights of the two sets of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (fa, na), (fb, nb) = _codes(b.column(2)), _codes(b.column(3))
            row = np.arange(b.num_rows, dtype=np.uint64) << np.uint64(32)
            both = np.concatenate((np.repeat(row, na) | fa, np.repeat(row, nb) | fb))
            both.sort()
            shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=b.num_rows)
            good = pa.array(shared >= threshold * (na + nb - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["ca", "cb"]).filter(good)

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sketch(flat: np.ndarray, size: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set 56 and 64 parities of its hashed items, turned by the name of its pair; the low byte is its size up to 255."""
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    with np.errstate(over="ignore"):
        place = _mix(flat.astype(np.uint64)) % np.uint64(120)
        bit = np.uint64(1) << ((place + np.uint64(8)) & np.uint64(63))
        turn = _mix(pair), _mix(pair ^ np.uint64(1))
    first = place < 56
    low, high = (np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), start) ^ t for half, t in zip((first, ~first), turn))
    return ((low & ~np.uint64(255)) | np.minimum(size, 255).astype(np.uint64)).view(np.int64), high.view(np.int64)


class WeightedSampler:
    """Improved consistent weighted sampling with the parameters drawn from hashes of the items."""

    def __init__(self, samples: int, seed: int = 1):
        self.samples, self.seed = samples, seed

    def _uniform(self, items: np.ndarray, stream: int) -> np.ndarray:
        base = _mix(items.astype(np.uint64)[:, None] * np.uint64(0x2545F4914F6CDD1D) + np.arange(self.samples, dtype=np.uint64)[None] * np.uint64(8) + np.uint64(stream + 1000 * self.seed))
        return ((base >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)

    def values(self, items: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each item and sample the value whose minimum over a set is the set's sample.

        The value is fixed by item, weight and sample, and two items share a
        value with negligible probability, so the minimum itself serves as the
        identity of the drawn (item, level) pair.
        """
        with np.errstate(over="ignore"):
            u = [self._uniform(items, k) for k in range(5)]
        r = -np.log(u[0] * u[1])
        c = -np.log(u[2] * u[3])
        level = np.floor(np.log(weights)[:, None] / r + u[4])
        return (np.log(c) - r * (level - u[4]) - r).astype(np.float32)


def _sign(weights: dict[str, tuple[np.ndarray, np.ndarray]], rare: float, rows: int, bands: int):
    """Classes to their sketches and one 32-bit key for each band."""
    sampler = WeightedSampler(rows * bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[dict, np.ndarray]] = {}
        done: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                if len(done) > 500_000:
                    done.clear()
                fresh = []
                for c in part.column(0).to_pylist():
                    fresh.append(c not in done)
                    done.add(c)
                if not all(fresh):
                    part = part.filter(pa.array(fresh))
                if part.num_rows:
                    yield from one(part, memo)

    def one(b: pa.RecordBatch, memo: dict) -> Iterator[pa.RecordBatch]:
        langs = np.array(b.column(1).to_pylist(), dtype=object)
        flat_all, sizes = _codes(b.column(2))
        for lang in set(langs):
            pick = np.flatnonzero(langs == lang)
            size = sizes[pick]
            codes, inverse = np.unique(flat_all[np.repeat(langs == lang, sizes)], return_inverse=True)
            slot, table = memo.get(lang, ({}, np.zeros((0, rows * bands), np.float32)))
            if len(slot) > MEMO_ENTRIES:
                slot, table = {}, table[:0]
            new = [c for c in codes.tolist() if c not in slot]
            if new:
                known, weight = weights.get(lang, (np.zeros(0, np.uint32), np.zeros(0)))
                code = np.array(new, dtype=np.uint32)
                w = np.full(len(code), rare)
                if len(known):
                    p = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    w = np.where(known[p] == code, weight[p], rare)
                slot.update(zip(new, range(len(table), len(table) + len(new))))
                table = np.concatenate((table, sampler.values(code, w)))
            memo[lang] = slot, table
            where = np.fromiter(map(slot.__getitem__, codes.tolist()), dtype=np.int64, count=len(codes))
            low = np.minimum.reduceat(table[where[inverse]], np.concatenate(([0], np.cumsum(size)[:-1])), axis=0)
            bits = low.view(np.uint32).astype(np.uint64).reshape(len(pick), bands, rows)
            with np.errstate(over="ignore"):
                key = _mix(b.column(3).to_numpy()[pick].view(np.uint64)[:, None] + np.arange(bands, dtype=np.uint64)[None] * np.uint64(0x9E3779B9))
                for k in range(rows):
                    key = _mix(key ^ bits[:, :, k])
            keys = pa.FixedSizeListArray.from_arrays(pa.array((key >> np.uint64(32)).astype(np.uint32).reshape(-1).view(np.int32)), bands).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(pick)) for c in (4, 5)), keys], names=["low", "high", "keys"])

    return run


def crowded_slots(signed: DataFrame, block: int, slot_bits: int) -> list[tuple[int, int]]:
    """``(slot, blocks)`` of the hashed bands that hold more than ``block`` rows beyond twice the mean.

    At most ``2 ** slot_bits`` rows reach the driver, whatever the number of bands.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << slot_bits, dtype=np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy().view(np.uint32) >> np.uint32(32 - slot_bits), minlength=1 << slot_bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    seen = signed.select("keys").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    mean = F.lit(2 / (1 << slot_bits))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    hot = seen.withColumn("excess", F.col("n") - total * mean).where(F.col("excess") > block)
    return [(r["slot"], r["blocks"]) for r in hot.select("slot", F.ceil(F.col("excess") / block).cast("int").alias("blocks")).collect()]


def _dealt(hot: list[tuple[int, int]], parts: int, slot_bits: int):
    """Signed sketches to blocks of keys and sketches, one for each part and round; a part is a range of keys.

    A sketch in a crowded band, of a slot in ``hot``, stands under the keys of all cells of two blocks that hold its own block.
    """
    blocks = np.ones(1 << slot_bits, dtype=np.int64)
    for slot, n in hot:
        blocks[slot] = max(n, 2)

    def cells(key: np.ndarray, owner: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            own = np.repeat((_mix(_mix(low[owner].view(np.uint64)) ^ high[owner].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64), n - 1)
            of = np.arange(len(own)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)
            of += of >= own
            cell = (np.minimum(own, of) << 32 | np.maximum(own, of)).astype(np.uint64)
            return (_mix(_mix(np.repeat(key, n - 1).astype(np.uint64)) ^ cell) >> np.uint64(32)).astype(np.uint32), np.repeat(owner, n - 1)

    def dealt(key: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        part = _part(key, parts)
        cuts = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(key)]).tolist(), len(key)]
        made = [_block(key[a:z], low[owner[a:z]], high[owner[a:z]]) for a, z in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(made, pa.binary())], names=["part", "block"])

    def rounds(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in (0, 1))
        key = np.concatenate([b.column(2).flatten().to_numpy() for b in batches]).view(np.uint32)
        owner = np.repeat(np.arange(len(low)), np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in batches]))
        n = blocks[key >> np.uint32(32 - slot_bits)]
        alone = n == 1
        yield dealt(key[alone], owner[alone], low, high)
        key, owner, n = key[~alone], owner[~alone], n[~alone]
        copies = np.cumsum(n - 1)
        at = 0
        while at < len(key):
            stop = max(int(np.searchsorted(copies, (copies[at - 1] if at else 0) + PART_KEYS, side="right")), at + 1)
            yield dealt(*cells(key[at:stop], owner[at:stop], n[at:stop], low, high), low, high)
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= ROUND:
                yield from rounds(held)
                held, rows = [], 0
        if rows:
            yield from rounds(held)

    return run


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 32-bit key, in rising order."""
    return (key.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)


def _block(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """Their number, the sorted keys' differences byte by byte, which compress, and both halves of the sketches."""
    steps = np.diff(key, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
    return b"".join((np.array([len(key)], dtype=np.int64).tobytes(), steps.tobytes(), low.tobytes(), high.tobytes()))


def _undealt(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and both halves of the sketches of a block."""
    n = int(np.frombuffer(block, dtype=np.int64, count=1)[0])
    steps = np.ascontiguousarray(np.frombuffer(block, dtype=np.uint8, count=4 * n, offset=8).reshape(4, n).T).view(np.uint32)[:, 0]
    low, high = (np.frombuffer(block, dtype=np.int64, count=n, offset=8 + 4 * n + 8 * k * n) for k in range(2))
    return np.cumsum(steps, dtype=np.uint32), low, high


def _near_sketches(key: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """``(lowl, highl, lowr, highr)``: the pairs of sketches of one key that can be alike, the lesser first.

    The bounds are exact; a size of 255 stands for that many items and more, and its parities are not looked at. The sketches
    of a key stand in the order of their sizes, so that each meets only those that are not too large for it.
    """
    size = low & 255
    place = (key.astype(np.uint64) << np.uint64(32)) | (size.astype(np.uint64) << np.uint64(24))
    order = np.argsort(place | (high.view(np.uint64) & np.uint64(0xFFFFFF)))
    key = key[order]
    shared = key[1:] == key[:-1]
    order = order[np.append(shared, False) | np.append(False, shared)] if len(key) else order
    place, low, high = place[order], low[order], high[order]
    # copies of a sketch that several tasks signed are neighbours, but for a clash of 24 bits, which only repeats a pair
    first = np.append(True, (place[1:] != place[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(place)]
    place, low, high = place[first], low[first], high[first]
    size = low & 255
    most = np.minimum(np.floor((np.arange(256) + 1e-6) / threshold), 255).astype(np.uint64)
    end = np.searchsorted(place, (place & ~np.uint64(0xFFFFFFFF)) | (most[size] << np.uint64(24)), side="right")
    partners = np.maximum(end - np.arange(1, len(place) + 1), 0)
    met = np.concatenate(([0], np.cumsum(partners)))
    at = 0
    while at < len(place):
        stop = max(int(np.searchsorted(met, met[at] + MEETINGS, side="right")) - 1, at + 1)
        n = partners[at:stop]
        l = np.repeat(np.arange(at, stop), n)
        r = l + 1 + np.arange(len(l)) - np.repeat(np.cumsum(n) - n, n)
        # unsigned, as the count of a negative number is that of its absolute value
        differ = np.bitwise_count(((low[l] ^ low[r]) & ~np.int64(255)).view(np.uint64)) + np.bitwise_count((high[l] ^ high[r]).view(np.uint64))
        near = (size[r] == 255) | (differ <= (size[l] + size[r]) * ((1 - threshold) / (1 + threshold)) + 1e-6)
        l, r = l[near], r[near]
        turned = (low[l] > low[r]) | ((low[l] == low[r]) & (high[l] > high[r]))
        l, r = np.where(turned, r, l), np.where(turned, l, r)
        apart = (low[l] != low[r]) | (high[l] != high[r])
        l, r = l[apart], r[apart]
        yield low[l], high[l], low[r], high[r]
        at = stop


def _met(threshold: float):
    """Blocks of whole parts to the pairs of sketches that share a key and can be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for part, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(part, []).append(block)
        while held:
            key, low, high = (np.concatenate(x) for x in zip(*map(_undealt, held.popitem()[1])))
            for pairs in _near_sketches(key, low, high, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["lowl", "highl", "lowr", "highr"])

    return run


def _banded_pairs(signed: DataFrame, bands: int, threshold: float, block: int, slot_bits: int) -> DataFrame:
    """``(lowl, highl, lowr, highr)``: the pairs of sketches that share a band and can be alike, once or more often."""
    # the parts grow with the keys, so that a task holds about as many of them at any size
    parts = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-signed.count() * bands // PART_KEYS))
    blocks = signed.select("low", "high", "keys").mapInArrow(_dealt(crowded_slots(signed, block, slot_bits), parts, slot_bits), "part int, block binary")
    return blocks.repartitionById(parts, F.col("part")).mapInArrow(_met(threshold), "lowl long, highl long, lowr long, highr long")


def item_counts(sides: DataFrame) -> np.ndarray:
    """How many texts hold an item, summed by the lowest COUNT_BITS bits of its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for b in batches:
            total += np.bincount(_codes(b.column(0))[0] & np.uint32((1 << COUNT_BITS) - 1), minlength=1 << COUNT_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    seen = sides.select("items").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << COUNT_BITS, dtype=np.uint32)
    out[seen["at"].to_numpy(dtype=np.int64)] = np.minimum(seen["n"].to_numpy(dtype=np.int64), 0xFFFFFFFF)
    return out


def _prefixes(counts: np.ndarray, threshold: float):
    """Classes to a row for each of their rarest items: key, class, size, place of the item, and item parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                yield one(b.slice(at, 2000))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        cid, pair = b.column(0).to_numpy(), b.column(2).to_numpy().view(np.uint64)
        flat, size = _codes(b.column(1))
        owner = np.repeat(np.arange(len(size)), size)
        code = flat.astype(np.uint64)
        order = np.lexsort(((counts[flat & np.uint32((1 << COUNT_BITS) - 1)].astype(np.uint64) << np.uint64(32)) | code, owner))
        start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        place = np.arange(len(flat)) - np.repeat(start, size)
        keys = size - np.maximum(np.ceil(threshold * size - 1e-6).astype(np.int64), 1) + 1
        first = place < np.repeat(keys, size)
        own = owner[first]
        with np.errstate(over="ignore"):
            key = _mix(pair[own] ^ _mix(code[order][first]))
            spread = _mix(code)
        bit = np.uint64(1) << (spread & np.uint64(63))
        upper = (spread >> np.uint64(6)) & np.uint64(1) > 0
        odd = [np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), start).view(np.int64)[own] for half in (upper, ~upper)]
        columns = [key.view(np.int64), cid[own], size[own].astype(np.int32), place[first].astype(np.int32), *odd]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["band", "cid", "n", "at", "odd_a", "odd_b"])

    return run


def _meeting(sides: DataFrame, threshold: float) -> DataFrame:
    """``(cidl, cidr)``: all pairs of classes that can be alike, once or more often."""
    keyed = sides.select("cid", "items", "pair").where(F.length("items") > 0).mapInArrow(_prefixes(item_counts(sides), threshold), "band long, cid long, n int, at int, odd_a long, odd_b long")
    # one exchange serves both sides of the join; copies of a class that several tasks keyed meet and vanish here
    keyed = keyed.repartition("band").dropDuplicates()
    left, right = (keyed.select("band", *(F.col(c).alias(c + side) for c in ("cid", "n", "at", "odd_a", "odd_b"))) for side in "lr")
    both = F.col("nl") + F.col("nr")
    # after the first shared item no more than the shorter rest can be shared; a parity that differs is an item that isn't
    enough = F.least(F.col("nl") - F.col("atl"), F.col("nr") - F.col("atr")) >= both * F.lit(threshold / (1 + threshold)) - 1e-6
    differ = F.bit_count(F.col("odd_al").bitwiseXOR(F.col("odd_ar"))) + F.bit_count(F.col("odd_bl").bitwiseXOR(F.col("odd_br")))
    near = (F.col("cidl") < F.col("cidr")) & enough & (differ <= both * F.lit((1 - threshold) / (1 + threshold)) + 1e-6)
    return left.join(right, "band").where(near).select("cidl", "cidr")


def item_weights(sides: DataFrame, sharpness: float, floor: float) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], float]:
    """IDF weights of the items above ``floor`` per language, and the weight of all others."""
    counts = materialize(sides.select("lang", "items").mapInArrow(_count_items, "lang string, item long, df long").groupBy("lang", "item").agg(F.sum("df").alias("df")))
    # no item is in more texts than there are, so what passes is bounded by mean items / floor in each language
    totals = counts.where("item = -1").select("lang", F.col("df").alias("n"))
    often = counts.where("item >= 0").join(totals, "lang").where(F.col("df") > F.col("n") * floor).toPandas()
    out = {}
    for lang, part in often.sort_values("item").groupby("lang"):
        idf = np.log1p(np.minimum(part["n"].to_numpy(dtype=float) / part["df"].to_numpy(dtype=float), 1 / floor))
        out[lang] = (part["item"].to_numpy().astype(np.uint32), idf**sharpness)
    return out, float(np.log1p(1 / floor) ** sharpness)


def _named(sets: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """Drops most sets that no row of ``names`` has, before they are shuffled.

    A bitmap of FILTER_BITS hashed names, at most FILTER_BITS / 62 rows, goes to
    all executors. When the corpus outgrows it, it lets more sets pass, and the
    result stays the same.
    """
    place = F.pmod(F.xxhash64(*by), F.lit(FILTER_BITS)).alias("at")
    words = names.select(place).groupBy(F.expr("at div 62").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 62 as int)))").alias("bits"))
    hit = sets.withColumn("at", place).withColumn("word", F.expr("at div 62")).join(F.broadcast(words), "word")
    return hit.where("(shiftright(bits, cast(at % 62 as int)) & 1) = 1").select(*sets.columns)


def _verified(sides: DataFrame, candidates: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """``(ca, cb)``: the classes of each candidate pair of names ``by`` that are alike."""
    ends = {side: [c + side for c in by] for side in "lr"}
    names = candidates.select(F.explode(F.array(*(F.struct(*(F.col(e).alias(c) for c, e in zip(by, ends[side]))) for side in "lr"))).alias("x")).select("x.*")
    rest = [c for c in ("cid", "pair", "items") if c not in by]
    sets = _named(sides.select(*by, *rest), names, by).groupBy("cid").agg(*(F.first(c).alias(c) for c in [*by, *rest] if c != "cid"))
    left, right = (sets.select(*(F.col(c).alias(e) for c, e in zip(by, ends[side])), *(F.col(c).alias(c + side) for c in rest)) for side in "lr")
    both = candidates.join(left, ends["l"]).join(right, ends["r"]).where("pairl = pairr")
    # two classes of one name meet twice, in either order
    same = F.lit(True)
    for l, r in zip(ends["l"], ends["r"]):
        same &= F.col(l) == F.col(r)
    both = both.where(~same | (F.col("cidl") < F.col("cidr")))
    return both.select(F.least("cidl", "cidr").alias("ca"), F.greatest("cidl", "cidr").alias("cb"), "itemsl", "itemsr").mapInArrow(_verify(threshold), "ca long, cb long")


class NearCopies:
    """Sides, classes and alike classes of a table, which the results below share.

    ``df`` needs source_lang, target_lang, source_text and translated_text;
    ``group`` is the key of a row's formatting group, pairs inside of which are
    left out. Null texts and texts without items are alike to nothing; null
    languages equal each other.
    """

    def __init__(
        self,
        df: DataFrame,
        group: Column,
        id_col: str = "memory_id",
        threshold: float = THRESHOLD,
        rows: int = ROWS,
        bands: int = BANDS,
        sharpness: float = SHARPNESS,
        floor: float = FLOOR,
        block: int = BLOCK,
        slot_bits: int = SLOT_BITS,
        exact: bool = False,
    ):
        grp = F.xxhash64(F.coalesce(group, F.concat(F.lit("\x00"), F.col(id_col).cast("string"))))
        base = df.select(F.col(id_col).cast("long").alias("row_id"), grp.alias("grp"), "source_lang", "target_lang", "source_text", "translated_text").where("row_id IS NOT NULL")
        self.sides = sides = materialize(base.mapInArrow(_itemise, "row_id long, grp long, lang string, cid long, pair long, low long, high long, items binary"))
        if exact:
            #: ``(ca, cb)``: the pairs of classes that are alike.
            self.alike = _verified(sides, materialize(_meeting(sides, threshold).distinct()), ["cid"], threshold)
        else:
            weights, rare = item_weights(sides, sharpness, floor)
            signed = materialize(sides.select("cid", "lang", "items", "pair", "low", "high").mapInArrow(_sign(weights, rare, rows, bands), "low long, high long, keys array<int>"))
            twins = sides.groupBy("low", "high").agg(F.min("cid").alias("one"), F.max("cid").alias("two")).where("one <> two")
            met = _banded_pairs(signed, bands, threshold, block, slot_bits).distinct().unionByName(twins.select(F.col("low").alias("lowl"), F.col("high").alias("highl"), F.col("low").alias("lowr"), F.col("high").alias("highr")))
            self.alike = _verified(sides, materialize(met), ["low", "high"], threshold)

    def pairs(self) -> DataFrame:
        """``(a, b)``: ids of all pairs of rows, smaller first, that are alike by the threshold."""
        # formatting groups inside a class: pairs are formed between groups, never between the rows of one
        members = self.sides.select("cid", "grp", "row_id")
        parts = members.select("cid", "grp").distinct()
        several = parts.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cid").alias("ca"), F.col("cid").alias("cb"))
        part_a, part_b = (parts.select(F.col("cid").alias(c), F.col("grp").alias(f"g{c}")) for c in ("ca", "cb"))
        linked = self.alike.unionByName(several).join(part_a, "ca").join(part_b, "cb").where((F.col("gca") != F.col("gcb")) & ((F.col("ca") != F.col("cb")) | (F.col("gca") < F.col("gcb"))))
        row_a, row_b = (members.select(F.col("cid").alias(c), F.col("grp").alias(f"g{c}"), F.col("row_id").alias(f"r{c}")) for c in ("ca", "cb"))
        pairs = linked.select("ca", "gca", "cb", "gcb").join(row_a, ["ca", "gca"]).join(row_b, ["cb", "gcb"])
        return pairs.select(F.least("rca", "rcb").alias("a"), F.greatest("rca", "rcb").alias("b")).where("a <> b").distinct()

    def links(self) -> DataFrame:
        """``(class_id, n_rows, n_links)``: of each class its smallest row id, its rows, and how many other classes are alike.

        A row with two texts is a member of two classes, one for each side.
        Copies are not expanded, so that the result never has more rows than
        there are texts.
        """
        ends = self.alike.select(F.explode(F.array("ca", "cb")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
        sizes = self.sides.groupBy("cid").agg(F.min("row_id").alias("class_id"), F.count("*").alias("n_rows"))
        return sizes.join(ends, "cid", "left").select("class_id", "n_rows", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_copy_pairs(df: DataFrame, group: Column, id_col: str = "memory_id", threshold: float = THRESHOLD, **search: object) -> DataFrame:
    """``(a, b)`` of ``NearCopies``; ``search`` takes its further parameters."""
    return NearCopies(df, group, id_col, threshold, **search).pairs()
