"""Streams of lines: late data, latest state, tracking and expiry, upserts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Misses after which a block is gone, and the gate of a match.
LEAST_MISSES, GATE_HEIGHTS = 2, 2.5

EVENTS = "session_id string, frame_id long, block_id long, event string, text string"
_STATE = "blocks string, next_id long, frame_id long"


@dataclass
class Block:
    """What is known of one block between frames."""

    id: int
    text: str
    x1: int
    y1: int
    x2: int
    y2: int
    misses: int = 0


def _near(b: Block, r: tuple) -> float | None:
    """Distance of the centres if it is inside the gate."""
    h = max(1.0, (max(1, b.y2 - b.y1) + max(1, r[4] - r[2])) / 2.0)
    dx, dy = (b.x1 + b.x2 - r[1] - r[3]) / 2.0, (b.y1 + b.y2 - r[2] - r[4]) / 2.0
    d = (dx * dx + dy * dy) ** 0.5
    return d if d <= GATE_HEIGHTS * h else None


def advance(blocks: list[Block], next_id: int, rows: list[tuple]) -> tuple[list[Block], int, list[tuple[int, str, str]]]:
    """One frame further: rows (text, x1, y1, x2, y2) are matched one to one with the blocks, nearest first; events (id, kind, text)."""
    pairs = sorted((d, b.id, k) for b in blocks for k, r in enumerate(rows) if (d := _near(b, r)) is not None)
    by_id, taken, events = {b.id: b for b in blocks}, {}, []
    used: set[int] = set()
    for _, i, k in pairs:
        if i not in used and k not in taken:
            used.add(i)
            taken[k] = i
    out = []
    for k, r in enumerate(rows):
        i = taken.get(k)
        if i is None:
            next_id += 1
            events.append((next_id, "appeared", r[0]))
            out.append(Block(next_id, *r))
        else:
            if "".join(by_id[i].text.split()).casefold() != "".join(r[0].split()).casefold():
                events.append((i, "changed", r[0]))
            out.append(Block(i, *r))
    for b in blocks:
        if b.id in used:
            continue
        b.misses += 1
        if b.misses >= LEAST_MISSES:
            events.append((b.id, "gone", b.text))
        else:
            out.append(b)
    return out, next_id, events


def track(lines: DataFrame) -> DataFrame:
    """Events of the blocks of each session: appeared, changed, gone.

    ``lines`` is a stream of (session_id, frame_id, line_no, text, x1, y1, x2,
    y2). One state per session, since the matching of a frame is global in it;
    frames at or before the state's are late and dropped. The state holds the
    blocks of one screen, so it doesn't grow with the stream.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, next_id, at = state.get if state.exists else ("[]", 0, -1)
        blocks = [Block(**b) for b in json.loads(kept)]
        rows = pd.concat(list(parts))
        out = []
        for frame, part in rows.groupby("frame_id"):
            if frame <= at:
                continue
            part = part.sort_values("line_no")
            lines_ = [(t or "", int(a), int(b), int(c), int(d)) for t, a, b, c, d in zip(part["text"], part["x1"], part["y1"], part["x2"], part["y2"]) if pd.notna(a)]
            blocks, next_id, events = advance(blocks, next_id, lines_)
            out += [(key[0], int(frame), *e) for e in events]
            at = int(frame)
        state.update((json.dumps([asdict(b) for b in blocks]), next_id, at))
        yield pd.DataFrame(out, columns=["session_id", "frame_id", "block_id", "event", "text"])

    return lines.groupBy("session_id").applyInPandasWithState(run, EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def track_batch(lines: DataFrame) -> DataFrame:
    """The same events from a bounded table, for replays and tests."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks: list[Block] = []
        next_id, out = 0, []
        for frame, part in rows.groupby("frame_id"):
            part = part.sort_values("line_no")
            blocks, next_id, events = advance(blocks, next_id, [(t or "", int(a), int(b), int(c), int(d)) for t, a, b, c, d in zip(part["text"], part["x1"], part["y1"], part["x2"], part["y2"]) if pd.notna(a)])
            out += [(key[0], int(frame), *e) for e in events]
        return pd.DataFrame(out, columns=["session_id", "frame_id", "block_id", "event", "text"])

    return lines.groupBy("session_id").applyInPandas(run, EVENTS)


def once(stream: DataFrame, ids: list[str], at: str, late: str) -> DataFrame:
    """Drops rows sent again under new ids, within the allowed lateness."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(ids)


def rates(stream: DataFrame, at: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Rows in each window and group; a window closes when the watermark passes it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def newest(stream: DataFrame, key: list[str], version: list[str], value: str) -> DataFrame:
    """The value of the highest version of each key so far, for complete or update mode."""
    return stream.groupBy(*key).agg(F.max_by(value, F.struct(*version)).alias(value))


def upsert_into(path: str, keys: list[str], order: list[str]):
    """A ``foreachBatch`` function that merges each batch into a Parquet table of versions.

    Every batch is written to its own folder and the pointer file is replaced
    afterwards, so a lost driver leaves the former version whole and a batch
    that is sent again has no effect.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        made = sorted(int(s.getPath().getName()[1:]) for s in (fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)) else []) if s.getPath().getName().startswith("v"))
        done = [k for k in made if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{k}/_SUCCESS"))]
        if done and done[-1] >= number:
            return
        rows = batch if not done else batch.unionByName(spark.read.parquet(f"{path}/v{done[-1]}"))
        columns = [c for c in rows.columns if c not in keys]
        rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_x")).select(*keys, "_x.*").write.mode("overwrite").parquet(f"{path}/v{number}")

    return merge
