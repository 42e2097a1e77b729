"""Queries cover all rows of their tables."""

import shutil

import pyarrow as pa
import pyarrow.parquet as pq

from glyphmill.plans import catalogue


def test_resolution_chain_takes_the_whole_memory(spark, small, tmp_path):
    shutil.copy(f"{small}/terms.parquet", tmp_path)
    memory, blocks = (pq.read_table(f"{small}/{t}.parquet") for t in ("memory", "tracked_block"))
    memory, blocks = memory.slice(0, 100), blocks.slice(0, 100)
    texts = pa.array([f"a text of its own {k}." for k in range(100)])
    memory = memory.set_column(memory.column_names.index("memory_id"), "memory_id", pa.array(range(100)))
    for name, column in (("source_text", texts), ("translated_text", texts)):
        memory = memory.set_column(memory.column_names.index(name), name, column)
    pq.write_table(memory, tmp_path / "memory.parquet")
    pq.write_table(blocks.set_column(blocks.column_names.index("text"), "text", texts), tmp_path / "tracked_block.parquet")
    got = {name: catalogue.queries()[name](spark, str(tmp_path)).where("step = 'user'").count() for name in ("resolution_chain", "resolution_chain_all")}
    assert got == {"resolution_chain": 2, "resolution_chain_all": 100}


def test_frames_are_compared_whole(spark, small):
    got = catalogue.queries()["matched_lines"](spark, small).collect()
    assert {(r["prev_id"] % 2, r["line_id"] % 2) for r in got} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert {r["id"] % 2 for r in catalogue.queries()["unshared_lines_all"](spark, small).collect()} == {0, 1}
