"""Rows packed in blocks, so that every block of one table meets every block of another without copies that are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.operators.state import settle

#: Blocks that a task meets one after the other at most, and tasks that a meeting should make if there are blocks enough.
TURN, TASKS = 16, 64


def packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(no, n, block): rows dealt by their key, about `size` of them in a block, each a compressed Arrow stream; settled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, no = [], 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["no", "n", "block"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size + size // 4 - n)  # hashing deals unevenly
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == size + size // 4:
                    yield block()
                    held, n, no = [], 0, no + 1
        if held:
            yield block()

    parts = max(1, -(-rows.count() // size))
    return settle(rows.repartition(parts, key).mapInArrow(pack, "no long, n long, block binary"))


def unpacked(block: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(block) as rows:
        return rows.read_all().to_pandas()


def meeting(few: DataFrame, many: DataFrame) -> DataFrame:
    """(no, a, b): each block of `few` with each one of `many` (both as of `packed`).

    Tasks read their blocks where these are settled; nothing is shuffled. A task has one part of `few` and up to TURN parts of `many`.
    """
    parts, turns = (max(1, df.rdd.getNumPartitions()) for df in (few, many))  # an empty table has none
    dealt = many.select(F.col("block").alias("b")).coalesce(min(turns, max(-(-turns // TURN), -(-TASKS // parts))))
    return dealt.hint("shuffle_replicate_nl").crossJoin(few.select("no", F.col("block").alias("a")))
