"""Texts in groups of a few MB, as compressed Arrow streams in a checkpoint."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import saved


def pack(docs: DataFrame, group_bytes: int) -> DataFrame:
    """(g, pack): one row a group of neighbouring rows of ``docs`` whose texts have about ``group_bytes``.

    The groups are a checkpoint, so a task that is run again later finds them as
    they were, and their numbers too.  Nothing is shuffled.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))
        number = TaskContext.get().partitionId() << 32

        def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal number
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, parts[0].schema, options=options) as out:
                out.write_table(pa.Table.from_batches(parts).combine_chunks())
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([sink.getvalue()], pa.binary())], ["g", "pack"])

        waiting: list[pa.RecordBatch] = []
        pending = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(names.index("text"))), 0).to_pylist()
            first = 0
            for k, size in enumerate(sizes):
                pending += size
                if pending >= group_bytes:
                    yield packed([*waiting, batch.slice(first, k + 1 - first)])
                    waiting, pending, first = [], 0, k + 1
            if first < batch.num_rows:
                waiting.append(batch.slice(first))
        if waiting:
            yield packed(waiting)

    return saved(docs.mapInArrow(run, "g long, pack binary"))


def each_pack(f: Callable[[int, list[bytes]], pa.Table]) -> Callable:
    """For mapInArrow: f(g, [pack]) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, pack in zip(batch.column("g"), batch.column("pack")):
                yield from f(g.as_py(), [pack.as_py()]).to_batches()

    return run


def unpacked(packs: list[bytes]) -> pa.Table:
    """All rows of a group."""
    table = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs])
    return table.combine_chunks()
