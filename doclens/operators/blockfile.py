"""Sorted tables on shared storage that tasks look keys up in, a block at a time.

A table of any size is range-partitioned by its key and written as Arrow files of some thousand rows.
Only the first key of each block travels with a function; a task finds the blocks its batch asks for and
reads those, memory-mapped where the folder is a local path or a mount. So an executor's memory does not
grow with the table, and rows need not be shuffled to meet it, which a stream could not do.
"""

from __future__ import annotations

import sys
import uuid
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.session import scratch_path

# Rows of a block, blocks of a table (more rows make longer blocks), and blocks a task keeps open.
BLOCK, MAX_BLOCKS, OPEN = 1 << 16, 100_000, 16

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class BlockFile:
    """A written table: its folder, and the first key and file of each block in order of the keys."""

    folder: str
    firsts: list
    names: list[str]

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Blocks of one table as a task reads them; the last ``OPEN`` stay open."""

    def __init__(self, table: BlockFile) -> None:
        self.table = table
        self.store, self.path = fs.FileSystem.from_uri(table.folder)
        self.open: OrderedDict[int, pa.Table] = OrderedDict()

    def block(self, number: int) -> pa.Table:
        if number in self.open:
            self.open.move_to_end(number)
            return self.open[number]
        name = f"{self.path}/{self.table.names[number]}"
        local = isinstance(self.store, fs.LocalFileSystem)
        rows = ipc.open_file(pa.memory_map(name) if local else self.store.open_input_file(name)).read_all()
        self.open[number] = rows
        if len(self.open) > OPEN:
            self.open.popitem(last=False)
        return rows

    def parts(self, keys: list) -> Iterator[tuple[int, int, int]]:
        """(block, start, stop) of sorted keys: which block holds them, if any does."""
        start = 0
        while start < len(keys):
            block = bisect_right(self.table.firsts, keys[start]) - 1
            after = block + 1
            stop = bisect_left(keys, self.table.firsts[after], lo=start) if after < len(self.table.firsts) else len(keys)
            if block >= 0:
                yield block, start, stop
            start = stop

    def values(self, keys: pa.Array, name: str) -> pa.Array:
        """The value of each of some distinct text keys, null where the table has none."""
        if not len(self.table.firsts) or not len(keys):
            return pa.nulls(len(keys))
        order = pc.array_sort_indices(keys.cast(pa.binary()))
        ordered = keys.take(order)
        listed = ordered.cast(pa.binary()).to_pylist()
        at, found = [], []
        for block, start, stop in self.parts(listed):
            rows = self.block(block)
            known = rows.column(0).combine_chunks()
            at.append(order[start:stop])
            found.append(rows.column(name).combine_chunks().take(pc.index_in(ordered[start:stop], value_set=known)))
        if not found:
            return pa.nulls(len(keys))
        places = np.concatenate([a.to_numpy() for a in at])
        back = np.full(len(keys), -1)
        back[places] = np.arange(len(places))
        return pa.concat_arrays(found).take(pa.array(back, mask=back < 0))


def write_blocks(table: DataFrame, key: str, block: int = BLOCK) -> BlockFile:
    """Write a table, sorted by ``key`` (text or whole numbers, not null), as blocks of some ``block``
    rows; rows of one key stay in one block. The columns are the key, then the others by name."""
    spark = table.sparkSession
    folder = scratch_path(spark, "blocks")
    columns = [key, *sorted(c for c in table.columns if c != key)]
    block = max(block, table.count() // MAX_BLOCKS)
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        held: list[pa.RecordBatch] = []
        first_type = pa.string() if kind == "string" else pa.int64()

        def made(rows: pa.Table) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.arrow"
            with store.open_output_stream(f"{path}/{name}", compression=None) as out, ipc.new_file(out, rows.schema) as file:
                file.write_table(rows.combine_chunks())
            first = rows.column(0)[0].as_py()
            return pa.RecordBatch.from_arrays([pa.array([first], first_type), pa.array([name])], ["first", "name"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size <= block:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column(0).combine_chunks()
            starts = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
            begin = 0
            while len(rows) - begin > block:
                later = starts[starts > begin]
                fit = later[later <= begin + block]
                cut = int(fit[-1]) if len(fit) else int(later[0]) if len(later) else len(rows)
                if cut == len(rows):
                    break
                yield made(rows.slice(begin, cut - begin))
                begin = cut
            held, size = rows.slice(begin).to_batches(), len(rows) - begin
        if size:
            yield made(pa.Table.from_batches(held))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = table.select(*columns).repartitionByRange(parts, F.col(key)).sortWithinPartitions(*columns)
    listed = ordered.mapInArrow(run, f"first {'string' if kind == 'string' else 'bigint'}, name string").collect()
    pairs = sorted((row["first"].encode() if kind == "string" else row["first"], row["name"]) for row in listed)
    return BlockFile(folder, [first for first, _ in pairs], [name for _, name in pairs])
