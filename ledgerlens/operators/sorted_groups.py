"""Whole groups of rows as numpy slices: many groups an Arrow batch, without one frame a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import shuffle_partitions


def by_group(rows: DataFrame, keys: Sequence[str], run: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str, rows_at_once: int = 1 << 16, order: Sequence[str] = ()) -> DataFrame:
    """run(table, starts) over whole groups, many groups at a time; starts: each group's first row, and the row count.

    A group's rows are sorted by the columns of order. Nulls of a key are one group. A task holds rows_at_once rows
    and the largest group.
    """

    def stream(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        count = 0
        wanted = rows_at_once
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= wanted:
                table = pa.Table.from_batches(held).combine_chunks()
                at = starts(table, keys)
                if len(at) > 2:  # the last group may go on
                    yield run(table.slice(0, at[-2]), at[:-1])
                    table = table.slice(at[-2]).combine_chunks()
                held = table.to_batches()
                count = table.num_rows
                wanted = max(rows_at_once, 2 * count)  # so that a long group is looked at a few times only
        if count:
            table = pa.Table.from_batches(held).combine_chunks()
            yield run(table, starts(table, keys))

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(stream, schema)


def starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The rows at which a sorted table's groups begin, and its row count."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        new[1:] = False
        for k in keys:
            x = table.column(k).combine_chunks()
            if x.null_count or not pa.types.is_primitive(x.type):
                x = x.dictionary_encode(null_encoding="encode").indices
            x = x.to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
