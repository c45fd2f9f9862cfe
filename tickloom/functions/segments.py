"""Order statistics and first crossings of whole series, as vectorised kernels on arrays.

``by_series`` deals rows by key, sorts them and gives a kernel the arrays of all series that an Arrow batch
completes, end to end with their bounds; only the columns that are needed are held until a series is
over. No kernel here takes a Python step a row: merges and trees go level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def counts_below(x: np.ndarray) -> np.ndarray:
    """For each value, how many earlier ones are below it (NaN is below nothing and above all), by counting in merges.

    Values in their order, stably dealt to halves of ever smaller blocks of places: in each block a value of the
    right half has so many smaller ones in the left half as stand before it. One pass of the array a level.
    """
    n = len(x)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = np.lexsort((-np.arange(n), x))  # of equal values the later place first, so that equals don't count
    for k in range(int(n - 1).bit_length() - 1, -1, -1):
        right = (order >> k) & 1
        lefts = np.cumsum(1 - right)
        block = order >> (k + 1) << (k + 1)  # where the places and the rows of the value's block begin
        before = np.where(block > 0, lefts[block - 1], 0)
        own = lefts - before
        out[order[right == 1]] += own[right == 1]
        half = order >> k << k
        place = half + np.where(right == 1, np.arange(n) - block - own, own - 1)
        dealt = np.empty_like(order)
        dealt[place] = order
        order = dealt
    out[np.isnan(x)] = 0
    return out


def first_above(values: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each query the first place from ``start`` on whose value is above ``level``; len(values) if there is none.

    A tree of maxima over aligned blocks: queries climb together to the first block that holds a larger value, then descend.
    """
    n = len(values)
    tree = [np.where(np.isnan(values), -np.inf, values)]
    while len(tree[-1]) > 1:
        last = tree[-1]
        tree.append(np.maximum.reduceat(last, np.arange(0, len(last), 2)))
    at, found = np.array(start, np.int64), np.full(len(start), -1)
    for k, nodes in enumerate(tree):
        # a right child is looked at here; a left one is seen with its parent, unless it is the top
        look = np.flatnonzero((found < 0) & (at < len(nodes)) & ((at & 1 == 1) | (k == len(tree) - 1)))
        hit = nodes[at[look]] > level[look]
        found[look[hit]] = k
        up = np.flatnonzero(found < 0)
        at[up] = (at[up] + 1) >> 1  # past a right child without a larger value; a left one's parent stays the same
    for k in range(len(tree) - 1, 0, -1):
        down = np.flatnonzero(found == k)
        child = at[down] * 2
        at[down] = np.where(tree[k - 1][child] > level[down], child, child + 1)
        found[down] = k - 1
    return np.where(found == 0, at, n)


def ends_of(bounds: np.ndarray) -> np.ndarray:
    """For each row where its series ends."""
    return np.repeat(bounds[1:], np.diff(bounds))


def later_high(high: np.ndarray, close: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bar the first later bar of its series with a high above its close, else the series' last bar; and whether there is one."""
    n, ends = len(high), ends_of(bounds)
    found = first_above(high, np.arange(1, n + 1), close)
    return np.where(found < ends, found, ends - 1), found < ends


#: Numbers by column, one series after the other, the bounds of the series, and the rows: columns to add, as arrays or Arrow arrays.
Kernel = Callable[[dict[str, np.ndarray], np.ndarray, pa.Table], dict]


def by_series(df: DataFrame, inputs: list[str], kernel: Kernel, added: dict[str, str], key: str = "code", order: str = "ts") -> DataFrame:
    """df with columns (name: double, long, boolean or string) that a kernel makes of whole series in order. NULL inputs come as NaN, masked results go as NULL."""
    kinds = {"double": T.DoubleType(), "boolean": T.BooleanType(), "long": T.LongType(), "string": T.StringType()}
    arrow = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, kinds[k]) for n, k in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if not rows.num_rows:
                return
            rows = rows.combine_chunks()
            keys = rows.column(key).dictionary_encode().combine_chunks()
            codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]))
            values = {c: rows.column(c).cast(pa.float64()).to_numpy() for c in inputs}
            made = kernel(values, bounds, rows)
            out = rows
            for name, kind in added.items():
                x = made[name]
                column = x if isinstance(x, pa.ChunkedArray) else pa.array(np.ma.getdata(x), mask=np.ma.getmaskarray(x))
                out = out.append_column(name, column.cast(arrow[kind]))
            yield from out.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(key))
            last = column[-1].as_py()
            codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            others = np.flatnonzero(codes != codes[-1])
            begin = int(others[-1]) + 1 if len(others) else 0  # rows of the last series stay until another one begins
            if begin or held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != last:
                yield from done(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield from done(pa.Table.from_batches(held))

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)
