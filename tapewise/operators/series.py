"""Columns computed over whole series (an asset's bars in order) in one pass.

Rows are partitioned by the series and sorted, once; every task then reads its series
as Arrow batches, a bounded number of cells at a time, and steps from
:mod:`tapewise.functions.sliding` add columns. A series is held whole, so it has to be
bounded, as panels are by the trading calendar: they are unique on (asset, session).
Window functions over the same series that run before share the partitioning and sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapewise.functions.sliding import Step

#: Cells of a matrix, and rows gathered before a pass.
CELLS, ROWS = 1 << 20, 1 << 17


def in_series(df: DataFrame, key: str | None = "asset_id", order: str = "ts") -> DataFrame:
    """``df`` partitioned by series and sorted; one series where there is no key."""
    if key is None:
        return df.coalesce(1).sortWithinPartitions(order)
    return df.repartition(key).sortWithinPartitions(key, order)


def _starts(keys: pa.ChunkedArray | pa.Array | None, n: int) -> np.ndarray:
    if keys is None or n < 2:
        return np.zeros(min(n, 1), dtype=np.int64)
    codes = pc.dictionary_encode(keys, null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])


def _computed(table: pa.Table, starts: np.ndarray, inputs: list[str], outputs: list[str], steps: list[Step]) -> dict[str, np.ndarray]:
    n = table.num_rows
    flat = {c: pc.cast(table.column(c), pa.float64()).to_numpy().astype(float) for c in inputs}  # null becomes NaN
    out = {c: np.full(n, np.nan) for c in outputs}
    ends = np.append(starts[1:], n)
    lengths = ends - starts
    first = 0
    while first < len(starts):
        last, longest = first, 0
        while last < len(starts) and (last == first or (last - first + 1) * max(longest, lengths[last]) <= CELLS):
            longest = max(longest, lengths[last])
            last += 1
        inside = np.arange(longest) < lengths[first:last, None]
        a, b = starts[first], ends[last - 1]
        m = {}
        for c in inputs:
            m[c] = np.full(inside.shape, np.nan)
            m[c][inside] = flat[c][a:b]
        with np.errstate(all="ignore"):
            for step in steps:
                m |= step(m)
        for c in outputs:
            out[c][a:b] = m[c][inside]
        first = last
    return out


def add_series(df: DataFrame, steps: list[Step], inputs: list[str], outputs: list[str], key: str | None = "asset_id",
               drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (see :func:`in_series`) with the double columns that ``steps`` compute; infinite results are missing."""
    kept = [c for c in df.columns if c not in outputs and c not in drop]
    read = list(dict.fromkeys([*kept, *inputs]))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.DoubleType()) for c in outputs])

    def done(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        starts = _starts(None if key is None else table.column(key), table.num_rows)
        new = _computed(table, starts, inputs, outputs, steps)
        arrays = [table.column(c) for c in kept] + [pa.array(new[c], mask=~np.isfinite(new[c])) for c in outputs]
        yield from pa.Table.from_arrays(arrays, names=[*kept, *outputs]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows == 0:
                continue
            cut = 0
            if rows + b.num_rows >= ROWS and key is not None:
                own = b.column(key)
                cut = int(_starts(own, b.num_rows)[-1])
                if cut == 0 and held and own[0] != held[-1].column(key)[held[-1].num_rows - 1]:
                    yield from done(held)
                    held, rows = [], 0
            if cut:
                yield from done([*held, b.slice(0, cut)])
                held, rows = [], 0
            held.append(b.slice(cut))
            rows += b.num_rows - cut
        if held:
            yield from done(held)

    return df.select(*read).mapInArrow(run, schema)
