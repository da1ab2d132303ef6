"""Shared handling of embedding tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not zero, and all components finite."""
    square = F.aggregate(embedding, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    broken = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~broken & (square > 0), F.lit(False))


def units(column: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision, of list arrays of one length."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    largest = np.abs(values).max(1, keepdims=True)
    values = values / largest  # so that squares neither overflow nor vanish
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def unit_rows(rows: DataFrame, keys: list[str], dtype: str = "<f4") -> DataFrame:
    """(keys, unit) of usable rows: the unit vector as bytes. Vectors of different lengths never meet."""
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "unit binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("embedding").value_lengths())
            out: list[bytes | None] = [None] * batch.num_rows
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                for i, unit in zip(at.tolist(), units(batch.column("embedding").take(pa.array(at)))):
                    out[i] = unit.astype(dtype).tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], names=[*keys, "unit"])

    return rows.select(*keys, "embedding").where(usable(F.col("embedding"))).mapInArrow(run, schema)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys from batches sorted by them; holds one run and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        heads = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for lo, hi in zip(heads, heads[1:]):
            key = tuple(c[lo] for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def stacked(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """Binary rows of one length as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def flat_lists(lists: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0), kind))
