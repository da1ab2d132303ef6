"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Only A-Z become lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn labels from: crc32 of the id as text, mod 4, is 2 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def uniform(*columns: Column | str) -> Column:
    """A repeatable number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 48)) / float(1 << 48)


def char_ngrams(items: list[bytes], sizes: Iterable[int], buckets: int, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (index of the item, hash bucket) of every n-gram of every item."""
    data = np.frombuffer(b"".join(items), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    owner = np.repeat(np.arange(len(items)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    for size in sizes:
        n = len(data) - size + 1
        if n <= 0:
            continue
        code = np.full(n, 1469598103934665603 + 7919 * (seed + size), np.uint64)
        for k in range(size):
            code = code * np.uint64(1099511628211) + data[k : k + n]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
        whole = np.arange(n) + size <= end[:n]
        yield owner[:n][whole], (code[whole] % np.uint64(buckets)).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and, but for single longer texts, ``size`` bytes of ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        fits = int(np.searchsorted(ends, before + size, "right"))
        stop = max(at + 1, min(at + rows, fits))
        yield batch.slice(at, stop - at)
        at = stop


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (runs without ASCII white space), the word number of every place, and the words of each text."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, parents = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(parents[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), counts
