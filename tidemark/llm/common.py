"""Shared pieces of the corpus operators: folds, hashing and word tables of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: \x20 and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a batch are worked on in runs of about so many bytes, so that memory follows this and the longest text.
RUN_BYTES = 1 << 21


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def word_list(text: Column) -> Column:
    """Words of a text (null: none) as an array, without user functions."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(column: pa.Array, limit: int = RUN_BYTES, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, byte offsets, bytes) of runs of rows; null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + rows + 1] if rows else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if rows and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + most)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


@dataclass
class Words:
    """Words of a run: hash, owning row (from 0), byte range; ``first`` has each row's first word, and the count at the end."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    heads: tuple[np.ndarray, ...] = ()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_RADIX = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, RUN_BYTES + 1)
        for name, base in (("up", _RADIX), ("down", pow(_RADIX, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = True, drop: np.ndarray | None = None, heads: tuple[int, ...] = ()) -> Words:
    """Split a run into words and hash each to 64 bits, A-Z lower-cased.

    ``drop`` marks byte values that count as white space; ``heads`` asks for hashes of the first so many bytes of each word too.
    """
    n = len(data)
    rows = len(offsets) - 1
    empty = np.zeros(0, np.int64)
    if not n:
        return Words(np.zeros(0, np.uint64), empty, empty, empty, np.zeros(rows + 1, np.int64), tuple(np.zeros(0, np.uint64) for _ in heads))
    if lower:
        data = _LOWER[data]
    space = (_IS_SPACE if drop is None else _IS_SPACE | drop)[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    word = ~space
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    start, end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    up, down = _tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])

    def hashes(stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    beginnings = tuple(mix(hashes(np.minimum(end, start + k)) + np.uint64(k)) for k in heads)
    return Words(hashes(end), np.searchsorted(offsets, start, side="right") - 1, start, end, np.searchsorted(start, offsets), beginnings)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of ``counts`` values each."""
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
