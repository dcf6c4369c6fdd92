"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's units are its paragraphs, the long ones cut after sentences; equal units are told apart by
their number. A sketch has ``cells`` cells in three parts; every digest is added to one cell of each
part: a count, a sum of digests and a sum of check values. Sketches of two versions subtract cell by
cell; what both have cancels, and cells left with one digest are peeled until all are empty, which
gives the digests that differ on either side. Where too many differ, peeling stops short and the
comparison is repeated with sketches four times as large.

``next_documents`` brings the text of the following document by id to each document: ids are cut into
ordered buckets of about equal size, each text goes to its bucket once, and the first of a bucket also
to the bucket before. A task reads its buckets in order and holds a few texts at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batch, mix

CELLS, PARTS, GROWTH = 24, 3, 4
#: Rows of a bucket, and the most buckets; beyond it buckets grow instead, which are only streamed.
BUCKET_ROWS, MOST_BUCKETS, COARSE = 400, 65_536, 256
_CHECK = np.uint64(0xA0761D6478BD642F)


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's units; the j-th of equal units has its own."""
    data = text.encode()
    for end in (b". ", b"! ", b"? "):
        data = data.replace(end, end[:1] + b"\n")
    count = Counter(xxhash.xxh3_64_intdigest(x) for x in data.split(b"\n") if x)
    keys = np.fromiter(count.keys(), np.uint64, len(count))
    again = [mix(np.uint64(k) + np.arange(1, n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k, n in count.items() if n > 1]
    return np.concatenate([keys, *again]) if again else keys


class Sketches:
    """Sketches of ``rows`` sets side by side, ``cells`` each."""

    def __init__(self, rows: int, cells: int):
        self.cells = cells
        self.count = np.zeros(rows * cells, np.int64)
        self.keys = np.zeros(rows * cells, np.uint64)
        self.checks = np.zeros(rows * cells, np.uint64)

    def _places(self, row: np.ndarray, keys: np.ndarray) -> Iterator[np.ndarray]:
        part = self.cells // PARTS
        for j in range(PARTS):
            yield row * self.cells + j * part + (mix(keys + np.uint64(j + 1)) % np.uint64(part)).astype(np.int64)

    def add(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        signs = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        factor = signs.astype(np.uint64)
        value, check = keys * factor, mix(keys ^ _CHECK) * factor
        for at in self._places(row, keys):
            np.add.at(self.count, at, signs)
            np.add.at(self.keys, at, value)
            np.add.at(self.checks, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, side) recovered from a difference: side 1 stands first only, -1 second only."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            side = self.count[at]
            keys = self.keys[at] * side.astype(np.uint64)
            pure = (np.abs(side) == 1) & (mix(keys ^ _CHECK) * side.astype(np.uint64) == self.checks[at])
            row, keys, side = at[pure] // self.cells, keys[pure], side[pure]
            once = np.unique(mix(keys + row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True)[1]
            row, keys, side = row[once], keys[once], side[once]
            if not len(row):
                break
            found.append((row, keys, side))
            self.add(row, keys, -side)
            at = np.unique(np.concatenate(list(self._places(row, keys))))
            at = at[np.abs(self.count[at]) == 1]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def left(self) -> np.ndarray:
        """Rows that were not emptied."""
        rest = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return np.flatnonzero(rest.reshape(-1, self.cells).any(1))

    def texts(self, sizes: np.ndarray) -> list[str]:
        """A fingerprint of every row: the number of units, then counts, digest sums and check sums."""
        shape = (-1, self.cells)
        parts = [sizes.astype("<i4").reshape(-1, 1), self.count.astype("<i2").reshape(shape), self.keys.astype("<u8").reshape(shape), (self.checks >> np.uint64(32)).astype("<u4").reshape(shape)]
        raw = np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(len(sizes), -1) for p in parts], axis=1)
        return [base64.b64encode(x.tobytes()).decode() for x in raw]


def _laid(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in sets], np.int64)
    return np.repeat(np.arange(len(sets)), size), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def differences(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """How many digests stand only first, and only second, in each pair of sets, by peeling; larger sketches where it fails."""
    only = np.zeros((2, len(pairs)), np.int64)
    open_pairs = np.arange(len(pairs))
    while len(open_pairs):
        sketch = Sketches(len(open_pairs), cells)
        for k, sign in ((0, 1), (1, -1)):
            row, keys = _laid([pairs[i][k] for i in open_pairs])
            sketch.add(row, keys, sign)
        row, _, side = sketch.peel()
        done = np.ones(len(open_pairs), bool)
        done[sketch.left()] = False
        for k, sign in ((0, 1), (1, -1)):
            only[k, open_pairs[done]] = np.bincount(row[side == sign], minlength=len(open_pairs))[done]
        open_pairs, cells = open_pairs[~done], cells * GROWTH
    return only[0], only[1]


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Common units by all units of each pair; 1 where neither has any."""
    first, second = differences(pairs)
    size = np.array([len(a) for a, _ in pairs], np.int64)
    every = size + second
    return np.where(every > 0, (size - first) / np.maximum(1, every), 1.0)


def _fingerprints(rows: list[tuple[object, str, str]], id_type: pa.DataType) -> pa.RecordBatch:
    """Of (doc_id, text, text of the next document)."""
    known: dict[int, np.ndarray] = {}

    def units(text: str) -> np.ndarray:
        if id(text) not in known:
            known[id(text)] = digests(text)
        return known[id(text)]

    edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for _, text, after in rows]
    own, following, changed = [units(r[1]) for r in rows], [units(r[2]) for r in rows], [digests(x) for x in edited]
    prints = []
    for sets in (own, changed):
        sketch = Sketches(len(sets), CELLS)
        sketch.add(*_laid(sets))
        prints.append(sketch.texts(np.array([len(x) for x in sets])))
    near = likeness([*zip(own, changed, strict=True), *zip(own, following, strict=True)])
    schema = pa.schema([("doc_id", id_type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return batch(
        schema,
        doc_id=[r[0] for r in rows],
        n_chars=[len(r[1]) for r in rows],
        edited_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in edited],
        fingerprint=prints[0],
        edited_fingerprint=prints[1],
        near_edited=near[: len(rows)],
        near_next=near[len(rows) :],
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and falling id; those with ``_extra`` only follow others."""
    held: list[tuple[object, str, str]] = []
    before, size, kind = None, 0, None
    for rows in batches:
        kind = rows.schema.field("doc_id").type
        columns = [rows.column(c) for c in ("_bucket", "_extra", "doc_id", "text")]
        for k in range(rows.num_rows):
            bucket, extra, doc_id, text = (c[k].as_py() for c in columns)
            text = text or ""
            if before is not None and before[0] == bucket:
                held.append((before[1], before[2], text))
                size += len(text)
            before = None if extra else (bucket, doc_id, text)
            if size > 1 << 20 or len(held) >= 1000:
                yield _fingerprints(held, kind)
                held, size = [], 0
    if held:
        yield _fingerprints(held, kind)


def _bucket(docs: DataFrame) -> tuple[Column, int]:
    """An ordered bucket number for ``doc_id`` (nulls lowest, by ``_tkey``): quantiles of the ids, evenly cut in between."""
    count, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    buckets = max(1, min(MOST_BUCKETS, -(-count // BUCKET_ROWS)))
    coarse = min(COARSE, buckets)
    fine = -(-buckets // coarse)
    nulls = F.floor((F.col("_tkey").cast("double") / 2.0**64 + 0.5) * buckets).cast("long") - buckets - 1
    if low is None:
        return nulls, buckets
    marks = docs.agg(F.percentile_approx("doc_id", [i / coarse for i in range(1, coarse)] or [0.5], 20_000)).first()[0]
    edges = sorted({low, *marks})
    ends = [*edges[1:], high + 1]
    place = F.size(F.filter(F.lit(edges), lambda x: x <= F.col("doc_id"))) - 1
    start, end = F.get(F.lit(edges), place), F.get(F.lit(ends), place)
    inner = F.floor((F.col("doc_id") - start).cast("double") * fine / (end - start).cast("double")).cast("long")
    return F.when(F.col("doc_id").isNull(), nulls).otherwise(place.cast("long") * fine + F.least(inner, F.lit(fine - 1))), buckets


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id of an integer type, text) and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document by falling doc_id, after the last the first. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty; rows with one id follow
    each other by a hash of the text, null ids come last; a single row is its own next. Two texts without
    units are alike by 1. Other columns are not read.
    """
    source = docs.select("doc_id", "text").withColumn("_tkey", F.xxhash64("text"))
    bucket, _ = _bucket(docs.select("doc_id"))
    placed = source.withColumn("_bucket", bucket)
    order = F.struct(F.col("doc_id").isNotNull().alias("_known"), "doc_id", "_tkey")
    # One row a bucket, MOST_BUCKETS at most: small enough for one task and for every executor.
    firsts = placed.groupBy("_bucket").agg(F.max(order).alias("_first"))
    up = Window.orderBy("_bucket")
    receivers = firsts.withColumn("_to", F.coalesce(F.lead("_bucket").over(up), F.min("_bucket").over(Window.partitionBy())))
    receivers = F.broadcast(receivers.select(F.col("_bucket").alias("_from"), F.col("_first.doc_id").alias("_fid"), F.col("_first._tkey").alias("_fkey"), "_to"))
    meets = (F.col("_bucket") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_fid")) & (F.col("_tkey") == F.col("_fkey"))
    both = placed.join(receivers, meets, "left")
    targets = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("x")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("x")))
    sent = both.select("doc_id", "text", "_tkey", F.inline(F.filter(targets, lambda t: t["b"].isNotNull())).alias("_bucket", "_extra"))
    ordered = sent.repartition(F.col("_bucket")).sortWithinPartitions("_bucket", "_extra", F.desc_nulls_last("doc_id"), F.desc("_tkey"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ordered.select("_bucket", "_extra", "doc_id", "text").mapInArrow(_stream, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
