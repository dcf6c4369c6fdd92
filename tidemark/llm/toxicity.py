"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words, without case and edge punctuation, and the beginnings of its longer
words, all hashed into ``SLOTS`` slots and weighted by the root of their count, 2 at most. The score adds a weight
for each term and, for each pair of terms, the product of two short learned vectors, so that a pair can
count for more or less than its terms do.

The model is fitted on a bounded sample of labelled texts: of each class the ``most_toxic`` or ``most_other`` ids of
least hash, one text each. Scoring is one pass over all texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batch, fold, mix, runs, words

MOST_TOXIC, MOST_OTHER, SLOTS, FACTORS, THRESHOLD = 3000, 5000, 1 << 18, 4, 0.7
HEADS = (6, 8, 10)
#: First sum of squares of Adagrad where all terms learn: what few rows say moves a term little.
DAMPING = 10_000.0

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def terms(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots of every row of a run, and their weights."""
    w = words(offsets, data, drop=_PUNCTUATION, heads=HEADS)
    length = w.end - w.start
    every = [w.hash] + [np.where(length > k, h, w.hash) for k, h in zip(HEADS, w.heads, strict=True)]
    used = [np.ones(len(length), bool)] + [length > k for k in HEADS]
    slots = [(mix(h + np.uint64(5)) & np.uint64(SLOTS - 1)).astype(np.int64) for h in every]
    for row in range(len(offsets) - 1):
        a, b = w.first[row], w.first[row + 1]
        mine = np.concatenate([s[a:b][u[a:b]] for s, u in zip(slots, used, strict=True)])
        found, count = np.unique(mine, return_counts=True)
        yield found, np.minimum(2.0, np.sqrt(count))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, slots: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of rows laid end to end; every row begins at its ``starts`` and has a term at least."""
        v = self.factors[slots] * weights[:, None]
        total = np.add.reduceat(v, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[slots] * weights, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))


def _sparse(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(s) for s, _ in rows])
    return np.concatenate([s for s, _ in rows]), np.concatenate([x for _, x in rows]), size


def _fair(y: np.ndarray) -> np.ndarray:
    """Weights with which both classes weigh alike."""
    share = y.mean()
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share))


def _known(rows: list[tuple[np.ndarray, np.ndarray]], known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    kept = [(s[known[s]], x[known[s]]) for s, x in rows]
    return [(s, x) if len(s) else (np.zeros(1, np.int64), np.zeros(1)) for s, x in kept]


def _loss(model: Machine, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> float:
    slots, x, size = _sparse(rows)
    raw = np.clip(model.raw(slots, x, np.cumsum(size) - size), -30, 30)
    return float(np.average(np.log1p(np.exp(np.where(y == 1, -raw, raw))), weights=_fair(y)))


def _descend(model: Machine, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rng: np.random.Generator, rate: float, slower: float, decay: float, damping: float) -> Iterator[None]:
    """Adagrad on the logistic loss, in seeded mini-batches, one epoch a step; ``damping`` holds back terms of few rows."""
    fair = _fair(y)
    g_bias, g_linear, g_factors = 1e-6, np.full(SLOTS, damping), np.full((SLOTS, FACTORS), damping)
    while True:
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 128):
            part = order[lo : lo + 128]
            slots, x, size = _sparse([rows[i] for i in part])
            starts = np.cumsum(size) - size
            error = 1 / (1 + np.exp(-np.clip(model.raw(slots, x, starts), -30, 30))) - y[part]
            error *= fair[part]
            each = np.repeat(error, size)
            v = model.factors[slots] * x[:, None]
            total = np.repeat(np.add.reduceat(v, starts, axis=0), size, axis=0)
            touched, place = np.unique(slots, return_inverse=True)
            d_linear = np.bincount(place, weights=each * x, minlength=len(touched)) + decay * model.linear[touched]
            pull = (each * x)[:, None] * (total - v)
            d_factors = np.stack([np.bincount(place, weights=pull[:, k], minlength=len(touched)) for k in range(FACTORS)], 1) + decay * model.factors[touched]
            g_linear[touched] += d_linear**2
            g_factors[touched] += d_factors**2
            model.linear[touched] -= rate * d_linear / np.sqrt(g_linear[touched])
            model.factors[touched] -= slower * rate * d_factors / np.sqrt(g_factors[touched])
            g_bias += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(g_bias)
        yield


def _base(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, rate: float, decay: float, seed: int, least: int, telling: float) -> tuple[Machine, np.ndarray]:
    """A model of the terms of ``least`` rows or more whose share differs between the classes by ``telling`` standard errors, and which those are."""
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(SLOTS), np.zeros((SLOTS, FACTORS)))
    all_of = np.bincount(np.concatenate([s for s, _ in rows]), minlength=SLOTS)
    toxic_of = np.bincount(np.concatenate([s for (s, _), t in zip(rows, y, strict=True) if t]), minlength=SLOTS)
    n, n1 = len(rows), y.sum()
    share_of = all_of / n
    apart = toxic_of / n1 - (all_of - toxic_of) / (n - n1)
    known = (all_of >= least) & (all_of < n) & (np.abs(apart) >= telling * np.sqrt(share_of * (1 - share_of) * (1 / n1 + 1 / (n - n1))))
    model.factors[known] = rng.normal(0, 0.1, (int(known.sum()), FACTORS))
    epoch = _descend(model, _known(rows, known), y, rng, rate, 0.2, decay, 1e-6)
    for _ in range(epochs):
        next(epoch)
    return model, known


def _rest(model: Machine, known: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rate: float, decay: float, seed: int) -> Iterator[None]:
    """Go on with factors for every other term of the sample too, an epoch a step."""
    rng = np.random.default_rng(seed + 1)
    fresh = (np.bincount(np.concatenate([s for s, _ in rows]), minlength=SLOTS) > 0) & ~known
    model.factors[fresh] = rng.normal(0, 0.02, (int(fresh.sum()), FACTORS))
    return _descend(model, rows, y, rng, rate, 1.0, decay, DAMPING)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 20, rate: float = 0.15, decay: float = 1e-3, seed: int = 3, least: int = 8, telling: float = 4.5, steps: int = 3000, patience: int = 1000) -> Machine:
    """Fit in two parts: terms that tell the classes apart alone, then all terms of the sample, for pairs and rare terms.

    How long the second part goes on, if at all, is read off a sixth of the rows that the trial run does not learn from:
    it stops after ``patience`` mini-batches without gain, or at ``steps``. The model is then fitted on all rows as long.
    """
    if not rows or y.min() == y.max():
        return Machine(0.0 if not rows else (3.0 if y[0] else -3.0), np.zeros(SLOTS), np.zeros((SLOTS, FACTORS)))
    best_epoch = 0
    aside = np.zeros(len(rows), bool)
    for k in (0, 1):
        mine = np.random.default_rng(seed).permutation(np.flatnonzero(y == k))
        aside[mine[: len(mine) // 6]] = True
    if y[aside].sum() and (1 - y[aside]).sum():
        some, held = [r for r, a in zip(rows, aside, strict=True) if not a], [r for r, a in zip(rows, aside, strict=True) if a]
        model, known = _base(some, y[~aside], epochs, rate, decay, seed, least, telling)
        best = _loss(model, held, y[aside]) - 1e-3
        each = -(-len(some) // 128)
        epoch = _rest(model, known, some, y[~aside], rate, decay, seed)
        for k in range(1, -(-steps // each) + 1):
            next(epoch)
            loss = _loss(model, held, y[aside])
            if loss < best:
                best, best_epoch = loss, k
            elif (k - best_epoch) * each >= patience:
                break
    model, known = _base(rows, y, epochs, rate, decay, seed, least, telling)
    if best_epoch:
        epoch = _rest(model, known, rows, y, rate, decay, seed)
        for _ in range(best_epoch):
            next(epoch)
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("toxic", pa.int32()), ("_h", pa.int64()), ("s", pa.binary()), ("x", pa.binary())])
    for rows in batches:
        for lo, hi, offsets, data in runs(rows.column("text")):
            found = list(terms(offsets, data))
            yield batch(schema, toxic=rows.column("toxic").slice(lo, hi - lo), _h=rows.column("_h").slice(lo, hi - lo), s=[s.astype(np.int32).tobytes() for s, _ in found], x=[x.astype(np.float32).tobytes() for _, x in found])


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER) -> DataFrame:
    """(text, toxic, _h) to learn from: by rank of the id's hash within each class.

    An id with both labels has the one of most of its rows, and is left out if they are equal in number; labels other than
    0 and 1, null ids and ids without a text are left out. Of several texts of an id the least is taken.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    voted = marked.groupBy("doc_id").agg((F.sum("toxic") * 2 - F.count("*")).alias("_vote")).where("_vote <> 0")
    settled = voted.select("doc_id", F.when(F.col("_vote") > 0, 1).otherwise(0).alias("toxic"), F.xxhash64("doc_id", F.lit(23)).alias("_h"))
    named = settled.join(docs.where(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    # Ranks are taken of a few times as many as are wanted, so no class is ordered as a whole.
    span, most = 1 << 30, F.when(F.col("toxic") == 1, most_toxic).otherwise(most_other)
    reach = lambda k, n: min(span, span * (4 * n + 16) // max(1, sizes.get(k, 0)))
    few = named.where(F.pmod("_h", F.lit(span)) < F.when(F.col("toxic") == 1, reach(1, most_toxic)).otherwise(reach(0, most_other)))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.pmod("_h", F.lit(span)), "doc_id"))
    drawn = few.withColumn("_rank", rank).where(F.col("_rank") <= most).select("doc_id", "toxic", "_h")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # bounded by the two parameters
    return texts.groupBy("doc_id", "toxic", "_h").agg(F.min("text").alias("text")).select("text", "toxic", "_h")


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER) -> Machine:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1) by their :func:`sample`."""
    spread = sample(docs, labels, most_toxic, most_other).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    table = spread.mapInArrow(_sampled, "toxic int, _h bigint, s binary, x binary").toArrow().sort_by([("_h", "ascending"), ("s", "ascending")])
    rows = [(np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64)) for s, x in zip(table["s"].to_pylist(), table["x"].to_pylist(), strict=True)]
    return train(rows, (np.array(table["toxic"].to_pylist(), dtype=np.int64) == 1).astype(float))


def score(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs`` (doc_id, text).

    Null and empty texts, and those without a word, have the score of the bias alone. Whole texts of any length
    are read; repeated rows get equal scores; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*sent.value)
        for rows in batches:
            schema = pa.schema([rows.schema.field("doc_id"), ("score", pa.float64()), ("predicted", pa.int32())])
            for lo, hi, offsets, data in runs(rows.column("text"), 1 << 19):
                found = list(terms(offsets, data))
                size = np.array([len(s) for s, _ in found])
                raw = np.full(hi - lo, machine.bias)
                if size.sum():
                    starts = (np.cumsum(size) - size)[size > 0]
                    raw[size > 0] = machine.raw(np.concatenate([s for s, _ in found]), np.concatenate([x for _, x in found]), starts)
                value = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                yield batch(schema, doc_id=rows.column("doc_id").slice(lo, hi - lo), score=value, predicted=(value >= threshold).astype(np.int32))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels of rows whose crc32(doc_id) modulo 3 is not 1, score all; adds ``held_out`` (that remainder is 1)."""
    model = fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return score(docs, model).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
