"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; one binary classifier a bit, a logistic model over hashed
byte n-grams, predicts it. A text gets the language whose codeword its bits cost least (logistic loss,
so a confident wrong bit weighs more than a doubtful one), and is flagged where a second is nearly as near.

The classifiers are fitted on a bounded sample of labelled texts: of each language the ``per_language`` distinct
texts of least hash, fewer where that would be more than ``most_sampled`` in all, one at least. So neither a
text repeated without end nor a large language takes another's places. Languages are counted over all texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import _LOWER, batch, fold, mix, runs

PER_LANGUAGE, MOST_SAMPLED, BUCKETS, ORDERS = 400, 8000, 4096, (1, 2, 3)
UNKNOWN, NEARLY = "und", 1.0


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """(classes, bits) of +1 and -1: all different splits for up to 6 classes, else the best of seeded random codes."""
    if classes < 2:
        return np.ones((classes, 0))
    if classes <= 6:
        rows = [[1] + list(x) for x in itertools.product((1, -1), repeat=classes - 1)]
        return np.array([r for r in rows if -1 in r], dtype=float).T
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = math.ceil(10 * math.log2(classes))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(classes, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(classes) * bits
        if apart.min() > far and (np.abs(code.sum(0)) < classes).all():
            best, far = code, apart.min()
    return best


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(texts, buckets): square roots of the shares of hashed byte n-grams, A-Z lower-cased."""
    rows = len(offsets) - 1
    data = _LOWER[data].astype(np.uint64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    counts = np.zeros(rows * BUCKETS)
    for n in ORDERS:
        if len(data) < n:
            continue
        gram = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            gram = gram * np.uint64(256) + data[k : len(data) - n + 1 + k]
        inside = row[: len(gram)] == row[n - 1 :]
        counts += np.bincount((row[: len(gram)] * BUCKETS + (mix(gram) & np.uint64(BUCKETS - 1)).astype(np.int64))[inside], minlength=rows * BUCKETS)
    counts = counts.reshape(rows, BUCKETS)
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True))).astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, its share of 1 by loss, and whether another costs less than ``NEARLY`` more."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins) @ (self.code.T > 0) + np.logaddexp(0, margins) @ (self.code.T < 0)
        order = np.sort(loss, axis=1)
        share = np.exp(order[:, 0:1] - loss).sum(1)
        return loss.argmin(1), 1 / share, order[:, 1] - order[:, 0] < NEARLY if loss.shape[1] > 1 else np.zeros(len(x), bool)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features as their places and values; most n-grams do not occur in a text."""
    schema = pa.schema([("lang", pa.string()), ("_h", pa.int64()), ("at", pa.binary()), ("x", pa.binary())])
    for rows in batches:
        for lo, hi, offsets, data in runs(rows.column("text"), 1 << 19, 512):
            found = features(offsets, data)
            places = [np.flatnonzero(x).astype(np.int32) for x in found]
            yield batch(schema, lang=rows.column("lang").slice(lo, hi - lo).cast(pa.string()), _h=rows.column("_h").slice(lo, hi - lo), at=[p.tobytes() for p in places], x=[x[p].tobytes() for x, p in zip(found, places, strict=True)])


def sample(rows: DataFrame, per_language: int = PER_LANGUAGE, most_sampled: int = MOST_SAMPLED) -> tuple[list[str], DataFrame]:
    """All languages of ``rows`` (text, lang) and the drawn texts (lang, _h, text): distinct ones, by rank of their hash within the language."""
    known = rows.select(F.col("lang").cast("string").alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_h", F.xxhash64("text", F.lit(11)))
    distinct = known.select("lang", "_h").distinct()
    sizes = distinct.groupBy("lang").agg(F.count("*").alias("_n"))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    each = max(1, min(per_language, most_sampled // max(1, len(languages))))
    # Ranks are taken of a few times as many as are wanted, so no language is ordered as a whole.
    span = 1 << 30
    few = distinct.join(sizes, "lang").where(F.pmod("_h", F.lit(span)) / F.lit(float(span)) * F.col("_n") < 4.0 * each + 16)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(span)), "_h"))
    drawn = few.withColumn("_rank", rank).where(F.col("_rank") <= each).select("lang", "_h")
    return languages, known.join(drawn, ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text"))


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, steps: int = 300, most_sampled: int = MOST_SAMPLED) -> LanguageModel:
    """Learn from ``rows`` (text, lang); null texts and languages are left out."""
    languages, drawn = sample(rows, per_language, most_sampled)
    code = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((BUCKETS, 0)), np.zeros(0))
    spread = drawn.repartition(drawn.sparkSession.sparkContext.defaultParallelism)
    table = spread.mapInArrow(_sampled, "lang string, _h bigint, at binary, x binary").toArrow().sort_by([("_h", "ascending"), ("lang", "ascending")])
    x = np.zeros((table.num_rows, BUCKETS), np.float32)
    for k, (at, values) in enumerate(zip(table["at"].to_pylist(), table["x"].to_pylist(), strict=True)):
        x[k, np.frombuffer(at, np.int32)] = np.frombuffer(values, np.float32)
    number = {k: i for i, k in enumerate(languages)}
    which = np.array([number[k] for k in table["lang"].to_pylist()], dtype=np.int64)
    y = code[which]
    each = np.bincount(which, minlength=len(languages))
    balance = (1 / np.maximum(1, each))[which, None] / max(1, (each > 0).sum())
    w, b = np.zeros((BUCKETS, code.shape[1])), np.zeros(code.shape[1])
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -y / (1 + np.exp(np.clip(y * (x @ w.astype(np.float32) + b), -50, 50))) * balance
        for p, d, first, second in ((w, x.T @ g.astype(np.float32) + 1e-6 * w, m, v), (b, g.sum(0), mb, vb)):
            first += 0.1 * (d - first)
            second += 0.01 * (d * d - second)
            p -= 0.2 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return LanguageModel(languages, code, w, b)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row of ``docs`` (doc_id, text), in one pass without a shuffle.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned; repeated rows get
    equal answers; whole texts are read, of any length; other columns are not.
    """
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    names = np.array(model.languages or [UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = pa.schema([rows.schema.field("doc_id"), *schema])
            for lo, hi, offsets, data in runs(rows.column("text"), 1 << 19, 512):
                letter = rows.column("_letter").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                if model.languages:
                    best, score, near = model.decode(features(offsets, data))
                else:
                    best, score, near, letter = np.zeros(hi - lo, int), np.zeros(hi - lo), np.zeros(hi - lo, bool), np.zeros(hi - lo, bool)
                yield batch(out, doc_id=rows.column("doc_id").slice(lo, hi - lo), lang_pred=np.where(letter, names[best], UNKNOWN).tolist(), score=np.where(letter, score, 0.0), ambiguous=near & letter)

    kind = docs.schema["doc_id"].dataType.simpleString()
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", letter.alias("_letter")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on the rows whose crc32(doc_id) modulo 3 is not 1, predict all; adds ``held_out`` (that remainder is 1)."""
    model = fit(docs.where(fold(F.col("doc_id"), 3) != 1), per_language)
    return predict(docs, model).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
