"""Language-model scores by a Brown class-based bigram model.

log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class), where a text
is its words and one end, and the end is also what stands before the first word.

* *Classes.* The ``clustered`` most frequent words start in ``classes`` classes by rank. Each exchange round
  counts, over the whole corpus, how often every such word stands before and after every class; then each
  word in turn moves to the class that raises the likelihood of the class bigrams most. Words outside that
  list have a class by their shape: last character and whether all are ASCII.
* *Probabilities.* Transitions are counted over the corpus under the final classes. Add-0.1 smoothing on
  transitions; a clustered word's emission is its share of its class; words of a shape class are smoothed
  with add-0.1 and one unknown word.

Counts are made over all training texts, summed in Spark. The driver and the tasks hold tables bounded by
parameters only: ``listed`` words with their counts, word-class counts of ``clustered`` words, and class
bigrams. Counts of all other words stay distributed and reach their texts by a join, so no word is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, batch, fold, list_array, runs, words
from tidemark.staging import stage

CLASSES, CLUSTERED, LISTED, ROUNDS = 48, 8192, 60_000, 2
SHAPES = 8
#: Word numbers above the listed ones: unlisted words by shape, and the end.
UNLISTED, END = 65_520, 65_535
ADD = 0.1


def shapes(w: Words, data: np.ndarray) -> np.ndarray:
    """0 to 7: how the word ends (letter, point, comma, other), and whether it has a byte above 127."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    last = data[w.end - 1]
    mark = np.where(np.isin(last, list(b".!?")), 1, np.where(np.isin(last, list(b",;:")), 2, np.where((last >= 128) | ((last | 32) >= 97) & ((last | 32) <= 122), 0, 3)))
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    return mark + 4 * (wide[w.end] > wide[w.start])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.int64()), ("shape", pa.int32()), ("c", pa.int64())])
    for rows in batches:
        held = []
        for _, _, offsets, data in runs(rows.column("text")):
            w = words(offsets, data)
            found, at, c = np.unique(w.hash, return_index=True, return_counts=True)
            held.append((found, shapes(w, data)[at], c))
        if held:
            every, shape, c = (np.concatenate(x) for x in zip(*held, strict=True))
            found, at, back = np.unique(every, return_index=True, return_inverse=True)
            yield batch(schema, word=found.view(np.int64), shape=shape[at], c=np.bincount(back, weights=c, minlength=len(found)).astype(np.int64))


def _encode(listed: np.ndarray):
    order = np.argsort(listed)
    ranked = listed[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.int64()), ("train", pa.bool_()), ("numbers", pa.binary()), ("others", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
        for rows in batches:
            for lo, hi, offsets, data in runs(rows.column("text")):
                w = words(offsets, data)
                if len(ranked):
                    at = np.minimum(np.searchsorted(ranked, w.hash), len(ranked) - 1)
                    numbers = np.where(ranked[at] == w.hash, order[at], UNLISTED + shapes(w, data)).astype(np.uint16)
                else:
                    numbers = (UNLISTED + shapes(w, data)).astype(np.uint16)
                others, times = [], []
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    rare, c = np.unique(w.hash[a:b][numbers[a:b] >= UNLISTED], return_counts=True)
                    others.append(rare)
                    times.append(c)
                n = np.array([len(x) for x in others])
                yield batch(
                    schema,
                    rid=rows.column("rid").slice(lo, hi - lo),
                    train=rows.column("train").slice(lo, hi - lo),
                    numbers=[numbers[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)],
                    others=list_array(np.concatenate(others).view(np.int64), n, pa.int64()),
                    times=list_array(np.concatenate(times).astype(np.int32), n, pa.int32()),
                )

    return run


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the batch's texts, each with an end after it, and where each text begins."""
    texts = [np.frombuffer(x, np.uint16) for x in column.to_pylist()]
    size = np.array([len(x) + 1 for x in texts], dtype=np.int64)
    out = np.full(int(size.sum()), END, np.uint16)
    starts = np.cumsum(size) - size
    for x, s in zip(texts, starts, strict=True):
        out[s : s + len(x)] = x
    return out, starts


def _before(values: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = end
    return out


def _contexts(class_of: np.ndarray, total: int, clustered: int):
    """Sparse counts of (word, side, class) cells and of class bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])
        size = clustered * 2 * total + total * total
        cells = np.zeros(size, np.int64)
        for rows in batches:
            for lo in range(0, rows.num_rows, 1000):
                numbers, starts = _sequences(rows.column("numbers").slice(lo, 1000))
                own = class_of[numbers]
                prior = _before(own, starts, total - 1)
                word = numbers.astype(np.int64)
                after = word < clustered
                was = _before(numbers, starts, END).astype(np.int64)
                ahead = was < clustered
                for key in ((word * 2 * total + prior)[after], (was * 2 * total + total + own)[ahead], clustered * 2 * total + prior.astype(np.int64) * total + own):
                    if len(key):
                        found, c = np.unique(key, return_counts=True)
                        cells[found] += c
        found = np.flatnonzero(cells)
        for lo in range(0, len(found), 100_000):
            part = found[lo : lo + 100_000]
            yield batch(schema, cell=part, n=cells[part])

    return run


def exchange(class_of: np.ndarray, cells: np.ndarray, clustered: int, classes: int, total: int) -> int:
    """Move each word, most frequent first, to the class that gains most likelihood; returns the number of moves."""
    around = cells[: clustered * 2 * total].reshape(clustered, 2, total).astype(float)
    grid = cells[clustered * 2 * total :].reshape(total, total).astype(float)
    rows, columns = grid.sum(1), grid.sum(0)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    moves = 0
    for word in range(clustered):
        left, right = around[word]
        n_in, n_out = left.sum(), right.sum()
        if not n_in:
            continue
        own = int(class_of[word])
        grid[:, own] -= left
        grid[own, :] -= right
        np.maximum(grid, 0, out=grid)
        columns[own] -= n_in
        rows[own] -= n_out
        into, out = grid[:, :classes], grid[:classes, :]
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        gain = (f(into[a] + left[a, None]) - f(into[a])).sum(0) + (f(out[:, b] + right[None, b]) - f(out[:, b])).sum(1)
        gain -= f(columns[:classes] + n_in) - f(columns[:classes]) + f(rows[:classes] + n_out) - f(rows[:classes])
        best = int(gain.argmax())
        if gain[best] <= gain[own] + 1e-9:
            best = own
        moves += best != own
        class_of[word] = best
        grid[:, best] += left
        grid[best, :] += right
        columns[best] += n_in
        rows[best] += n_out
    return moves


@dataclass(frozen=True)
class Tables:
    """By word number: class, log10 emission and log10 base share, both without the count where the word is unlisted; log10 transitions by class."""

    class_of: np.ndarray
    emission: np.ndarray
    base: np.ndarray
    transition: np.ndarray


def _scores(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.int64()), ("n_tokens", pa.int64()), ("_listed", pa.int64()), ("_base", pa.float64()), ("_score", pa.float64())])
        end = int(tables.class_of[END])
        for rows in batches:
            for lo in range(0, rows.num_rows, 1000):
                numbers, starts = _sequences(rows.column("numbers").slice(lo, 1000))
                own = tables.class_of[numbers]
                score = tables.emission[numbers] + tables.transition[_before(own, starts, end), own]
                yield batch(
                    schema,
                    rid=rows.column("rid").slice(lo, 1000),
                    n_tokens=np.diff(np.append(starts, len(numbers))),
                    _listed=np.add.reduceat(((numbers < UNLISTED) | (numbers == END)).astype(np.int64), starts),
                    _base=np.add.reduceat(tables.base[numbers], starts),
                    _score=np.add.reduceat(score, starts),
                )

    return run


def class_scores(docs: DataFrame, train: Column, classes: int = CLASSES, clustered: int = CLUSTERED, listed: int = LISTED, rounds: int = ROUNDS) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), learning from the rows where ``train`` holds.

    Columns: doc_id, train, n_tokens, n_known, train_tokens, base_score, score. Null and empty texts are one
    end token. Repeated rows are counted and scored each for itself. Without training rows all counts
    are 0 and every word is unknown. Other columns are not read.
    """
    classes, clustered = min(classes, clustered), min(clustered, listed)
    source = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    counted = source.where("train").select("text").mapInArrow(_counts, "word bigint, shape int, c bigint").groupBy("word").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))
    vocabulary = stage(counted, "vocabulary")
    texts = source.where("train").count()
    by_shape = {r["shape"]: r for r in vocabulary.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n = sum(r["n"] for r in by_shape.values()) + texts
    v = sum(r["v"] for r in by_shape.values()) + (texts > 0)
    top = vocabulary.orderBy(F.desc("c"), "word").limit(listed).collect()
    number = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    count = np.array([r["c"] for r in top], dtype=np.int64)
    shape = np.array([r["shape"] for r in top], dtype=np.int64)
    clustered = min(clustered, len(top))

    ids = source.withColumn("rid", F.monotonically_increasing_id())
    encoded = ids.mapInArrow(_encode_with_id(number, docs), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rid bigint, train boolean, numbers binary, others array<bigint>, times array<int>")
    encoded = stage(encoded, "encoded")

    total = classes + SHAPES + 1
    class_of = np.zeros(65_536, np.int64)
    class_of[:clustered] = np.arange(clustered) % classes
    class_of[clustered : len(top)] = classes + shape[clustered:]
    class_of[UNLISTED : UNLISTED + SHAPES] = classes + np.arange(SHAPES)
    class_of[END] = total - 1
    size = clustered * 2 * total + total * total

    def corpus_cells() -> np.ndarray:
        found = encoded.where("train").select("numbers").mapInArrow(_contexts(class_of.copy(), total, clustered), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        cells = np.zeros(size, np.int64)
        cells[found["cell"].to_numpy()] = found["n"].to_numpy()
        return cells

    for _ in range(rounds):
        if not exchange(class_of, corpus_cells(), clustered, classes, total):
            break
    grid = corpus_cells()[clustered * 2 * total :].reshape(total, total).astype(float)

    with np.errstate(divide="ignore"):
        transition = np.log10((grid + ADD) / (grid.sum(1, keepdims=True) + ADD * total))
        in_class = np.bincount(class_of[:clustered], weights=count[:clustered], minlength=total)
        emission, base = np.zeros(65_536), np.zeros(65_536)
        emission[:clustered] = np.log10(count[:clustered] / in_class[class_of[:clustered]])
        known = np.bincount(shape[:clustered], minlength=SHAPES)
        weight = np.bincount(shape[:clustered], weights=count[:clustered], minlength=SHAPES)
        for s in range(SHAPES):
            r = by_shape.get(s)
            mass = (r["n"] - weight[s] + ADD * (r["v"] - known[s] + 1)) if r else ADD
            emission[UNLISTED + s] = -np.log10(mass)
        rest = slice(clustered, len(top))
        emission[rest] = np.log10(count[rest] + ADD) + emission[UNLISTED + shape[rest]]
        norm = np.log10(n + ADD * (v + 1))
        base[: len(top)] = np.log10(count + ADD) - norm
        base[UNLISTED : UNLISTED + SHAPES] = -norm
        base[END] = np.log10(texts + ADD) - norm
    scored = encoded.select("rid", "numbers").mapInArrow(_scores(Tables(class_of, emission, base, transition)), "rid bigint, n_tokens bigint, _listed bigint, _base double, _score double")

    # Words outside the list: their counts come by a join, and with them the rest of both sums.
    rare = encoded.select("rid", F.explode(F.arrays_zip("others", "times")).alias("_w")).select("rid", F.col("_w.others").alias("word"), F.col("_w.times").alias("_t"))
    joined = rare.join(vocabulary.select("word", "c"), "word", "left").groupBy("rid")
    rest = joined.agg(F.sum(F.when(F.col("c").isNotNull(), F.col("_t")).otherwise(0)).cast("long").alias("_rare_known"), F.sum(F.col("_t") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("_rare"))
    seen = F.lit(0 if texts else 1).cast("long")
    out = encoded.select("rid", "doc_id", "train").join(scored, "rid").join(rest, "rid", "left").na.fill(0, ["_rare_known", "_rare"])
    return out.select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("_listed") + F.col("_rare_known") - seen).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_base") + F.col("_rare")).alias("base_score"),
        (F.col("_score") + F.col("_rare")).alias("score"),
    )


def _encode_with_id(listed: np.ndarray, docs: DataFrame):
    encode = _encode(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            done = 0
            for out in encode([rows]):
                ids = rows.column("doc_id").slice(done, out.num_rows)
                done += out.num_rows
                yield pa.RecordBatch.from_arrays([ids, *out.columns], names=["doc_id", *out.schema.names])

    return run


def perplexity_scores(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) modulo 10 is not 0, score all; ``held_out`` marks that remainder."""
    held_out = fold(F.col("doc_id"), 10) == 0
    return class_scores(docs, ~held_out).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
