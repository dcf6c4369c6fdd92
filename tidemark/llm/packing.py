"""Best-fit packing into bins of several permitted lengths.

Items go in falling length. Each goes to the open bin that it leaves with least room; where none has
room, a bin of the permitted length with the least cost a token opens that holds it (the longest of
equals, whose room later items can use). At the end each bin is cut down to the shortest permitted
length that holds its contents, so lengths are settled by contents, all permitted lengths at once.

Greedy packing is sequential, so the items are dealt into shards of about ``shard_tokens`` by a hash:
the number of shards follows the data, a shard stays in one task's memory (lengths and ids only), and
costs one part-filled bin of each length at most. Equal rows are told apart by a row number, so a row repeated
without end is dealt out like any others. With a ``window`` rows of different windows never share a bin and a bin
carries its window, so that an order of the rows reaches the sequences; every window is dealt into as many
shards as its own total asks for.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import word_list
from tidemark.staging import stage

CAPACITIES, SHARD_TOKENS = (512, 1024, 2048, 4096), 1_000_000
#: Cost of a sequence in tokens' worth: a fixed part, one a token, and attention that grows with the square of the length.
FIXED_COST, ATTENTION_LENGTH = 384.0, 8192.0


def sequence_costs(capacities: tuple[int, ...] = CAPACITIES, fixed: float = FIXED_COST, attention_length: float = ATTENTION_LENGTH) -> tuple[float, ...]:
    """Costs of the permitted lengths: short ones waste the fixed part, long ones the attention."""
    return tuple(fixed + c + c * c / attention_length for c in capacities)


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], costs: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each of the falling ``lengths``, its offset there, and each bin's final capacity and contents."""
    rates = sorted((cost / size, -size) for size, cost in zip(capacities, costs, strict=True))
    room: list[int] = []
    open_bins: dict[int, list[int]] = {}
    opened, bin_of, offset = [], np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        at = bisect_left(room, n)
        if at < len(room):
            left = room[at]
            number = open_bins[left].pop()
            if not open_bins[left]:
                del open_bins[left]
                room.pop(at)
        else:
            left = next(-size for _, size in rates if -size >= n)
            number = len(opened)
            opened.append(left)
        bin_of[k], offset[k] = number, opened[number] - left
        if left > n:
            if left - n not in open_bins:
                open_bins[left - n] = []
                insort(room, left - n)
            open_bins[left - n].append(number)
    used = np.bincount(bin_of, weights=lengths, minlength=len(opened)).astype(np.int64)
    sizes = np.array(sorted(capacities))
    return bin_of, offset, sizes[np.searchsorted(sizes, used)], used


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, costs: tuple[float, ...] | None = None, shard_tokens: int = SHARD_TOKENS, window: Column | None = None) -> DataFrame:
    """One row per packed piece of every row of ``docs`` (doc_id, text).

    ``length`` defaults to the words of the text and one end token, so empty and null texts take one token; rows whose
    length is null or not positive are not packed. Texts longer than the largest capacity are cut into pieces of it, whose
    rest is packed like any text. ``costs`` are those of the capacities, in proportion to them by default.
    Columns: bin_id (text of the next three), window, shard, bin, capacity, used, bin_offset, doc_id, piece, piece_start,
    n_tokens. Rows of one doc_id are packed each for itself; doc_id keeps its type and its nulls; an empty table
    gives no rows. ``window`` is any whole number from 0 on; rows where it is null share a window that is null.
    Other columns are not read.
    """
    largest = max(capacities)
    costs = costs or tuple(float(c) for c in capacities)
    length = (F.size(word_list(F.col("text"))) + 1) if length is None else length
    windowed = F.lit(0).cast("long") if window is None else F.coalesce(window.cast("long"), F.lit(-1))
    items = docs.select("doc_id", length.cast("long").alias("_n"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_key"), windowed.alias("_window"), F.monotonically_increasing_id().alias("_row"))
    items = stage(items.where("_n > 0"), "items")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one_shard(rows: pa.Table) -> pa.Table:
        n = rows.column("_n").to_numpy()
        pieces = -(-n // largest)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(largest, n[row] - piece * largest)
        order = np.lexsort((piece, rows.column("_key").to_numpy()[row], -size))
        row, piece, size = row[order], piece[order], size[order]
        bin_of, offset, capacity, used = best_fit(size, capacities, costs)
        numbers = {"bin": bin_of, "capacity": capacity[bin_of], "used": used[bin_of], "bin_offset": offset}
        # Ids stay in Arrow: a null beside them must not make them doubles.
        taken = rows.select(["_window", "_shard", "doc_id"]).take(pa.array(row))
        for name, values in {**numbers, "piece": piece, "piece_start": piece * largest, "n_tokens": size}.items():
            taken = taken.append_column(name, pa.array(values, pa.int64()))
        return taken

    totals = items.groupBy("_window").agg(F.sum("_n").alias("_total"))
    shard = F.pmod(F.xxhash64("_key", "_row", F.lit(2)), F.ceil(F.col("_total") / shard_tokens))
    dealt = items.join(totals, "_window").select("doc_id", "_n", "_key", "_window", shard.alias("_shard"))
    packed = dealt.groupBy("_window", "_shard").applyInArrow(one_shard, f"_window bigint, _shard bigint, doc_id {kind}, bin bigint, capacity bigint, used bigint, bin_offset bigint, piece bigint, piece_start bigint, n_tokens bigint")
    number = F.when(F.col("_window") >= 0, F.col("_window"))
    name = F.concat_ws("-", F.coalesce(number.cast("string"), F.lit("rest")), F.col("_shard").cast("string"), F.col("bin").cast("string"))
    return packed.select(name.alias("bin_id"), number.alias("window"), F.col("_shard").alias("shard"), "bin", "capacity", "used", "bin_offset", "doc_id", "piece", "piece_start", "n_tokens")
