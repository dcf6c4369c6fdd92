"""As-of joins without an inequality join and without an unbounded window.

Spark has no as-of join. A single window over ``union(left, right)`` per key puts
a hot key into one task, so the lookup is split in two levels:

1. inside a time bucket of the key, the last right row is carried forward;
2. one summary row per (key, bucket), built with partial aggregation, is carried
   across buckets and fills the left rows no earlier row of their bucket reached.

Partitions are (key, bucket); only the small summary is ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    payload: Sequence[str],
    bucket: str = "month",
    tie_break: Sequence[str] = (),
    out: str = "asof",
) -> DataFrame:
    """Attach the latest right row with ``right_ts <= left_ts`` as a struct column.

    ``bucket`` is a ``date_trunc`` unit. Right rows sharing a timestamp resolve to
    the largest ``tie_break`` values, so the result is deterministic.
    """
    ordered = [F.col(right_ts).cast("timestamp_ntz").alias("ts"), *[F.col(name) for name in tie_break if name not in payload], *[F.col(name) for name in payload]]
    matched = F.struct(*ordered)
    left_side = left.withColumn("_ts", F.col(left_ts).cast("timestamp_ntz")).withColumn("_left", F.struct(*left.columns))
    left_rows = left_side.select(*by, "_ts", F.lit(1).alias("_side"), "_left", F.lit(None).cast(_struct_type(right, matched)).alias("_right"))
    right_rows = right.select(*by, F.col(right_ts).cast("timestamp_ntz").alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(left_side.schema["_left"].dataType).alias("_left"), matched.alias("_right"))
    rows = left_rows.unionByName(right_rows).withColumn("_bucket", F.date_trunc(bucket, F.col("_ts")))

    inside = Window.partitionBy(*by, "_bucket").orderBy("_ts", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("_in", F.last("_right", ignorenulls=True).over(inside)).where("_side = 1").select(*by, "_bucket", "_left", "_in")

    across = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy(*by, "_bucket").agg(F.max("_right").alias("_last")).withColumn("_before", F.last("_last", ignorenulls=True).over(across)).drop("_last")

    # Join keys may be null on the left; null-safe equality keeps those rows.
    joined = carried.alias("c").join(
        summary.alias("s"),
        _all_equal([(F.col(f"c.{name}"), F.col(f"s.{name}")) for name in [*by, "_bucket"]]),
        "left",
    )
    result = joined.select(F.col("c._left").alias("_left"), F.coalesce(F.col("c._in"), F.col("s._before")).alias(out))
    return result.select("_left.*", out)


def asof_max(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    rank: Sequence[str],
    payload: Sequence[str],
    bucket: str = "month",
    out: str = "best",
) -> DataFrame:
    """Attach, of all right rows with ``right_ts <= left_ts``, the one of the largest ``rank`` values as a struct.

    Like :func:`asof_join`, but the greatest row so far is carried, not the last one: inside a (key, bucket)
    it runs over the bucket's rows, and across buckets over one summary row each. Equal ranks take the larger payload.
    """
    right = right.where(F.col(right_ts).isNotNull())
    matched = F.struct(*[F.col(name) for name in rank], *[F.col(name) for name in payload if name not in rank])
    left_side = left.withColumn("_ts", F.col(left_ts).cast("timestamp_ntz")).withColumn("_left", F.struct(*left.columns))
    left_rows = left_side.select(*by, "_ts", F.lit(1).alias("_side"), "_left", F.lit(None).cast(_struct_type(right, matched)).alias("_right"))
    right_rows = right.select(*by, F.col(right_ts).cast("timestamp_ntz").alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(left_side.schema["_left"].dataType).alias("_left"), matched.alias("_right"))
    rows = left_rows.unionByName(right_rows).withColumn("_bucket", F.date_trunc(bucket, F.col("_ts")))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("_in", F.max("_right").over(inside)).where("_side = 1").select(*by, "_bucket", "_left", "_in")
    across = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy(*by, "_bucket").agg(F.max("_right").alias("_best")).withColumn("_before", F.max("_best").over(across)).drop("_best")
    joined = carried.alias("c").join(summary.alias("s"), _all_equal([(F.col(f"c.{name}"), F.col(f"s.{name}")) for name in [*by, "_bucket"]]), "left")
    return joined.select(F.col("c._left").alias("_left"), F.greatest("c._in", "s._before").alias(out)).select("_left.*", out)


def _struct_type(df: DataFrame, struct):
    return df.select(struct.alias("s")).schema["s"].dataType


def _all_equal(pairs):
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & a.eqNullSafe(b)
    return condition


def running_sum(df: DataFrame, by: Sequence[str], bucket: Sequence[str], order: Sequence[str], value: str | Sequence[str], out: str | Sequence[str], dealt_rows: DataFrame | None = None) -> DataFrame:
    """Running totals per ``by`` in ``(bucket, order)`` order without one task per key.

    Totals per (by, bucket) are accumulated across buckets, then each bucket runs on
    its own; a hot key is spread over its buckets. ``value`` and ``out`` name one column
    or several, which share the same passes. ``dealt_rows`` are the rows of ``df`` dealt by
    (by, bucket), with columns of ``order`` that were made there and need not be moved.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (list(value), list(out))
    numbered = list(enumerate(values))
    totals = df.groupBy(*by, *bucket).agg(*[F.sum(v).alias(f"_t{k}") for k, v in numbered])
    before = Window.partitionBy(*by).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(*by, *bucket, *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_opening{k}") for k, _ in numbered])
    inside = Window.partitionBy(*by, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = (df if dealt_rows is None else dealt_rows).withColumns({f"_inside{k}": F.sum(v).over(inside) for k, v in numbered}).join(opening, [*by, *bucket])
    summed = summed.withColumns({name: F.col(f"_opening{k}") + F.col(f"_inside{k}") for k, name in enumerate(outs)})
    return summed.drop(*[f"_{side}{k}" for side in ("opening", "inside") for k, _ in numbered])
