"""Day intervals cut into time buckets, so that a stab or an overlap becomes an equality join with a local test."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIGIN = dt.date(1990, 1, 1)


def day_bucket(day: Column, width: int) -> Column:
    """Number of the ``width``-day bucket that holds a day."""
    return F.floor(F.datediff(day, F.lit(ORIGIN)) / F.lit(width)).cast("int")


def bucket_start(bucket: Column, width: int) -> Column:
    return F.date_add(F.lit(ORIGIN), bucket * width)


def pieces(rows: DataFrame, lo: Column, stop: Column, width: int) -> DataFrame:
    """Rows once per bucket that [lo, stop) touches, with ``_lo``, ``_stop`` and ``_bucket``; empty intervals have none."""
    held = rows.withColumns({"_lo": lo, "_stop": stop}).where("_lo < _stop")
    return held.withColumn("_bucket", F.explode(F.sequence(day_bucket(F.col("_lo"), width), day_bucket(F.date_sub("_stop", 1), width))))
