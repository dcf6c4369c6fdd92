"""Trading-calendar operators.

A calendar is the one dimension whose size is known beforehand (about 250 rows a
year), so it is read once, its size is checked, and every lookup is an equi join
against a broadcast table of sessions or of calendar days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import (
    BAR_COLUMNS,
    BAR_FREQUENCY,
    DAILY_LATENCY_VERSION,
    RAW_UNADJUSTED,
    STATUS_MISSING,
    STATUS_NORMAL,
    STATUS_SUSPENDED,
    ContractViolation,
)
from tidemark.functions.scalars import market_close_ts
from tidemark.staging import dealt

MAX_SESSIONS = 60_000


class SessionCalendar:
    """Sorted distinct sessions with a dense index from 0."""

    def __init__(self, spark: SparkSession, dates: Iterable[dt.date]):
        self.spark = spark
        self.dates = tuple(sorted(set(dates)))
        if not self.dates:
            raise ContractViolation("trading calendar is empty")
        if len(self.dates) > MAX_SESSIONS:
            raise ContractViolation(f"trading calendar has more than {MAX_SESSIONS} sessions")

    @classmethod
    def from_table(cls, table: DataFrame) -> SessionCalendar:
        """Read ``trade_date`` (or the first column); the size is checked before use."""
        name = "trade_date" if "trade_date" in table.columns else table.columns[0]
        days = table.select(F.col(name).cast("date").alias("d")).where("d is not null").distinct()
        return cls(table.sparkSession, [row["d"] for row in days.limit(MAX_SESSIONS + 1).collect()])

    @property
    def first(self) -> dt.date:
        return self.dates[0]

    @property
    def last(self) -> dt.date:
        return self.dates[-1]

    @property
    def size(self) -> int:
        return len(self.dates)

    @cached_property
    def sessions(self) -> DataFrame:
        """``(trade_date, session_idx)``, a local relation of checked size."""
        table = pa.table({"trade_date": pa.array(self.dates, pa.date32()), "session_idx": pa.array(range(self.size), pa.int32())})
        return self.spark.createDataFrame(table)

    @cached_property
    def day_map(self) -> DataFrame:
        """``(day, floor_idx, on_session)`` for every day from the first to the last session."""
        edges = pa.table(
            {
                "start": pa.array(self.dates, pa.date32()),
                "stop": pa.array([d - dt.timedelta(days=1) for d in self.dates[1:]] + [self.last], pa.date32()),
                "floor_idx": pa.array(range(self.size), pa.int32()),
            }
        )
        return self.spark.createDataFrame(edges).select(
            F.explode(F.sequence("start", "stop")).alias("day"),
            "floor_idx",
            (F.col("day") == F.col("start")).alias("on_session"),
        )

    def positions(self, df: DataFrame, column: str, floor: str = "_floor", member: str = "_member") -> DataFrame:
        """Add the index of the latest session at or before a date (-1 before the first)."""
        day = F.col(column).cast("date")
        # Met by the number of the day: a map of integer keys takes what its rows do, one of dates a memory page.
        lookup = F.broadcast(self.day_map.select(F.unix_date("day").alias("_day"), F.col("floor_idx").alias("_fi"), F.col("on_session").alias("_on")))
        joined = df.withColumn("_key", day).join(lookup, F.unix_date("_key") == F.col("_day"), "left")
        position = (
            F.when(F.col("_key").isNull(), F.lit(None).cast("int"))
            .when(F.col("_key") < F.lit(self.first), F.lit(-1))
            .when(F.col("_key") > F.lit(self.last), F.lit(self.size - 1))
            .otherwise(F.col("_fi"))
        )
        return (
            joined.withColumn(floor, position)
            .withColumn(member, F.when(F.col("_key").isNotNull(), F.coalesce(F.col("_on"), F.lit(False))))
            .drop("_key", "_day", "_fi", "_on")
        )

    def date_at(self, df: DataFrame, index: Column, out: str) -> DataFrame:
        """Add the session at an index, null outside the calendar."""
        lookup = F.broadcast(self.sessions.select(F.col("trade_date").alias(out), F.col("session_idx").alias("_at")))
        return df.withColumn("_want", index).join(lookup, F.col("_want") == F.col("_at"), "left").drop("_want", "_at")


def is_session(df: DataFrame, cal: SessionCalendar, column: str, out: str = "is_session") -> DataFrame:
    return cal.positions(df, column, "_f", out).drop("_f")


def with_session_idx(df: DataFrame, cal: SessionCalendar, column: str, out: str = "session_idx") -> DataFrame:
    """Index of the session a date falls on, null when it is not a session."""
    located = cal.positions(df, column)
    return located.withColumn(out, F.when(F.col("_member"), F.col("_floor"))).drop("_floor", "_member")


def prev_session(df: DataFrame, cal: SessionCalendar, column: str, n: int = 1, out: str = "prev_session", reason: str | None = None) -> DataFrame:
    """n-th session strictly before a date; out of range is null (with an optional reason)."""
    _check_steps(n)
    located = cal.positions(df, column)
    index = F.col("_floor") + F.when(F.col("_member"), 0).otherwise(1) - n
    return _reason(cal.date_at(located, index, out).drop("_floor", "_member"), column, out, reason, "NO_PREVIOUS_SESSION")


def next_session(df: DataFrame, cal: SessionCalendar, column: str, n: int = 1, out: str = "next_session", reason: str | None = None) -> DataFrame:
    """n-th session strictly after a date; out of range is null (with an optional reason)."""
    _check_steps(n)
    located = cal.positions(df, column)
    return _reason(cal.date_at(located, F.col("_floor") + n, out).drop("_floor", "_member"), column, out, reason, "NO_NEXT_SESSION")


def _check_steps(n: int) -> None:
    if n < 1:
        raise ContractViolation("n must be >= 1")


def _reason(df: DataFrame, column: str, out: str, reason: str | None, text: str) -> DataFrame:
    if reason is None:
        return df
    return df.withColumn(reason, F.when(F.col(column).isNotNull() & F.col(out).isNull(), F.lit(text)))


def sessions_between(df: DataFrame, cal: SessionCalendar, start: str, end: str, inclusive: bool = True, out: str = "sessions") -> DataFrame:
    """Sessions in a closed range; an end before its start fails the job."""
    located = cal.positions(cal.positions(df, start, "_fs", "_ms"), end, "_fe", "_me")
    below = F.col("_fs") - F.when(F.col("_ms"), 1).otherwise(0)
    count = F.col("_fe") - below
    if not inclusive:
        count = count - F.col("_ms").cast("int") - F.col("_me").cast("int")
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    checked = F.when(F.col(end) < F.col(start), F.raise_error(F.lit("end must be >= start"))).when(known, F.greatest(count, F.lit(0)))
    return located.withColumn(out, checked.cast("int")).drop("_fs", "_ms", "_fe", "_me")


def session_range(cal: SessionCalendar, start: object, end: object) -> DataFrame:
    return cal.sessions.where(F.col("trade_date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


def month_first_sessions(cal: SessionCalendar, start: object, end: object) -> DataFrame:
    """First session of each month inside a closed range."""
    return session_range(cal, start, end).groupBy(F.trunc("trade_date", "MM").alias("month")).agg(F.min("trade_date").alias("trade_date"))


def every_nth_session(cal: SessionCalendar, n: int, start: object | None = None, end: object | None = None) -> DataFrame:
    """Positions 0, n, 2n, … counted from the first session of the range."""
    _check_steps(n)
    inside = [d for d in cal.dates if (start is None or str(d) >= str(start)) and (end is None or str(d) <= str(end))]
    if not inside:
        return cal.sessions.where(F.lit(False))
    base = cal.dates.index(inside[0])
    return session_range(cal, inside[0], inside[-1]).where((F.col("session_idx") - base) % n == 0)


def listing_session_number(df: DataFrame, cal: SessionCalendar, list_date: str, day: str, out: str = "listing_session") -> DataFrame:
    """1 on the listing session; null before listing or when listing precedes the calendar."""
    usable = (F.col(day) >= F.col(list_date)) & (F.col(list_date) >= F.lit(cal.first))
    guarded = df.withColumn("_from", F.when(usable, F.col(list_date))).withColumn("_to", F.when(usable, F.col(day)))
    return sessions_between(guarded, cal, "_from", "_to", out=out).drop("_from", "_to")


def densify_bars(
    bars: DataFrame,
    cal: SessionCalendar,
    source_id: str = "landed.daily",
    revision_id: str = "r1",
    snapshot_id: str = "s1",
) -> DataFrame:
    """One row per security and session, with a trade status and lineage columns.

    The grid is a generator over sessions for each observed security (not a cross
    join), and both join sides hash on the security, so no key is ever wider than
    the calendar.
    """
    spans = bars.groupBy("security_id").agg(F.min("trade_date").alias("_first"), F.max("trade_date").alias("_last"))
    # Dealt, as the spans are few bytes and one task would generate every row; by one key more, or the grouping's own exchange, which AQE merges, would do.
    grid = dealt(spans, "security_id", "_first", a_core=4).select(
        "security_id", "_first", "_last", F.explode(F.sequence(F.lit(0), F.lit(cal.size - 1))).alias("_idx")
    ).join(F.broadcast(cal.sessions), F.col("_idx") == F.col("session_idx"))
    panel = grid.drop("_idx", "session_idx").join(bars, ["security_id", "trade_date"], "left")
    has_bar = F.col("close").isNotNull()
    status = (
        F.when(has_bar & (F.coalesce(F.col("volume"), F.lit(-1)) == 0), STATUS_SUSPENDED)
        .when(has_bar, STATUS_NORMAL)
        .when(F.col("trade_date").between(F.col("_first"), F.col("_last")), STATUS_SUSPENDED)
        .otherwise(STATUS_MISSING)
    )
    source = F.col("source_id") if "source_id" in bars.columns else F.lit(None).cast("string")
    stamp = market_close_ts("trade_date")
    return panel.withColumns(
        {
            "trade_status": status,
            "event_ts": stamp,
            "available_at": stamp,
            "price_basis": F.lit(RAW_UNADJUSTED),
            "source_id": F.coalesce(source, F.lit(source_id)),
            "revision_id": F.lit(revision_id),
            "snapshot_id": F.lit(snapshot_id),
            "declared_safety_latency_version": F.lit(DAILY_LATENCY_VERSION),
            "bar_frequency": F.lit(BAR_FREQUENCY),
        }
    ).select(*BAR_COLUMNS)
