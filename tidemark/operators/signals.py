"""Cross-sectional momentum for many as-of dates in one plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import BLOCKED, EVIDENCE_TAINTED, NO_DATA, OK, ContractViolation, enforce
from tidemark.functions.scalars import market_close_ts
from tidemark.operators.calendar import SessionCalendar
from tidemark.operators.returns import NO_BARS, Timeline, asof_timeline, corrected_windows, prepare_timeline, window_parts
from tidemark.staging import dealt, stage

LOOKBACK = 231
SKIP_RECENT = 21
# Scores are quotients of running products: equal ones may differ in their last bits.
RANK_DIGITS = 12
RANKING_METHOD = "ordinal_descending_rank"


def date_table(cal: SessionCalendar, dates: Sequence[dt.date], name: str = "signal_date") -> DataFrame:
    """Dates as a local relation with a dense ordinal; bounded by the calendar."""
    listed = sorted(set(dates))
    if not listed:
        raise ContractViolation("no dates given")
    if len(listed) > cal.size:
        raise ContractViolation("more dates than sessions")
    return cal.spark.createDataFrame(pa.table({name: pa.array(listed, pa.date32()), "_ord": pa.array(range(len(listed)), pa.int32())}))


def id_date_grid(ids: DataFrame, cal: SessionCalendar, dates: Sequence[dt.date], name: str = "signal_date") -> DataFrame:
    """One row per id and date, generated per id (the size of the answer itself).

    The ids are dealt first: they are few bytes, and AQE would have one task generate and look up every row.
    """
    table = date_table(cal, dates, name)
    count = len(set(dates))
    numbered = dealt(ids.select("security_id"), "security_id", a_core=4).distinct().withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return numbered.join(F.broadcast(table), F.col("_o") == F.col("_ord")).select("security_id", name)


def score_dates(bars: DataFrame, cal: SessionCalendar, dates: Sequence[dt.date], skip: int = SKIP_RECENT, basis: str = "bars") -> DataFrame:
    """Per signal date the date ``skip`` positions back among dates that have bars.

    ``basis='calendar'`` counts sessions instead. Too little history gives null.
    """
    sessions = cal.sessions
    if basis == "bars":
        present = bars.select("trade_date").distinct().withColumn("_has", F.lit(1))
        # A calendar-sized frame: its global order is one short task by construction.
        flagged = sessions.join(present, "trade_date", "left")
        order = Window.orderBy("session_idx").rowsBetween(Window.unboundedPreceding, 0)
        counted = flagged.withColumn("_n", F.sum(F.coalesce("_has", F.lit(0))).over(order).cast("int"))
    else:
        counted = sessions.withColumn("_has", F.lit(1)).withColumn("_n", (F.col("session_idx") + 1).cast("int"))
    located = cal.positions(date_table(cal, dates), "signal_date").drop("_member")
    at = located.join(counted.select(F.col("session_idx").alias("_floor"), "_n"), "_floor", "left")
    target = counted.where("_has = 1").select(F.col("trade_date").alias("score_date"), F.col("session_idx").alias("score_idx"), F.col("_n").alias("_want"))
    return at.withColumn("_want", F.col("_n") - skip).join(target, "_want", "left").select("signal_date", "score_date", "score_idx")


def ordinal_rank(score: Column, by: Sequence[str], tie: str = "security_id") -> Column:
    """1..n by score (to ``RANK_DIGITS`` decimals) descending, then id; never shared."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.round(score, RANK_DIGITS).desc(), F.col(tie)))


def momentum_signal(
    bars: DataFrame,
    actions: DataFrame,
    cal: SessionCalendar,
    ids: DataFrame,
    signal_dates: Sequence[dt.date],
    lookback: int = LOOKBACK,
    skip: int = SKIP_RECENT,
    score_basis: str = "bars",
    line: Timeline | None = None,
    derivation_asof: object | None = None,
) -> DataFrame:
    """Signal points ``(signal_date, security_id)`` with status, score, rank and reason.

    The as-of of a signal date is its 15:00 close, for prices and corporate actions
    alike. All points read precomputed windows; those touched by an action that landed
    after its ex-date are corrected by the version known at their as-of. With
    ``derivation_asof`` all returns are derived as known at that one stamp instead, while
    score dates still follow each signal date.
    """
    if derivation_asof is not None:
        if line is not None:
            raise ValueError("a prepared timeline already has its derivation")
        universe = bars.join(ids.select("security_id").distinct(), "security_id", "left_semi")
        line = Timeline(stage(asof_timeline(universe, actions, cal, derivation_asof), "timeline"), None)
    if line is None:
        line = prepare_timeline(bars, actions, cal, ids)
    windows = window_parts(line.rows, lookback)
    order = Window.partitionBy("security_id").orderBy("end_no")
    until = F.coalesce(F.lead("session_idx").over(order) - 1, F.lit(cal.size - 1))
    spread = windows.withColumn("_until", until).where(F.col("_until") >= F.col("session_idx"))
    scores = score_dates(line.rows, cal, signal_dates, skip, score_basis)
    held = spread.withColumn("score_idx", F.explode(F.sequence("session_idx", "_until"))).drop("session_idx", "_until")
    scored = held.join(F.broadcast(scores), "score_idx").select("security_id", "signal_date", "start_no", "end_no", market_close_ts("signal_date").alias("asof_ts"), "_w")
    known = corrected_windows(scored, line, "growth")
    outcome = known.select("security_id", "signal_date", "status", F.col("block_reason").alias("reason"), (F.col("value") - 1.0).alias("momentum_score"))
    scored_on = F.broadcast(scores.select(F.unix_date("signal_date").alias("_day"), "score_date"))
    grid = id_date_grid(ids, cal, signal_dates).join(scored_on, F.unix_date("signal_date") == F.col("_day")).drop("_day")
    # Merged: outcomes are as many as the grid's rows, and as a map they would go through the driver.
    points = grid.join(outcome.hint("merge"), ["security_id", "signal_date"], "left")
    status = F.when(F.col("score_date").isNull(), F.raise_error(F.lit("not enough visible trading days to skip the recent window"))).otherwise(F.coalesce("status", F.lit(NO_DATA)))
    points = points.withColumn("status", status).withColumn("reason", F.when(F.col("status") != OK, F.coalesce("reason", F.lit(NO_BARS))))
    return rank_points(points)


def rank_points(points: DataFrame) -> DataFrame:
    """Rank OK points per signal date and count the scorable universe.

    Scores equal to ``RANK_DIGITS`` decimals are ranked by id.
    """
    ok = F.col("status") == OK
    by_date = Window.partitionBy("signal_date")
    ranked = points.withColumn("_r", F.row_number().over(by_date.orderBy(ok.desc(), F.round("momentum_score", RANK_DIGITS).desc(), F.col("security_id"))))
    return ranked.withColumns(
        {
            "cross_sectional_rank": F.when(ok, F.col("_r")),
            "universe_size": F.sum(F.when(ok, 1).otherwise(0)).over(by_date),
            "evidence_status": F.lit(EVIDENCE_TAINTED),
        }
    ).drop("_r")


def exclusion_counts(points: DataFrame) -> DataFrame:
    """Excluded points per signal date and status; absent statuses have no row."""
    return points.where(F.col("status").isin(BLOCKED, NO_DATA)).groupBy("signal_date", "status").agg(F.count(F.lit(1)).alias("excluded"))


def tradable_signal(points: DataFrame, tradable: DataFrame) -> DataFrame:
    """Keep points whose security trades normally on the signal date and recount."""
    kept = points.join(tradable.select(F.col("trade_date").alias("signal_date"), "security_id"), ["signal_date", "security_id"], "left_semi")
    ok = F.sum(F.when(F.col("status") == OK, 1).otherwise(0)).over(Window.partitionBy("signal_date"))
    return kept.withColumn("universe_size", ok)


SIGNAL_COLUMNS = ("signal_asof_ts", "score_asof_ts", "security_id", "signal_status", "momentum_score", "cross_sectional_rank")
FUTURE_COLUMNS = ("future_return", "label_status", "label_end_ts", "label_observed_at", "rank_ic")


def project_signal(predictions: DataFrame) -> DataFrame:
    """Read only the signal columns: the scan never touches label or return columns."""
    missing = [name for name in SIGNAL_COLUMNS if name not in predictions.columns]
    if missing:
        raise ContractViolation(f"predictions missing projected signal columns: {missing}")
    return predictions.select(*SIGNAL_COLUMNS)


def refuse_future_columns(frame: DataFrame) -> DataFrame:
    """Fail when a frame handed to the execution side still carries future columns."""
    leaked = sorted(set(FUTURE_COLUMNS) & set(frame.columns))
    if leaked:
        raise ContractViolation(f"future columns crossed the signal projection: {leaked}")
    return frame


def bind_hashes_by_order(predictions: DataFrame, cal: SessionCalendar, start: object, end: object, hashes: Sequence[str], expected_ids: DataFrame) -> DataFrame:
    """n-th session of a range bound to the n-th hash; dates, keys and ids must agree."""
    window = [d for d in cal.dates if str(start) <= str(d) <= str(end)]
    if not window or str(window[0]) != str(start) or str(window[-1]) != str(end):
        raise ContractViolation("calendar does not cover the signal window")
    if len(hashes) != len(window):
        raise ContractViolation("one ordered hash per session is required")
    table = cal.spark.createDataFrame(pa.table({"signal_date": pa.array(window, pa.date32()), "signal_manifest_hash": pa.array(list(hashes))}))
    rows = predictions.withColumn("signal_date", F.to_date("signal_asof_ts"))
    observed = rows.select("signal_date").distinct()
    from tidemark.contracts import duplicate_keys, union_all, violation

    enforce(
        union_all(
            [
                violation(table.join(observed, "signal_date", "left_anti"), F.lit(True), "SESSION_WITHOUT_SIGNAL", ["signal_date"]),
                violation(observed.join(table, "signal_date", "left_anti"), F.lit(True), "SIGNAL_OUTSIDE_SESSIONS", ["signal_date"]),
                duplicate_keys(rows, ["signal_date", "security_id"], "DUPLICATE_SIGNAL"),
                violation(rows.join(expected_ids, "security_id", "left_anti"), F.lit(True), "SECURITY_NOT_EXPECTED", ["security_id"]),
            ]
        )
    )
    return rows.join(F.broadcast(table), "signal_date")
