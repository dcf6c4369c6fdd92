"""Hand-computed cases for calendar, pricing, returns, visibility and labels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.contracts import ContractViolation, enforce
from tidemark.functions.pricing import reference_price
from tidemark.operators import calendar as calops
from tidemark.operators import pit, returns
from tidemark.operators.calendar import SessionCalendar
from tidemark.operators.evaluation import block_bootstrap_ci, rank_ic
from tidemark.operators.labels import LabelSpec, future_return_labels
from tidemark.operators.lineage import first_difference, table_fingerprint
from tidemark.operators.signals import id_date_grid, momentum_signal


def days(*texts):
    return [dt.date.fromisoformat(x) for x in texts]


WEEK = days("2026-01-05", "2026-01-06", "2026-01-07", "2026-01-08", "2026-01-09", "2026-01-12")


def make_bars(spark, rows):
    """rows: (security, date, open, close)"""
    frame = spark.createDataFrame([(s, dt.date.fromisoformat(d), o, c) for s, d, o, c in rows], "security_id string, trade_date date, o string, c string")
    stamp = F.col("trade_date").cast("timestamp_ntz") + F.expr("interval 15 hours")
    return frame.select(
        "security_id", "trade_date", F.col("o").cast("decimal(18,6)").alias("open"), F.col("c").cast("decimal(18,6)").alias("close"), F.lit("正常").alias("trade_status"),
        stamp.alias("event_ts"), stamp.alias("available_at"), F.lit("RAW_UNADJUSTED").alias("price_basis"), F.lit("s1").alias("snapshot_id"),
    )


def make_actions(spark, rows):
    """rows: (security, ex, type, cash, ratio, rights price, available)"""
    schema = "security_id string, ex string, action_type string, cash string, ratio string, rp string, av string"
    frame = spark.createDataFrame(rows, schema)
    return frame.select(
        "security_id", F.col("ex").cast("date").alias("ex_date"), "action_type", F.col("cash").cast("decimal(18,6)").alias("cash_dividend_per_share"), F.col("ratio").cast("decimal(18,6)").alias("share_ratio"),
        F.col("rp").cast("decimal(18,6)").alias("rights_price_per_share"), F.col("av").cast("timestamp_ntz").alias("available_at"), F.lit("src").alias("source_id"), F.lit("s1").alias("snapshot_id"),
    )


@pytest.mark.parametrize(
    "prev, cash, split, rr, rp, expected",
    [("10", "1", "0", "0", "0", 9.0), ("12", "0", "0.5", "0", "0", 8.0), ("12", "0", "0", "0.5", "6", 10.0), ("95.88", "0.23", "0.2", "0", "0", 79.70833333)],
)
def test_reference_price(spark, prev, cash, split, rr, rp, expected):
    d = lambda x: F.lit(x).cast("decimal(18,6)")
    price = reference_price(F.lit("2020-01-02").cast("date"), d(prev), d(cash), d(split), d(rr), d(rp))
    assert float(spark.range(1).select(price).first()[0]) == pytest.approx(expected, abs=1e-8)


def test_reference_price_before_first_rule_fails(spark):
    d = lambda x: F.lit(x).cast("decimal(18,6)")
    with pytest.raises(Exception, match="no ex-right pricing rule"):
        spark.range(1).select(reference_price(F.lit("2010-01-04").cast("date"), d("10"), d("1"), d("0"), d("0"), d("0"))).collect()


def test_calendar_gap(spark):
    cal = SessionCalendar(spark, days("2024-09-27", "2024-09-30", "2024-10-08", "2024-10-09"))
    frame = spark.createDataFrame([(dt.date(2024, 10, 8), dt.date(2024, 9, 30)), (dt.date(2024, 10, 3), dt.date(2024, 10, 1))], "d date, a date")
    out = calops.sessions_between(calops.next_session(calops.prev_session(frame, cal, "d"), cal, "d"), cal, "a", "d").orderBy("d").collect()
    assert [(r["prev_session"], r["next_session"], r["sessions"]) for r in out] == [(dt.date(2024, 9, 30), dt.date(2024, 10, 8), 0), (dt.date(2024, 9, 30), dt.date(2024, 10, 9), 2)]


def test_daily_returns_cash_dividend(spark):
    cal = SessionCalendar(spark, WEEK)
    bars = make_bars(spark, [("000001", "2026-01-05", "10", "10.00"), ("000001", "2026-01-06", "9.1", "9.50"), ("000001", "2026-01-07", "9.9", "10.45")])
    actions = make_actions(spark, [("000001", "2026-01-06", "CASH_DIVIDEND", "1.00", "0", None, "2026-01-02 15:00:00")])
    rows = returns.daily_adjusted_returns(bars, actions, cal, "2026-01-07T15:00:00+08:00").orderBy("trade_date").collect()
    assert [r["status"] for r in rows] == ["NO_DATA", "OK", "OK"]
    assert float(rows[1]["adjusted_return"]) == pytest.approx(9.5 / 9 - 1)
    assert float(rows[2]["adjusted_return"]) == pytest.approx(0.10)


def test_late_revision_only_changes_later_asofs(spark):
    """A signal before a late action lands must not see it; one after it must."""
    cal = SessionCalendar(spark, WEEK)
    bars = make_bars(spark, [("000001", str(d), "10", "10.00") for d in WEEK])
    actions = make_actions(spark, [("000001", "2026-01-07", "CASH_DIVIDEND", "1.00", "0", None, "2026-01-09 10:00:00")])
    ids = bars.select("security_id").distinct()
    rows = momentum_signal(bars, actions, cal, ids, [WEEK[3], WEEK[4]], lookback=2, skip=1).orderBy("signal_date").collect()
    assert rows[0]["momentum_score"] == pytest.approx(0.0)
    rows = momentum_signal(bars, actions, cal, ids, [WEEK[4]], lookback=2, skip=1).collect()
    assert rows[0]["momentum_score"] == pytest.approx(10 / 9 - 1)


def test_orphan_ex_date_blocks_the_range(spark):
    cal = SessionCalendar(spark, WEEK)
    bars = make_bars(spark, [("000001", str(d), "10", "10.00") for d in WEEK if d != WEEK[2]])
    actions = make_actions(spark, [("000001", str(WEEK[2]), "CASH_DIVIDEND", "1.00", "0", None, "2026-01-02 15:00:00")])
    rows = returns.daily_adjusted_returns(bars, actions, cal, "2026-01-12 15:00:00").collect()
    assert {r["block_reason"] for r in rows} == {"CA_EX_DATE_ON_MISSING_BAR_DATE"}


def test_open_to_open_label(spark):
    cal = SessionCalendar(spark, WEEK)
    bars = make_bars(spark, [("000001", "2026-01-05", "10", "10"), ("000001", "2026-01-06", "10.00", "10.00"), ("000001", "2026-01-07", "9.10", "9.50"), ("000001", "2026-01-08", "9.90", "9.90")])
    actions = make_actions(spark, [("000001", "2026-01-07", "CASH_DIVIDEND", "1.00", "0", None, "2026-01-02 15:00:00")])
    label = future_return_labels(bars, actions, cal, bars.select("security_id").distinct(), [WEEK[0]], LabelSpec(holding=2)).first()
    assert label["status"] == "OK" and label["future_return"] == pytest.approx(0.10)
    assert label["corporate_action_manifest"] == "000001:2026-01-07:CASH_DIVIDEND:src"


def test_unknown_disclosure_time_is_visible_next_session(spark):
    cal = SessionCalendar(spark, days("2026-01-02", "2026-01-05", "2026-01-06"))
    rows = spark.createDataFrame([("000001", dt.date(2026, 1, 6), dt.date(2026, 1, 2), False), ("000001", dt.date(2026, 1, 5), dt.date(2026, 1, 2), False)], "security_id string, ex_date date, disclosure_date date, disclosure_time_known boolean")
    out = {r["ex_date"]: r for r in pit.resolve_available_at(rows, cal).collect()}
    assert str(out[dt.date(2026, 1, 6)]["resolved_available_at"]) == "2026-01-05 09:30:00"
    assert out[dt.date(2026, 1, 5)]["availability_reason"] == "NOT_VERIFIABLE_BEFORE_EX_DATE"
    with pytest.raises(ContractViolation):
        enforce(pit.availability_violations(rows, cal))


def test_rank_ic_and_constant_bootstrap(spark):
    scores, rets = [0.5, 0.4, 0.3, 0.2, 0.1], [0.10, 0.04, 0.08, -0.01, 0.02]
    date = dt.date(2026, 1, 5)
    points = spark.createDataFrame([(date, f"00000{i}", "OK", s, 5) for i, s in enumerate(scores)], "signal_date date, security_id string, status string, momentum_score double, universe_size int")
    at = dt.datetime(2026, 1, 8, 15)
    labels = spark.createDataFrame([(date, f"00000{i}", r, at, at, "OK") for i, r in enumerate(rets)], "signal_date date, security_id string, future_return double, label_end_ts timestamp_ntz, label_observed_at timestamp_ntz, status string")
    assert rank_ic(points, labels, "2026-02-01 15:00:00").first()["rank_ic"] == pytest.approx(0.8)
    early = rank_ic(points, labels, "2026-01-08 14:00:00").first()
    assert early["rank_ic"] is None and early["immature_label_count"] == 5
    series = spark.createDataFrame([(dt.date(2026, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(22)], "signal_date date, rank_ic double")
    ci = block_bootstrap_ci(series).first()
    assert (ci["ci_low"], ci["ci_high"]) == (1.0, 1.0)
    short = block_bootstrap_ci(series.limit(1)).first()
    assert short["ci_low"] is None and "insufficient" in short["ci_method"]


def test_future_mutation_and_fingerprint(spark):
    cal = SessionCalendar(spark, WEEK)
    bars = make_bars(spark, [("000001", str(d), "10", str(10 + i)) for i, d in enumerate(WEEK)])
    changed = bars.withColumn("close", F.when(F.col("trade_date") > F.lit(WEEK[2]), F.col("close") * 2).otherwise(F.col("close")).cast("decimal(18,6)"))
    none = make_actions(spark, [("000009", "2026-01-07", "CASH_DIVIDEND", "1.00", "0", None, "2026-01-02 15:00:00")])
    columns = ["security_id", "trade_date", "status", "adjusted_return"]
    before = returns.daily_adjusted_returns(bars, none, cal, f"{WEEK[2]} 15:00:00").select(*columns)
    after = returns.daily_adjusted_returns(changed, none, cal, f"{WEEK[2]} 15:00:00").select(*columns)
    assert first_difference(before, after, ["security_id", "trade_date"]).isEmpty()
    same, other = table_fingerprint(bars.repartition(3)).first(), table_fingerprint(changed).first()
    assert table_fingerprint(bars).first() == same and same["fingerprint"] != other["fingerprint"]


def _tasks(rows):
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_rows_of_ids_and_sessions_are_generated_in_several_tasks(spark):
    """A few hundred ids are few bytes, but each becomes a row per session: AQE merged them into one task."""
    cal = SessionCalendar(spark, WEEK)
    ids = spark.range(200).select(F.format_string("60%04d", "id").alias("security_id")).repartition(2)
    grid = id_date_grid(ids.unionByName(ids), cal, WEEK[1:])
    assert grid.count() == grid.distinct().count() == 200 * 5
    assert _tasks(grid) > 1
    some = ids.select("security_id", F.lit(WEEK[1]).alias("trade_date"), *[F.lit(10).cast("decimal(18,6)").alias(c) for c in ("open", "high", "low", "close")], F.lit(5).alias("volume"), F.lit(50).cast("decimal(24,4)").alias("amount"))
    panel = calops.densify_bars(some, cal)
    assert panel.count() == panel.select("security_id", "trade_date").distinct().count() == 200 * 6
    assert panel.where("close is not null").count() == 200
    assert _tasks(panel) > 1


def test_session_positions_are_looked_up_by_day_number(spark):
    """The broadcast map of days has an integer key; before the first, between, after the last session and null read as ever."""
    cal = SessionCalendar(spark, WEEK)
    rows = spark.createDataFrame([(d,) for d in (dt.date(1969, 12, 31), *days("2026-01-04", "2026-01-05", "2026-01-10", "2026-01-12", "2026-01-13"), None)], "d date")
    located = cal.positions(rows, "d")
    assert [(r["_floor"], r["_member"]) for r in sorted(located.collect(), key=lambda r: str(r["d"]))] == [(-1, False), (-1, False), (0, True), (4, False), (5, True), (5, False), (None, None)]
    assert "unix_date" in located._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_all_bars_are_not_broadcast(spark):
    """Small on disk, large as a map: timeline rows, window edges and outcomes meet by merging, however small they look."""
    cal = SessionCalendar(spark, WEEK)
    bars = make_bars(spark, [("600001", d.isoformat(), "10", "10") for d in WEEK])
    actions = make_actions(spark, [("600001", "2026-01-07", "CASH_DIVIDEND", "1", "0", None, "2026-01-08 15:00:00")])
    ids = bars.select("security_id").distinct()
    line = returns.prepare_timeline(bars, actions, cal, ids)
    labels = future_return_labels(bars, actions, cal, ids, WEEK[:2], LabelSpec(name="short", holding=2), manifest=False, line=line)
    signal = momentum_signal(bars, actions, cal, ids, WEEK[3:], lookback=2, skip=1, line=line)
    for frame, merged in ((labels, 2), (signal, 1)):
        assert frame._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == merged
    assert labels.where("status = 'OK'").count() == 2
