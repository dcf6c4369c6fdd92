"""Ledger states, ranks of equal scores, as-of tables, cash admission and join layouts."""

import datetime as dt
import random
import time
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as led
from tidemark.operators import lineage, pit, signals
from tidemark.operators import orders as ords
from tidemark.operators.asof import running_sum
from tidemark.operators.orders import accept_in_order
from tidemark.staging import CLEANUP, checkpoint_root, stage, staging_scope


def test_greedy_admission_in_prefixes_equals_the_loop():
    rng = random.Random(5)
    for _ in range(200):
        reserves = np.array([rng.randrange(1, 60) for _ in range(rng.randrange(0, 40))], dtype=np.int64)
        left = rng.randrange(0, 300)
        keep = np.zeros(len(reserves), dtype=bool)
        after = accept_in_order(reserves, left, keep)
        want = []
        for r in reserves.tolist():
            fits = r <= left
            left -= r if fits else 0
            want.append(fits)
        assert keep.tolist() == want and after == left


def test_staging_deletes_the_shuffles_it_wrote(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(CLEANUP)
    staged = stage(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(4, "k").groupBy("k").count(), "dropped")
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP) == setting and staged.count() == 7


def test_admission_and_fills_move_orders_once_by_day(spark):
    """Both in one plan shuffle the orders once, and an order's bar may come with it."""
    date = dt.date(2026, 1, 5)
    locked = spark.createDataFrame(
        [(p, date, date + dt.timedelta(days=1), f"{i:06d}", side, i, "LOCKED", None, 100, 50.0 * (side == "buy"), "NOT_EVALUATED", None, None) for p in (1, 2) for i in range(6) for side in ("buy", "sell")],
        "portfolio_id bigint, decision_date date, next_session date, security_id string, side string, intent_seq int, lock_status string, reject_reason string, locked_quantity bigint, reserved_cash double, limit_check string, price_cap decimal(18,2), price_floor decimal(18,2)",
    ).withColumn("reserved_cash", F.col("reserved_cash").cast("decimal(18,2)"))
    cash = spark.createDataFrame([(1, date, 120.0), (2, date, 1000.0)], "portfolio_id bigint, decision_date date, available_cash double")
    bars = spark.createDataFrame([(f"{i:06d}", date + dt.timedelta(days=1), "10", "正常") for i in range(5)], "security_id string, trade_date date, open string, trade_status string").withColumn("open", F.col("open").cast("decimal(18,6)"))
    apart = ords.fill_orders(ords.admit_by_cash(locked, cash), bars)
    together = ords.fill_orders(ords.admit_by_cash(stage(ords.execution_bar(locked, bars), "with-bars"), cash), bars)
    assert sorted(map(str, together.select(apart.columns).collect())) == sorted(map(str, apart.collect()))
    assert sum(r.reason == "CASH_INSUFFICIENT" for r in together.collect()) == 4 and sum(r.reason == "NO_OPEN_PRICE" for r in together.collect()) == 3
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [portfolio_id") == 2 and plan[: plan.index("Union")].count("Join") == 0  # the orders; what is left for the walk


def test_equal_scores_rank_by_id(spark):
    noise = [1.1e-16, -2.2e-16, 4.4e-16, 0.0]
    points = spark.createDataFrame([(f"{i:06d}", dt.date(2020, 1, 3), "OK", 0.25 + noise[i % 4]) for i in range(12)] + [("000099", dt.date(2020, 1, 3), "NO_DATA", None)], "security_id string, signal_date date, status string, momentum_score double")
    ranked = {r.security_id: r for r in signals.rank_points(points).collect()}
    assert [ranked[f"{i:06d}"].cross_sectional_rank for i in range(12)] == list(range(1, 13))
    assert ranked["000099"].cross_sectional_rank is None and ranked["000099"].universe_size == 12


def test_signal_hash_covers_its_header(spark):
    points = spark.createDataFrame([("000001", dt.date(2020, 1, 3), "OK", None, 0.5, 1, 1, dt.date(2020, 1, 2))], "security_id string, signal_date date, status string, reason string, momentum_score double, cross_sectional_rank int, universe_size long, score_date date")
    prints = [lineage.signal_fingerprint(points, {"lookback": n, "input_snapshot_id": s}).first()["signal_manifest_hash"] for n, s in ((231, "a"), (230, "a"), (231, "b"), (231, "a"))]
    assert len(set(prints)) == 3 and prints[0] == prints[3]


def test_first_visible_asof_of_many(spark):
    base = dt.datetime(2020, 1, 1)
    rng = random.Random(3)
    asofs = sorted({base + dt.timedelta(hours=rng.randrange(24 * 40)) for _ in range(25)})
    stamps = [base + dt.timedelta(minutes=rng.randrange(-3000, 60 * 24 * 45)) for _ in range(300)] + [None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, available_at timestamp_ntz")
    got = {r.i: r.visible_from for r in pit.pit_query_many(rows, spark.createDataFrame([(a,) for a in asofs], "asof_ts timestamp_ntz")).collect()}
    for i, s in enumerate(stamps):
        want = None if s is None else next((a for a in asofs if a >= s), None)
        assert got[i] == want
    with pytest.raises(Exception, match="no as-of"):
        pit.pit_query_many(rows, spark.createDataFrame([], "asof_ts timestamp_ntz"))


def test_running_sums_share_one_pass(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(4), i, rng.randrange(10), rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, b int, i int, x long, y long")
    got = {r.i: (r.sx, r.sy) for r in running_sum(df, ["k"], ["b"], ["i"], ["x", "y"], ["sx", "sy"]).collect()}
    totals = {}
    for k, b, i, x, y in sorted(rows):
        old = totals.get(k, (0, 0))
        totals[k] = (old[0] + x, old[1] + y)
        assert got[i] == totals[k]


ENTRY = "portfolio_id long, security_id string, trade_date date, event_id long, cash_after decimal(18,2), receivable_after decimal(18,2), position_quantity_after long, locked_quantity_after long"


def test_every_ledger_rule_is_broken_once(spark):
    day = dt.date(2020, 1, 3)
    good = (1, "000001", day, 1, Decimal("5"), Decimal("0"), 100, 0)
    cases = {"NEGATIVE_CASH": {4: Decimal("-0.01")}, "NEGATIVE_RECEIVABLE": {5: Decimal("-1")}, "NEGATIVE_POSITION": {6: -50}, "NEGATIVE_LOCK": {7: -1}}
    rows = [good]
    for n, change in enumerate(cases.values(), 2):
        row = list(good)
        row[3] = n
        for k, v in change.items():
            row[k] = v
        rows.append(tuple(row))
    found = led.ledger_violations(spark.createDataFrame(rows, ENTRY)).collect()
    assert sorted(r["check"] for r in found) == sorted(cases) and len({r["key"] for r in found}) == 4


def test_hot_security_is_not_one_task(spark):
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    bars = spark.range(50).select(F.lit("000001").alias("security_id"), F.col("id").alias("day"))
    orders = spark.range(5000).select(F.lit("000001").alias("security_id"), (F.col("id") % 50).alias("day"), F.col("id").alias("n"))
    from pyspark.sql import Window

    state = bars.withColumn("m", F.max("day").over(Window.partitionBy("security_id").orderBy("day")))
    with_hint = orders.hint("merge").join(state, ["security_id", "day"])
    plan = with_hint._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(security_id#" not in plan.split("SortMergeJoin")[1].split("Window")[0]


def test_staging_is_shared_and_released(spark, tmp_path):
    import os

    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir") or root in spark.sparkContext.getConf().get("spark.checkpoint.dir")
    with staging_scope(spark):
        kept = stage(spark.range(5), "scoped")
        folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert kept.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)
