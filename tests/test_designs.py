"""Splits, memberships, releases, late versions, incremental builds, reports, rules, universes and scenarios on awkward rows."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_market import make_actions, make_bars
from tidemark.contracts import ContractViolation
from tidemark.functions.pricing import FeeSchedule
from tidemark.functions.scalars import market_close_ts
from tidemark.operators import evidence, membership, orders, performance, releases, returns, rules, splits, universe
from tidemark.operators.calendar import SessionCalendar
from tidemark.plans import incremental
from tidemark.plans.scenarios import Scenario, run_scenarios
from tidemark.staging import stage

DAY = dt.date(2026, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def stamp(k, hour=15):
    return dt.datetime.combine(day(k), dt.time(hour))


@pytest.fixture(scope="module")
def cal40(spark):
    return SessionCalendar(spark, [day(k) for k in range(40)])


# -- walk-forward folds ----------------------------------------------------------

SAMPLES = "sample_id string, security_id string, decision_ts timestamp_ntz, label_end_ts timestamp_ntz, feature_asof_ts timestamp_ntz"


def made_samples(spark, rows):
    return spark.createDataFrame([(f"{k}/{s}", s, stamp(k), stamp(k + h), stamp(k)) for k, s, h in rows], SAMPLES)


@pytest.mark.parametrize("plan", [splits.WalkForward(5, 10, test=4, embargo=2), splits.WalkForward(3, 6, step=7, train=9, embargo=1), splits.WalkForward(4, 4, test=2, step=1, purge_validation=False)])
def test_folds_equal_a_plain_loop_and_break_no_rule(spark, cal40, plan):
    rng = random.Random(plan.validation)
    rows = [(k, s, rng.choice((1, 2, 6, 15))) for k in range(40) for s in "ab" if rng.random() < 0.8]
    want = set()
    v = plan.min_train
    fold = 0
    while v + plan.validation + ((plan.embargo + plan.test) if plan.test else 0) <= 40:
        block = {}
        for k in range(40):
            after = plan.validation + plan.embargo
            if (0 if plan.train is None else v - plan.train) <= k < v:
                block[k] = "TRAIN"
            elif v <= k < v + plan.validation:
                block[k] = "VALIDATION"
            elif v + plan.validation <= k < v + after or (plan.test and v + after + plan.test <= k < v + after + plan.test + plan.embargo):
                block[k] = "EMBARGO"
            elif plan.test and v + after <= k < v + after + plan.test:
                block[k] = "TEST"
        first = lambda b: min((k for k, *_ in rows if block.get(k) == b), default=None)
        for k, s, h in rows:
            limit = {"TRAIN": first("VALIDATION") if first("VALIDATION") is not None else first("TEST"), "VALIDATION": first("TEST") if plan.purge_validation else None}.get(block.get(k))
            if k in block:
                want.add((f"{k}/{s}", fold, "PURGED" if limit is not None and k + h >= limit else block[k]))
        v, fold = v + plan.stride, fold + 1
    assigned = splits.walk_forward(made_samples(spark, rows), cal40, plan)
    assert {(r.sample_id, r.fold, r.role) for r in assigned.collect()} == want and plan.folds(40) == fold
    assert splits.fold_violations(assigned, cal40, plan).isEmpty()


def test_folds_need_room_and_sessions(spark, cal40):
    rows = made_samples(spark, [(0, "a", 1)])
    assert splits.walk_forward(rows, cal40, splits.WalkForward(30, 30)).isEmpty()
    outside = made_samples(spark, [(500, "a", 1), (12, "a", 1)])
    assert {r.sample_id for r in splits.walk_forward(outside, cal40, splits.WalkForward(5, 10)).collect()} == {"12/a"}
    with pytest.raises(ContractViolation):
        splits.WalkForward(0, 3)
    with pytest.raises(ContractViolation):
        splits.WalkForward(3, 10, train=5)


def test_each_broken_sample_rule_is_named(spark, cal40):
    good = [("a", "x", stamp(3), stamp(4), stamp(3))]
    bad = [(None, "x", stamp(3), stamp(4), stamp(3)), ("b", "x", stamp(90), stamp(91), stamp(90)), ("c", "x", stamp(5), stamp(5), stamp(5)), ("d", "x", stamp(6), stamp(8), stamp(7)), ("e", "x", stamp(7), stamp(8), stamp(7)), ("e", "y", stamp(7), stamp(8), stamp(7))]
    found = {r["check"] for r in splits.sample_violations(spark.createDataFrame(good + bad, SAMPLES), cal40).collect()}
    assert found == {"SAMPLE_FIELD_MISSING", "DECISION_NOT_A_SESSION", "LABEL_ENDS_BEFORE_DECISION", "FEATURE_AFTER_DECISION", "DUPLICATE_SAMPLE"}
    assert splits.sample_violations(spark.createDataFrame(good, SAMPLES), cal40).isEmpty()


# -- index membership --------------------------------------------------------------

MEMBERS = "index_id string, security_id string, effective_from date, effective_to date, is_member boolean, available_at timestamp_ntz, revision_id string"


def member(security, lo, hi, known, revision="r1", is_member=True):
    return ("i", security, day(lo), None if hi is None else day(hi), is_member, stamp(known), revision)


def test_corrections_cut_join_and_reopen_memberships(spark):
    rows = spark.createDataFrame([member("a", 0, None, 0), member("a", 100, 200, 150, is_member=False), member("a", 120, 130, 160), member("b", 0, 50, 0), member("b", 80, 90, 0), member("b", 50, 80, 70, "r2"), member("c", 5, 9, 300)], MEMBERS)
    asks = spark.createDataFrame([("i", day(d), stamp(a)) for d, a in ((110, 110), (110, 155), (125, 155), (125, 165), (60, 60), (60, 75), (90, 75), (6, 75), (6, 301))], "index_id string, date date, asof_ts timestamp_ntz")
    got = {}
    for r in membership.members_at(rows, asks, bucket_days=7).collect():
        got.setdefault(((r.date - DAY).days, (r.asof_ts.date() - DAY).days), set()).add(r.security_id)
    assert got == {(110, 110): {"a"}, (125, 165): {"a"}, (60, 60): {"a"}, (60, 75): {"a", "b"}, (90, 75): {"a"}, (6, 75): {"a", "b"}, (6, 301): {"a", "b", "c"}}
    known = membership.known_intervals(rows, [stamp(60), stamp(400)], bucket_days=31).collect()
    spans = {((r.asof_ts.date() - DAY).days, r.security_id, (r.effective_from - DAY).days, r.effective_to and (r.effective_to - DAY).days) for r in known}
    assert spans == {(60, "a", 0, None), (60, "b", 0, 50), (60, "b", 80, 90), (400, "a", 0, 100), (400, "a", 120, 130), (400, "a", 200, None), (400, "b", 0, 90), (400, "c", 5, 9)}


def test_membership_intervals_equal_a_day_by_day_version(spark):
    rng = random.Random(6)
    raw = []
    for k in range(90):
        lo = rng.randrange(120)
        raw.append(member(rng.choice("ab"), lo, None if rng.random() < 0.2 else lo + rng.randrange(1, 70), rng.randrange(140), f"r{k:02}", rng.random() < 0.6))
    for asof in (30, 200):
        want = set()
        for s in "ab":
            inside = []
            for d in range(200):
                rows = [r for r in raw if r[1] == s and r[2] <= day(d) and (r[3] is None or day(d) < r[3]) and r[5] <= stamp(asof)]
                inside.append(bool(rows) and max(rows, key=lambda r: (r[5], r[6]))[4])
            start = None
            for d in range(200):
                if inside[d] and start is None:
                    start = d
                if start is not None and (not inside[d] or d == 199):
                    want.add((s, start, None if inside[d] else d))
                    start = None
        got = {(r.security_id, (r.effective_from - DAY).days, r.effective_to and (r.effective_to - DAY).days) for r in membership.known_intervals(spark.createDataFrame(raw, MEMBERS), [stamp(asof)], bucket_days=13).collect()}
        assert got == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_members_are_decided_where_their_rows_are_without_a_sort_of_the_hits(spark):
    rows = spark.createDataFrame([member("a", 0, None, 0), member("a", 3, None, 0, "r2", False), member("a", 5, 90, 0, "r2", True), member(None, 0, None, 0)], MEMBERS)
    asks = spark.createDataFrame([("i", day(k), stamp(400)) for k in (1, 4, 8)], "index_id string, date date, asof_ts timestamp_ntz")
    found = membership.members_at(rows, asks)
    assert sorted(((r.date - DAY).days, str(r.security_id), r.revision_id) for r in found.collect()) == [(1, "None", "r1"), (1, "a", "r1"), (4, "None", "r1"), (8, "None", "r1"), (8, "a", "r2")]
    assert "SortAggregate" not in _plan(found)


def test_known_intervals_move_each_row_once_whatever_the_stamps(spark):
    rows = spark.createDataFrame([member("a", 0, None, 0), member("a", 100, 200, 150, is_member=False), member(None, 0, None, 0)], MEMBERS)
    stamps = [stamp(400), stamp(60), stamp(400)]
    known = membership.known_intervals(rows, stamps, bucket_days=31)
    assert sorted(((r.asof_ts - stamp(0)).days, (r.effective_from - DAY).days, r.effective_to and (r.effective_to - DAY).days) for r in known.collect()) == [(60, 0, None), (400, 0, 100), (400, 200, None)]
    assert _plan(known).count("Exchange hashpartitioning") == 1


def test_contradictory_memberships_are_found(spark):
    rows = spark.createDataFrame([member("a", 0, 400, 0), member("a", 350, None, 0, is_member=False), member("b", 0, 10, 0), member("b", 10, 20, 0, is_member=False), member("c", 5, 5, 0)], MEMBERS)
    assert {(r["check"], r["key"].split("/")[1]) for r in membership.membership_violations(rows).collect()} == {("CONTRADICTORY_MEMBERSHIP", "a"), ("EMPTY_MEMBERSHIP", "c")}
    assert membership.membership_violations(rows.limit(0)).isEmpty()


# -- fundamental releases -------------------------------------------------------------

FILINGS = "security_id string, metric_name string, report_period_end date, metric_value double, available_at timestamp_ntz, filing_version int"


def test_a_late_restatement_never_hides_a_newer_period(spark):
    rows = spark.createDataFrame([("a", "m", day(0), 1.0, stamp(10), 1), ("a", "m", day(90), 2.0, stamp(100), 1), ("a", "m", day(0), 1.5, stamp(150), 2), ("a", "m", day(90), 2.5, stamp(160), 2), ("a", "m", day(200), 9.0, None, 1)], FILINGS)
    asks = spark.createDataFrame([("a", "m", stamp(k)) for k in (5, 10, 99, 100, 155, 170)] + [("z", "m", stamp(5)), ("a", "m", None)], "security_id string, metric_name string, asof_ts timestamp_ntz")
    got = {(r.security_id, r.asof_ts and (r.asof_ts.date() - DAY).days): r.metric_value for r in releases.latest_release(asks, rows).collect()}
    assert got == {("a", 5): None, ("a", 10): 1.0, ("a", 99): 1.0, ("a", 100): 2.0, ("a", 155): 2.0, ("a", 170): 2.5, ("z", 5): None, ("a", None): None}
    kinds = {(r.report_period_end, r.filing_version): r.kind for r in releases.release_history(rows.where("available_at is not null")).collect()}
    assert kinds == {(day(0), 1): "FIRST_FILING", (day(90), 1): "FIRST_FILING", (day(0), 2): "LATE_RESTATEMENT", (day(90), 2): "RESTATEMENT"}


@pytest.mark.parametrize("bucket", ["month", "year"])
def test_latest_release_equals_brute_force(spark, bucket):
    rng = random.Random(3)
    raw = [(rng.choice("ab"), "m", day(90 * rng.randrange(6)), float(k), stamp(90 * 6 + rng.randrange(-300, 300)), k) for k in range(150)]
    asks = [(s, "m", stamp(k)) for s in "ab" for k in range(200, 900, 23)]
    want = {}
    for s, _, t in asks:
        seen = [r for r in raw if r[0] == s and r[4] <= t]
        want[s, t] = max(seen, key=lambda r: (r[2], r[4], r[5]))[3] if seen else None
    got = {(r.security_id, r.asof_ts): r.metric_value for r in releases.latest_release(spark.createDataFrame(asks, "security_id string, metric_name string, asof_ts timestamp_ntz"), spark.createDataFrame(raw, FILINGS), bucket=bucket).collect()}
    assert got == want


# -- late versions ------------------------------------------------------------------


def test_late_versions_equal_a_replay_bar_by_bar(spark, cal40):
    rng = random.Random(9)
    bars = make_bars(spark, [(s, str(day(k)), "10", None if rng.random() < 0.04 else str(9 + rng.random())[:5]) for s in ("000001", "000002") for k in range(40) if rng.random() < 0.97])
    kinds = ("CASH_DIVIDEND", "STOCK_DIVIDEND", "RIGHTS_ISSUE", "SPIN_OFF")
    raw, seen = [], set()
    for _ in range(60):
        s, ex, kind, late = rng.choice(("000001", "000002")), rng.randrange(1, 40), rng.choice(kinds + kinds[:2]), rng.randrange(-3, 14)
        if (s, ex, kind, late) not in seen:
            seen.add((s, ex, kind, late))
            raw.append((s, str(day(ex)), kind, "0.10" if kind != "RIGHTS_ISSUE" else "0", "0.20" if kind != "CASH_DIVIDEND" else "0", "5.00" if rng.random() < 0.7 else None, f"{day(ex + late)} 15:00:00"))
    actions = make_actions(spark, raw)
    line = returns.prepare_timeline(bars, actions, cal40)
    assert line.late is not None
    parts = returns.window_parts(line.rows, 12)
    windows = parts.withColumn("asof_ts", F.explode(F.array(market_close_ts("trade_date"), market_close_ts(F.date_add("trade_date", 5)), market_close_ts(F.date_add("trade_date", 60)))))
    known = ["security_id", "start_no", "end_no", "asof_ts"]
    fast = {tuple(r[c] for c in known): r for r in returns.corrected_windows(windows.select(*known, "_w"), line, "growth").collect()}
    slow = {tuple(r[c] for c in known): r for r in returns.replayed_windows(windows.select(*known), bars, actions, cal40).collect()}
    assert fast.keys() == slow.keys() and len(fast) > 200
    for key, a in fast.items():
        b = slow[key]
        assert (a.status, a.block_reason) == (b.status, b.block_reason), key
        assert a.value == pytest.approx(b.value) if b.value is not None else a.value is None
    assert {r.status for r in slow.values()} == {"OK", "BLOCKED", "NO_DATA"}


def test_a_replay_moves_windows_and_not_their_bars(spark, cal40):
    bars = make_bars(spark, [("000001", str(day(k)), "10", "10") for k in range(40)])
    actions = make_actions(spark, [("000001", str(day(9)), "CASH_DIVIDEND", "1", "0", None, f"{day(20)} 15:00:00"), ("000001", str(day(9)), "CASH_DIVIDEND", "2", "0", None, f"{day(25)} 15:00:00")])
    windows = spark.createDataFrame([("000001", 5, 12, stamp(k)) for k in (19, 20, 25)] + [("000001", 45, 50, stamp(50)), ("000009", 1, 5, stamp(50))], "security_id string, start_no int, end_no int, asof_ts timestamp_ntz")
    replayed = returns.replayed_windows(windows, bars, actions, cal40)
    assert "Generate" not in _plan(replayed)
    assert {(r.asof_ts.date() - DAY).days: round(r.value, 9) for r in replayed.collect()} == {19: 1.0, 20: round(10 / 9, 9), 25: 1.25}


# -- incremental build -----------------------------------------------------------------


def listing(path):
    return sorted((os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(path) for f in names)


def test_appends_end_in_the_bits_of_a_full_build(spark, cal40, tmp_path):
    rng = random.Random(2)
    rows = [(s, str(day(k)), "10", str(9 + rng.random())[:5]) for s in ("000001", "600002", "300003") for k in range(40)]
    bars = make_bars(spark, rows).select("security_id", "trade_date", "close")
    actions = make_actions(spark, [("000001", str(day(20)), "CASH_DIVIDEND", "0.10", "0", None, "2026-01-02 15:00:00"), ("600002", str(day(5)), "STOCK_DIVIDEND", "0", "0.30", None, "2026-01-02 15:00:00")])
    asof = "2030-01-01 15:00:00"

    def grow(store, part):
        return incremental.extend_growth(spark, store, actions, cal40, asof, incremental.append_bars(spark, store, part))

    whole, parts = incremental.Store(f"{tmp_path}/whole", 2), incremental.Store(f"{tmp_path}/parts", 2)
    grow(whole, bars)
    wrong = bars.withColumn("close", F.when(F.col("trade_date") == F.lit(day(7)), F.col("close") + 1).otherwise(F.col("close")).cast("decimal(18,6)"))
    grow(parts, wrong.where(F.col("trade_date") <= F.lit(day(11))))
    grow(parts, bars.where((F.col("trade_date") > F.lit(day(11))) & (F.col("security_id") != "300003")))
    grow(parts, bars.where((F.col("trade_date") > F.lit(day(11))) & (F.col("security_id") == "300003")))
    grow(parts, bars.where(F.col("trade_date") == F.lit(day(7))))
    for name in (incremental.BARS, incremental.GROWTH):
        assert sorted(map(tuple, incremental.digests(spark, parts, name).select("year", "bucket", "rows", "fingerprint").collect())) == sorted(map(tuple, incremental.digests(spark, whole, name).select("year", "bucket", "rows", "fingerprint").collect()))
    before = listing(parts.path)
    assert incremental.append_bars(spark, parts, bars.where(F.col("trade_date") == F.lit(day(7)))).isEmpty()
    assert grow(parts, bars.where(F.col("trade_date") > F.lit(day(30)))).isEmpty()
    assert listing(parts.path) == before
    with pytest.raises(ContractViolation):
        incremental.append_bars(spark, parts, bars.limit(1).unionByName(bars.limit(1)))
    later = make_actions(spark, [("000001", str(day(20)), "CASH_DIVIDEND", "0.20", "0", None, "2026-01-02 15:00:00")])
    assert [tuple(r) for r in incremental.changed_by_actions(actions, later.unionByName(actions.where("security_id = '600002'")), asof).collect()] == [("000001", day(20))]


# -- performance ----------------------------------------------------------------------

NAV = "portfolio_id int, trade_date date, nav decimal(18,2)"


def test_drawdowns_of_equal_peaks_open_ends_and_single_rows(spark):
    series = {1: [100, 120, 110, 120, 90, 120, 130], 2: [100, 90, 80], 3: [100], 4: [100, 101, 101, 102], 5: [100, 50, 100, 50, 99]}
    nav = spark.createDataFrame([(p, day(7 * k), Decimal(v)) for p, vs in series.items() for k, v in enumerate(vs)], NAV)
    got = {r.portfolio_id: (round(r.max_drawdown, 6), *(None if x is None else (x - DAY).days // 7 for x in (r.drawdown_start, r.drawdown_trough, r.drawdown_recovery))) for r in performance.worst_drawdown(nav).collect()}
    assert got == {1: (-0.25, 3, 4, 5), 2: (-0.2, 0, 2, None), 3: (0.0, None, None, None), 4: (0.0, None, None, None), 5: (-0.5, 0, 1, 2)}
    report = {r.portfolio_id: r for r in performance.performance(nav).collect()}
    assert report[3].annual_return is None and report[3].annual_volatility is None and report[4].calmar is None and report[2].calmar < 0
    assert report[1].total_return == pytest.approx(0.3) and report[1].sessions == 7 and report[1].up_sessions == 4
    paths = {(r.portfolio_id, (r.trade_date - DAY).days // 7): (float(r.peak), (r.peak_date - DAY).days // 7) for r in performance.drawdowns(nav).collect()}
    assert paths[1, 2] == (120.0, 1) and paths[1, 4] == (120.0, 3) and paths[5, 4] == (100.0, 2)


# -- rules, status and universe --------------------------------------------------------


def test_rules_known_late_and_contradictions(spark):
    table = rules.rule_rows(spark)
    asks = spark.createDataFrame([("创业板", "NORMAL", dt.date(2020, 8, 25), dt.datetime(2020, 8, 24, 15)), ("主板", "ST", dt.date(2020, 8, 25), dt.datetime(2020, 8, 24, 15)), ("主板", "ST", dt.date(2026, 7, 6), dt.datetime(2026, 7, 3, 15)), ("没有", "NORMAL", dt.date(2020, 8, 25), dt.datetime(2020, 8, 24, 15)), (None, "NORMAL", dt.date(2020, 8, 25), dt.datetime(2020, 8, 24, 15))], "board string, status_flag string, d date, t timestamp_ntz")
    rate = lambda rows: [r.rule and float(r.rule.daily_rate) for r in rows.orderBy("d", F.col("board").desc_nulls_last()).collect()]
    assert rate(rules.rules_asof(asks, table, "d", "t")) == [None, 0.2, 0.05, None, 0.1]
    late = table.withColumn("available_at", F.when((F.col("board") == "创业板") & (F.col("effective_from") > F.lit(dt.date(2020, 1, 1))), F.lit(dt.datetime(2021, 1, 1)).cast("timestamp_ntz")).otherwise(F.col("available_at")))
    assert rate(rules.rules_asof(asks, late, "d", "t")) == [None, 0.1, 0.05, None, 0.1]
    assert rules.rule_violations(table).isEmpty()
    twice = table.limit(1).withColumn("daily_rate", F.lit("0.3").cast("decimal(6,4)")).withColumn("rule_id", F.lit("x"))
    assert [r["check"] for r in rules.rule_violations(table.unionByName(twice)).collect()] == ["CONTRADICTORY_RULES"]


def test_status_counts_from_when_it_is_known_and_in_force(spark, cal40):
    events = spark.createDataFrame([("a", day(10), "ST", stamp(5)), ("a", day(20), "NONE", stamp(25)), ("b", day(3), "*ST", stamp(30)), ("c", day(9), "NONE", stamp(1)), ("d", dt.date(2025, 1, 1), "ST", stamp(2))], "security_id string, effective_date date, flag string, available_at timestamp_ntz")
    got = {}
    for r in rules.status_by_session(events, cal40).where("status_flag = 'ST'").collect():
        got.setdefault(r.security_id, []).append((r.decision_date - DAY).days)
    assert {k: (min(v), max(v), len(v)) for k, v in got.items()} == {"a": (9, 24, 16), "b": (30, 39, 10), "d": (2, 39, 38)}


def test_universe_gives_the_first_broken_rule(spark, cal40):
    rows = [(s, str(day(k)), "10", "10" if s != "000006" or k % 2 else None) for s in ("000001", "000002", "000003", "000004", "000005", "000006", "000007") for k in range(40)]
    bars = make_bars(spark, rows).withColumn("amount", F.when(F.col("security_id") == "000005", 1).when(F.col("close").isNotNull(), 1000).cast("decimal(24,4)"))
    bars = bars.withColumn("trade_status", F.when(F.col("security_id") == "000007", "停牌").otherwise("正常"))
    listed = [("000001", "主板", 0), ("000002", "科创板", 0), ("000003", "主板", 35), ("000004", "主板", 0), ("000005", "主板", 0), ("000006", "主板", 0), ("000007", "主板", 0)]
    master = spark.createDataFrame([(s, b, day(k), stamp(k)) for s, b, k in listed], "security_id string, board string, list_date date, available_at timestamp_ntz")
    states = rules.status_by_session(spark.createDataFrame([("000004", day(2), "ST", stamp(1))], "security_id string, effective_date date, flag string, available_at timestamp_ntz"), cal40)
    plan = universe.UniverseRules(min_listed_sessions=10, sessions=5, min_amount=Decimal("500"), min_price=Decimal("1"), max_missing=Decimal("0.3"))
    judged = universe.eligibility(bars, master, states, cal40, plan)
    last = {r.security_id: r.reason for r in judged.where(F.col("trade_date") == F.lit(day(39))).collect()}
    assert last == {"000001": None, "000002": "BOARD_EXCLUDED", "000003": "LISTED_TOO_SHORT", "000004": "UNDER_WARNING", "000005": "AMOUNT_TOO_LOW", "000006": "TOO_MANY_GAPS", "000007": "NOT_TRADING"}
    early = {r.security_id: r.reason for r in judged.where(F.col("trade_date") == F.lit(day(8))).collect()}
    assert early["000001"] == "LISTED_TOO_SHORT" and early["000003"] == "NOT_IN_MASTER"
    assert [(r.security_id, (r.trade_date - DAY).days, r.entered) for r in universe.universe_changes(judged).orderBy("security_id", "trade_date").collect()][:1] == [("000001", 9, True)]
    expensive = universe.eligibility(bars, master, states, cal40, universe.UniverseRules(min_listed_sessions=10, min_price=Decimal("11")))
    assert expensive.where("security_id = '000001' and trade_date = date'2026-01-25'").first().reason == "PRICE_TOO_LOW"


def test_staging_needs_a_folder_that_all_nodes_reach():
    from tidemark.staging import fallback_folder

    assert fallback_folder("file:/home/warehouse/", "file", "local[4]") == "file:/home/warehouse/_staged"
    assert fallback_folder("/warehouse", "hdfs", "yarn") == "/warehouse/_staged"
    with pytest.raises(ValueError):
        fallback_folder("/home/warehouse", "file", "yarn")


# -- orders ----------------------------------------------------------------------------


def trading_inputs(spark, cal):
    rng = random.Random(5)
    bars = make_bars(spark, [(s, str(day(k)), str(10 + rng.random())[:5], "10") for s in ("000001", "000002") for k in range(40)]).withColumn("amount", F.lit(2_000_000).cast("decimal(24,4)"))
    master = spark.createDataFrame([(s, "主板", dt.date(2010, 1, 4), dt.datetime(2010, 1, 4, 15)) for s in ("000001", "000002")], "security_id string, board string, list_date date, available_at timestamp_ntz")
    actions = make_actions(spark, [("000001", str(day(8)), "RIGHTS_ISSUE", "0", "0.30", None, "2026-01-02 15:00:00"), ("000002", str(day(8)), "CASH_DIVIDEND", "1.00", "0", None, "2026-01-02 15:00:00")])
    intents = spark.createDataFrame([(p, day(k), s, "buy", 100 * (1 + rng.randrange(60)), i) for p in (1, 2) for k in range(3, 38) for i, s in enumerate(("000001", "000002"))], "portfolio_id int, decision_date date, security_id string, side string, quantity bigint, intent_seq int")
    cash = intents.select("portfolio_id", "decision_date").distinct().withColumn("available_cash", F.lit("40000.00").cast("decimal(18,2)"))
    return bars, actions, master, intents, cash


def test_unpriced_rights_issues_reject_their_orders(spark, cal40):
    bars, actions, master, intents, _ = trading_inputs(spark, cal40)
    locked = orders.lock_orders(intents, bars, actions, master, cal40)
    bad = locked.where("reject_reason = 'CA_INPUT_VIOLATION'").collect()
    assert {(r.security_id, r.decision_date, r.locked_quantity, r.limit_check) for r in bad} == {("000001", day(7), 0, "NOT_EVALUATED")} and len(bad) == 2
    assert [r["check"] for r in orders.reference_violations(locked).collect()] == ["LIMIT_REFERENCE_INPUT"] * 2
    adjusted = locked.where("security_id = '000002' and decision_date = date'2026-01-08'").first()
    assert float(adjusted.reference_price) == 9.0


def test_scenarios_together_equal_each_alone(spark, cal40):
    bars, actions, master, intents, cash = trading_inputs(spark, cal40)
    several = (Scenario("plain"), Scenario("dear", commission_rate=Decimal("0.01"), slippage=Decimal("0.01")), Scenario("thin", opening_fraction=Decimal("0.0004")), Scenario("late", delay=3))
    columns = ["portfolio_id", "decision_date", "security_id", "side", "status", "reason", "filled_quantity", "execution_price", "gross_amount", "total_fee", "net_amount"]
    together = run_scenarios(intents, bars, actions, master, cal40, cash, several).collect()
    assert {r.scenario_id for r in together} == {s.name for s in several}
    plain = orders.fill_orders(orders.admit_by_cash(orders.lock_orders(intents, bars, actions, master, cal40), cash), bars).select(*columns).collect()
    row = lambda r: tuple(str(r[c]) for c in columns)
    assert sorted(row(r) for r in together if r.scenario_id == "plain") == sorted(map(row, plain))
    dear = orders.ExecutionRules(fees=FeeSchedule(commission_rate=Decimal("0.01")))
    alone = orders.fill_orders(orders.admit_by_cash(orders.lock_orders(intents, bars, actions, master, cal40, dear), cash), bars, dear.fees, slippage=F.lit("0.01").cast("decimal(8,6)")).select(*columns).collect()
    assert sorted(row(r) for r in together if r.scenario_id == "dear") == sorted(map(row, alone))
    assert {r.reason for r in together if r.scenario_id == "thin"} >= {"CAPACITY_REJECTED"} and min(r.decision_date for r in together if r.scenario_id == "late") == day(6)
    with pytest.raises(ContractViolation):
        Scenario("a|b")
    with pytest.raises(ContractViolation):
        run_scenarios(intents, bars, actions, master, cal40, cash, (Scenario("x"), Scenario("x")))


# -- notices --------------------------------------------------------------------------------


def test_page_borders_move_the_cuts_and_not_the_pages(spark):
    first, second = "x" * 400 + "特此公告。某某股份有限公司董事会", "2 2024年5月6日" + "y" * 400
    pages = spark.createDataFrame([(1, 1, first), (1, 2, second), (1, 4, "z"), (2, 1, None), (2, 2, "12  a"), (None, 1, "b"), (None, 2, "c")], "doc_id long, page_no int, text string")
    borders = evidence.page_borders(pages)
    want = [(1, 2, first[-evidence.BOUNDARY :] + " " + second[2:][: evidence.BOUNDARY]), (2, 2, None)]
    assert sorted(tuple(r) for r in borders.collect()) == want
    join = borders._jdf.queryExecution().optimizedPlan().child()
    assert [side.output().mkString(" ").count("text#") for side in (join.left(), join.right())] == [0, 0]


def test_states_are_merged_and_not_sent_through_the_driver(spark):
    keys = spark.createDataFrame([("000001", day(1)), ("000002", day(1))], "security_id string, decision_date date")
    states = stage(spark.createDataFrame([("000001", day(1), "ST")], "security_id string, decision_date date, status_flag string"), "states")
    flagged = rules.with_status(keys, states)
    assert {tuple(r) for r in flagged.collect()} == {("000001", day(1), "ST"), ("000002", day(1), "NORMAL")}
    assert "Broadcast" not in _plan(flagged)
