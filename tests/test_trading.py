"""Hand-computed cases for capacity, cash, FIFO, dividends and keyed running values."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_market import WEEK, make_actions, make_bars
from tidemark.operators import ledger as led
from tidemark.operators import orders as ords
from tidemark.operators.asof import asof_join
from tidemark.operators.calendar import SessionCalendar

FILL = "portfolio_id bigint, security_id string, execution_date date, side string, filled_quantity bigint, net_amount decimal(18,2), total_fee decimal(18,2)"


def fills(spark, rows):
    return spark.createDataFrame([(1, "000001", dt.date.fromisoformat(d), s, q, Decimal(n), Decimal("5.00")) for d, s, q, n in rows], FILL)


def test_fifo_partial_cost(spark):
    rows = fills(spark, [("2026-01-05", "buy", 100, "1005.01"), ("2026-01-06", "buy", 100, "1205.01"), ("2026-01-07", "sell", 150, "1790.00")])
    result = led.fifo_match(rows)
    sell = result.sells.first()
    assert (str(sell["consumed_cost"]), str(sell["realized_pnl"])) == ("1607.52", "182.48")
    left = result.remaining.first()
    assert (left["quantity"], str(left["cost"])) == (50, "602.50")
    assert result.violations.isEmpty()


def test_same_day_sale_is_a_violation(spark):
    rows = fills(spark, [("2026-01-05", "buy", 100, "1000.00"), ("2026-01-05", "sell", 100, "1000.00")])
    assert [r["check"] for r in led.fifo_match(rows).violations.collect()] == ["SELL_BEFORE_SELLABLE"]


def test_cash_and_stock_dividend(spark):
    cal = SessionCalendar(spark, WEEK)
    rows = fills(spark, [("2026-01-05", "buy", 1000, "10000.00")])
    actions = make_actions(spark, [("000001", "2026-01-07", "STOCK_DIVIDEND", "0.30", "0.20", None, "2026-01-02 15:00:00")])
    opening = spark.createDataFrame([(1, 20000.0)], "portfolio_id bigint, cash double").withColumn("cash", F.col("cash").cast("decimal(18,2)"))
    entries = led.replay_ledger(rows, actions, cal, opening)
    got = [(r["event_type"], r["quantity_delta"], float(r["cash_delta"]), r["position_quantity_after"], float(r["cash_after"])) for r in entries.orderBy("event_id").collect()]
    assert got == [("BUY_FILL", 1000, -10000.0, 1000, 10000.0), ("CA_DIVIDEND_ACCRUED", 0, 0.0, 1000, 10000.0), ("CA_SHARES_ADJUSTED", 200, 0.0, 1200, 10000.0), ("CA_DIVIDEND_PAID", 0, 300.0, 1200, 10300.0)]
    view = led.position_view(rows, actions, cal, "2026-01-07").first()
    assert (view["total_quantity"], view["sellable_quantity"], float(view["cost_basis"])) == (1200, 1200, 10000.0)
    bars = make_bars(spark, [("000001", str(d), "10", "10") for d in WEEK])
    nav = led.daily_nav(entries, bars, cal, opening, rows)
    assert led.identity_violations(led.accounting_identity(nav, opening)).isEmpty()


def test_holding_without_a_close_is_unmarked(spark):
    cal = SessionCalendar(spark, WEEK)
    rows = fills(spark, [(str(WEEK[0]), "buy", 100, "1000.00")])
    none = make_actions(spark, [("000009", "2026-01-07", "CASH_DIVIDEND", "1.00", "0", None, "2026-01-02 15:00:00")])
    opening = spark.createDataFrame([(1, 5000.0)], "portfolio_id bigint, cash double").withColumn("cash", F.col("cash").cast("decimal(18,2)"))
    bars = make_bars(spark, [("000001", str(d), "10", "10") for d in WEEK]).withColumn("close", F.when(F.col("trade_date") > F.lit(WEEK[0]), F.col("close")))
    nav = led.daily_nav(led.replay_ledger(rows, none, cal, opening), bars, cal, opening, rows)
    got = [(float(r["nav"]), float(r["unrealized_pnl"]), r["unmarked_positions"]) for r in nav.orderBy("trade_date").collect()]
    assert got[:2] == [(4000.0, -1000.0, 1), (5000.0, 0.0, 0)]
    assert [r["check"] for r in led.unmarked_violations(nav).collect()] == ["HELD_WITHOUT_CLOSE"]
    assert led.identity_violations(led.accounting_identity(nav, opening)).isEmpty()


def test_late_same_day_action_is_unprocessed(spark):
    cal = SessionCalendar(spark, WEEK)
    rows = fills(spark, [("2026-01-05", "buy", 1000, "10000.00")])
    actions = make_actions(spark, [("000001", "2026-01-07", "CASH_DIVIDEND", "0.30", "0", None, "2026-01-07 15:00:00")])
    found = led.entitlements(rows, actions, cal).collect()
    assert [(r["kind"], float(r["accrued"])) for r in found] == [("UNPROCESSED", 0.0)]


def test_capacity_caps_to_a_lot(spark):
    sessions = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(21)]
    cal = SessionCalendar(spark, sessions)
    bars = make_bars(spark, [("000001", str(d), "10", "10") for d in sessions]).withColumn("amount", F.lit(20000).cast("decimal(24,4)"))
    master = spark.createDataFrame([("000001", "主板", dt.date(2010, 1, 4), dt.datetime(2010, 1, 4, 15))], "security_id string, board string, list_date date, available_at timestamp_ntz")
    none = make_actions(spark, [("000009", "2026-01-07", "CASH_DIVIDEND", "1.00", "0", None, "2026-01-02 15:00:00")])
    intents = spark.createDataFrame([(1, sessions[19], "000001", "buy", 1000, 1), (1, sessions[4], "000001", "buy", 100, 1)], "portfolio_id bigint, decision_date date, security_id string, side string, quantity bigint, intent_seq int")
    out = {r["decision_date"]: r for r in ords.lock_orders(intents, bars, none, master, cal).collect()}
    full, partial = out[sessions[19]], out[sessions[4]]
    assert (float(full["max_order_notional"]), full["locked_quantity"], full["capacity_reason"], full["adv_window_status"]) == (1000.0, 100, "CAPACITY_CAPPED", "ADV_FULL_WINDOW")
    assert (partial["locked_quantity"], partial["adv_window_status"]) == (100, "ADV_PARTIAL_WINDOW")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cash_admission_equals_a_sequential_walk(spark, seed):
    """One hot day of many orders: rounds plus stream equal the plain loop."""
    rng = random.Random(seed)
    reserves = [rng.choice([0, 7, 50, 120, 400, 900, 1500]) for _ in range(300)]
    date = dt.date(2026, 1, 5)
    locked = spark.createDataFrame(
        [(1, date, f"{i:06d}", "buy", i, "LOCKED", None, 100, float(r)) for i, r in enumerate(reserves)],
        "portfolio_id bigint, decision_date date, security_id string, side string, intent_seq int, lock_status string, reject_reason string, locked_quantity bigint, reserved_cash double",
    ).withColumn("reserved_cash", F.col("reserved_cash").cast("decimal(18,2)"))
    cash = spark.createDataFrame([(1, date, 9000.0)], "portfolio_id bigint, decision_date date, available_cash double")
    left, expected = 9000, {}
    for i, r in enumerate(reserves):
        expected[f"{i:06d}"] = r <= left
        left -= r if r <= left else 0
    for rounds in (0, 1, 2):
        got = {r["security_id"]: r["lock_status"] == "LOCKED" for r in ords.admit_by_cash(locked, cash, rounds=rounds).collect()}
        assert got == expected


def test_asof_join_matches_brute_force(spark):
    rng = random.Random(5)
    base = dt.datetime(2026, 1, 1)
    right = [("a" if rng.random() < 0.8 else "b", base + dt.timedelta(hours=rng.randrange(2000)), i) for i in range(200)]
    left = [("a" if rng.random() < 0.8 else "c", base + dt.timedelta(hours=rng.randrange(2000)), i) for i in range(150)]
    rf = spark.createDataFrame(right, "k string, rts timestamp_ntz, v int")
    lf = spark.createDataFrame(left, "k string, lts timestamp_ntz, n int")
    want = {n: max(((t, v) for k2, t, v in right if k2 == k and t <= ts), default=(None, None))[1] for k, ts, n in left}
    for bucket in ("day", "month", "year"):
        got = {r["n"]: (r["asof"]["v"] if r["asof"] else None) for r in asof_join(lf, rf, ["k"], "lts", "rts", ["v"], bucket=bucket).collect()}
        assert got == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_fold_beside_their_actions(spark):
    """No row per position and action is sorted or moved, and equal positions still fold together."""
    cal = SessionCalendar(spark, WEEK)
    rows = fills(spark, [("2026-01-05", "buy", 1000, "10000.00"), ("2026-01-06", "buy", 100, "1000.00"), ("2026-01-07", "sell", 300, "3000.00")])
    actions = make_actions(spark, [("000001", d, "STOCK_DIVIDEND", "0.10", "0.10", None, "2026-01-02 15:00:00") for d in ("2026-01-06", "2026-01-07")])
    found = led.entitlements(rows, actions, cal)
    got = [(str(r["ex_date"]), r["prior"], r["share_delta"], float(r["accrued"])) for r in found.orderBy("ex_date").collect()]
    assert got == [("2026-01-06", 1000, 100, 100.0), ("2026-01-07", 1200, 120, 120.0)]
    assert "Window" not in _plan(found)
    held = spark.createDataFrame([(1, "000001", 10), (1, "000001", 20), (None, "000001", 30), (1, None, 40)], "portfolio_id bigint, security_id string, total_quantity bigint")
    twice = led.dividend_entitlements(actions, held, cal)
    assert sorted((r["portfolio_id"] or 0, str(r["ex_date"]), r["prior"], r["share_delta"]) for r in twice.collect()) == [
        (0, "2026-01-06", 30, 3), (0, "2026-01-07", 33, 3), (1, "2026-01-06", 10, 1), (1, "2026-01-06", 21, 2), (1, "2026-01-07", 13, 1), (1, "2026-01-07", 24, 2)
    ]


def test_fifo_deals_its_rows_once(spark):
    rows = fills(spark, [("2026-01-05", "buy", 100, "1005.01"), ("2026-01-07", "sell", 50, "600.00")])
    assert _plan(led.fifo_match(rows).matches).count("Exchange hashpartitioning(portfolio_id") == 1


def test_fifo_equals_a_queue(spark):
    from decimal import ROUND_HALF_UP

    rng = random.Random(11)
    rows, lots, expected = [], [], []
    for i in range(40):
        day = dt.date(2026, 1, 1) + dt.timedelta(days=i)
        held = sum(q for q, _ in lots)
        if held and rng.random() < 0.5:
            q = rng.randrange(1, held + 1)
            rows.append((str(day), "sell", q, f"{q * 11}.00"))
            spent, need = Decimal(0), q
            while need:
                lq, lc = lots[0]
                take = min(lq, need)
                part = lc if take == lq else (lc * take / lq).quantize(Decimal("0.01"), ROUND_HALF_UP)
                spent += part
                need -= take
                lots[0:1] = [] if take == lq else [(lq - take, lc - part)]
            expected.append((day, spent))
        else:
            q, cost = rng.randrange(1, 900), Decimal(rng.randrange(100, 900000)) / 100
            rows.append((str(day), "buy", q, str(cost)))
            lots.append((q, cost))
    got = [(r["sell_date"], r["consumed_cost"]) for r in led.fifo_match(fills(spark, rows)).sells.orderBy("sell_date").collect()]
    assert got == expected and len(list(itertools.islice(got, 5))) == 5


def test_market_terms_are_found_once_per_decision(spark):
    """Orders meet the terms of their (security, decision date) in one join, null keys included."""
    cal = SessionCalendar(spark, WEEK)
    bars = make_bars(spark, [("000001", str(d), "10", "10") for d in WEEK]).withColumn("amount", F.lit(10**9).cast("decimal(24,4)"))
    master = spark.createDataFrame([("000001", "主板", dt.date(2010, 1, 4), dt.datetime(2010, 1, 4, 15))], "security_id string, board string, list_date date, available_at timestamp_ntz")
    none = make_actions(spark, [("000009", "2026-01-07", "CASH_DIVIDEND", "1.00", "0", None, "2026-01-02 15:00:00")])
    rows = [(p, WEEK[0], "000001", "buy", 100, 1) for p in range(5)] + [(7, WEEK[0], None, "sell", 100, 1), (8, None, "000001", "buy", 100, 1), (9, WEEK[-1], "000001", "buy", 100, 1)]
    intents = spark.createDataFrame(rows, "portfolio_id bigint, decision_date date, security_id string, side string, quantity bigint, intent_seq int")
    locked = ords.lock_orders(intents, bars, none, master, cal)
    assert locked._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r["portfolio_id"]: (r["lock_status"], r["limit_check"], r["reference_price"]) for r in locked.collect()}
    assert got.pop(7) == ("LOCKED", "SKIPPED_NO_PREV_CLOSE", None)
    assert got.pop(8) == got.pop(9) == ("UNFILLED", "NOT_EVALUATED", None)
    assert len(got) == 5 and {(a, str(c)) for a, _, c in got.values()} == {("LOCKED", "10.00")}


def test_position_folds_are_spread_and_made_once(spark, monkeypatch):
    cal = SessionCalendar(spark, WEEK)
    one = fills(spark, [("2026-01-05", "buy", 1000, "10000.00")])
    rows = one.drop("portfolio_id").crossJoin(spark.range(60).withColumnRenamed("id", "portfolio_id")).select(*one.columns)
    actions = make_actions(spark, [("000001", "2026-01-07", "STOCK_DIVIDEND", "0.30", "0.20", None, "2026-01-02 15:00:00")])
    found = led.entitlements(rows, actions, cal)
    assert {(r["prior"], r["share_delta"], float(r["accrued"])) for r in found.collect()} == {(1000, 200, 300.0)} and found.count() == 60
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged, plain = [], led.stage
    monkeypatch.setattr(led, "stage", lambda df, label: staged.append(label) or plain(df, label))
    opening = spark.createDataFrame([(p, 20000.0) for p in range(60)], "portfolio_id bigint, cash double").withColumn("cash", F.col("cash").cast("decimal(18,2)"))
    assert led.replay_ledger(rows, actions, cal, opening).count() == 60 * 4
    assert staged.count("entitlements") == 1


def test_entitlements_of_many_equal_a_loop(spark):
    """Fills and stock dividends in any order, positions beyond 64 bits of shares times ratio, and no array that grows element by element."""
    rng = random.Random(3)
    cal = SessionCalendar(spark, WEEK)
    days = [str(d) for d in WEEK]
    rows = [(p, s, rng.choice(days), rng.choice(("buy", "sell")), rng.choice((None, 1, 7, 300, 10**13))) for p in range(12) for s in ("000001", "000002", "000003") for _ in range(rng.randrange(1, 6))]
    frame = spark.createDataFrame(rows, "portfolio_id bigint, security_id string, execution_date string, side string, filled_quantity bigint").withColumn("execution_date", F.col("execution_date").cast("date"))
    paid = [(s, d, "STOCK_DIVIDEND", "0.10", rng.choice(("0.10", "0.333333", "7.5")), None, "2026-01-02 15:00:00") for s in ("000001", "000002") for d in days if rng.random() < 0.7]
    found = led.entitlements(frame, make_actions(spark, paid), cal)
    want = set()
    for p, s in {(p, s) for p, s, *_ in rows}:
        bonus = 0
        for _, day, _, _, ratio, _, _ in sorted(a for a in paid if a[0] == s):
            base = sum((q or 0) * (1 if side == "buy" else -1) for a, b, d, side, q in rows if (a, b) == (p, s) and d < day)
            grant = max(0, base + bonus) * int(round(float(ratio) * 10**6)) // 10**6
            if base + bonus > 0:
                want.add((p, s, day, base + bonus, grant))
            bonus += grant
    assert {(r.portfolio_id, r.security_id, str(r.ex_date), r.prior, r.share_delta) for r in found.collect()} == want and len(want) > 20
    assert "lambda" not in _plan(found)


@pytest.mark.parametrize("safe", [2**62, 10**8, 5000])
def test_nav_of_many_positions_equals_a_loop(spark, monkeypatch, safe):
    """Values summed cell by cell, in small blocks, with sums given out early or not held in 64 bits, with gaps in the closes; no position meets a session in a join."""
    rng = random.Random(8)
    cal = SessionCalendar(spark, WEEK)
    ids = [f"{i:06d}" for i in range(7)]
    prices = {(s, d): rng.choice((None, rng.randrange(100, 2000))) for s in ids[:-1] for d in WEEK}
    bars = make_bars(spark, [(s, str(d), "10", None if c is None else str(Decimal(c) / 100)) for (s, d), c in prices.items()])
    moves = [(rng.choice((1, 2, 3, 4, 5)), rng.choice((*ids, None)), rng.choice(WEEK), rng.choice((0, 100, -100, 250)), rng.randrange(-9999, 9999)) for _ in range(150)]
    entries = spark.createDataFrame([(p, s, d, q, Decimal(c) / 100) for p, s, d, q, c in moves], "portfolio_id bigint, security_id string, trade_date date, quantity_delta bigint, cost_basis_delta decimal(18,2)")
    entries = entries.withColumns({n: F.lit(0).cast("decimal(18,2)") for n in ("cash_delta", "receivable_delta", "realized_pnl")}).withColumn("event_type", F.lit("BUY_FILL"))
    opening = spark.createDataFrame([(1,)], "portfolio_id bigint").withColumn("cash", F.lit(0).cast("decimal(18,2)"))
    monkeypatch.setattr(led, "BLOCK_CELLS", 20)
    monkeypatch.setattr(led, "SAFE", safe)
    nav = led.daily_nav(entries, bars, cal, opening)
    got = {(r.portfolio_id, r.trade_date): (r.holdings_market_value, r.unrealized_pnl, r.unmarked_positions) for r in nav.collect()}
    for (p, d), (mv, gain, unmarked) in got.items():
        worth = cost = blank = 0
        for s in (*ids, None):
            mine = [(q, c) for a, b, day, q, c in moves if (a, b) == (p, s) and day <= d]
            held = sum(q for q, _ in mine)
            seen = [prices[s, x] for x in WEEK if x <= d and prices.get((s, x)) is not None]
            worth += held * (seen[-1] if seen else 0)
            cost += sum(c for _, c in mine) if held else 0
            blank += bool(held and not seen)
        assert (mv * 100, (mv - gain) * 100, unmarked) == (worth, cost, blank)
    assert len(got) > 20
    assert not any("Join" in line and "security_id" in line for line in _plan(nav).splitlines())


@pytest.fixture
def tiny_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def test_fifo_of_many_positions_equals_a_queue(spark, tiny_batches):
    """Positions that begin and end anywhere in a batch, oversold ones and costs beyond 64 bits; windows and arrays of lots are gone."""
    rng = random.Random(4)
    rows = [(p, s, day, side, q, Decimal(c) / 100) for p in range(9) for s in ("000001", "000002", None) for day in WEEK for side, c in (("buy", rng.randrange(1, 10**rng.choice((4, 15)))), ("sell", 777)) if rng.random() < 0.8 for q in [rng.randrange(1, 10**rng.choice((2, 6)))]]
    frame = spark.createDataFrame([(*r, Decimal(0)) for r in rows], FILL)
    fifo = led.fifo_match(frame)
    matched, kept, spent, broken = set(), set(), {}, []
    for p, s in {(p, s) for p, s, *_ in rows}:
        mine = [r[2:] for r in rows if r[:2] == (p, s)]
        lots = [[d, q, int(c * 100)] for d, side, q, c in sorted(mine) if side == "buy"]
        for day, q in sorted((d, q) for d, side, q, _ in mine if side == "sell"):
            cost = 0
            while q and lots:
                lot = lots[0]
                n = min(q, lot[1])
                part = lot[2] if n == lot[1] else (2 * lot[2] * n + lot[1]) // (2 * lot[1])
                matched.add((p, s, lot[0], day, n, part))
                broken += [("SELL_BEFORE_SELLABLE", n)] if lot[0] >= day else []
                cost, q = cost + part, q - n
                lot[1], lot[2] = lot[1] - n, lot[2] - part
                if not lot[1]:
                    lots.pop(0)
            broken += [("SELL_EXCEEDS_POSITION", q)] if q else []
            spent[p, s, day] = 0 if s is None else cost  # a null id meets no cost
        kept |= {(p, s, d, q, c) for d, q, c in lots}
    assert {(r.portfolio_id, r.security_id, r.lot_date, r.sell_date, r.quantity, int(r.cost * 100)) for r in fifo.matches.collect()} == matched
    assert {(r.portfolio_id, r.security_id, r.lot_date, r.quantity, int(r.cost * 100)) for r in fifo.remaining.collect()} == kept
    assert {(r.portfolio_id, r.security_id, r.sell_date): int(r.consumed_cost * 100) for r in fifo.sells.collect()} == spent
    assert sorted((r["check"], int(r["detail"])) for r in fifo.violations.collect()) == sorted(broken)
    plan = _plan(fifo.sells)
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_nav_does_not_depend_on_batches(spark, tiny_batches, monkeypatch):
    test_nav_of_many_positions_equals_a_loop(spark, monkeypatch, 2**62)


def test_events_of_a_day_are_numbered_by_security(spark):
    """By phase, then security, then what happened to it; one id may begin another."""
    cal = SessionCalendar(spark, WEEK)
    one = fills(spark, [("2026-01-05", "buy", 100, "1000.00")])
    rows = one.drop("security_id").crossJoin(spark.createDataFrame([("600100",), ("6001000",)], "security_id string")).select(*one.columns)
    actions = make_actions(spark, [(s, "2026-01-07", kind, "0.10", "0.50", None, at) for s in ("600100", "6001000") for kind, at in (("CASH_DIVIDEND", "2026-01-02 15:00:00"), ("SPIN_OFF", "2026-01-02 15:00:00"), ("STOCK_DIVIDEND", "2026-01-07 12:00:00"))])
    opening = spark.createDataFrame([(1,)], "portfolio_id bigint").withColumn("cash", F.lit("9000.00").cast("decimal(18,2)"))
    got = [(r.security_id, r.event_type, r.fill_reason) for r in led.replay_ledger(rows, actions, cal, opening).orderBy("event_id").collect()]
    each = lambda kind, why: [(s, kind, why) for s in ("600100", "6001000")]
    accrued = ("CA_DIVIDEND_ACCRUED", "CASH_DIVIDEND_RECEIVABLE_ACCRUED_TAX_GROSS"), ("CA_SHARES_ADJUSTED", "STOCK_DIVIDEND_SHARES_ADJUSTED"), ("UNSUPPORTED_CORPORATE_EVENT", "UNSUPPORTED_CORPORATE_EVENT:SPIN_OFF")
    assert got == [*each("BUY_FILL", "T1_OPEN_FILLED"), *each("UNPROCESSED_CA", f"UNPROCESSED_CA:{led.LATE_REASON}"), *[(s, *e) for s in ("600100", "6001000") for e in accrued], *each("CA_DIVIDEND_PAID", "CASH_DIVIDEND_PAID_SIMPLIFIED_EX_DATE_PLUS_ONE")]


def test_fills_without_a_day_change_no_position(spark):
    cal = SessionCalendar(spark, WEEK)
    rows = fills(spark, [("2026-01-05", "buy", 100, "1000.00"), ("2026-01-06", "buy", 200, "1000.00")])
    rows = rows.withColumn("execution_date", F.when(F.col("filled_quantity") == 100, F.col("execution_date")))
    none = make_actions(spark, [("000009", "2026-01-07", "CASH_DIVIDEND", "1.00", "0", None, "2026-01-02 15:00:00")])
    opening = spark.createDataFrame([(1,)], "portfolio_id bigint").withColumn("cash", F.lit("9000.00").cast("decimal(18,2)"))
    got = [(r.position_quantity_after, r.event_id, float(r.cash_after)) for r in led.replay_ledger(rows, none, cal, opening).collect()]
    assert got == [(100, 2, 7000.0)]
