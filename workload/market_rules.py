"""Market rules as rows, risk-warning limits, universe eligibility, scenarios, and whole portfolio and study runs."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import market_close_ts
from tidemark.operators import orders as ords
from tidemark.operators import rules, universe
from tidemark.operators.calendar import next_session
from tidemark.plans.portfolio import run_portfolios
from tidemark.plans.scenarios import Scenario, run_scenarios, scenario_summary
from tidemark.plans.study import run_study
from workload import research, trading
from workload.cases import CASES, case

# -- rules as rows -----------------------------------------------------------------

LATE = "2020-12-31 15:00:00"


@case("d7_limits_from_rule_rows", CASES["e4_price_limits"].columns, CASES["e4_price_limits"].sql, CASES["e4_price_limits"].views, CASES["e4_price_limits"].steps)
def _(t):
    """The limits of E4 with the rules read from a table."""
    return ords.with_decision_terms(trading._intents(t), ords.price_limits(trading._terms(t), t.master, t.cal, rules.rule_rows(t.spark)))


def _late_rule_steps():
    """A growth-board rule of 20 % from 2020-08-24 that becomes known only on 2020-12-31."""
    late = trading.LIMITED.replace("when board = '创业板' and next_session >= date '2020-08-24' then 0.20", f"when board = '创业板' and next_session >= date '2020-08-24' and decision_date + interval 15 hours >= timestamp '{LATE}' then 0.20")
    late = late.replace("when board = '创业板' and next_session >= date '2020-08-24' then 'F5'", f"when board = '创业板' and next_session >= date '2020-08-24' and decision_date + interval 15 hours >= timestamp '{LATE}' then 'F5'")
    return tuple((n, late if n == "limited" else b) for n, b in CASES["e4_price_limits"].steps)


@case("d7_late_rule", CASES["e4_price_limits"].columns, CASES["e4_price_limits"].sql, CASES["e4_price_limits"].views, _late_rule_steps())
def _(t):
    """A rule announced after it took effect is not used before it was known: the older rule stays in force."""
    table = rules.rule_rows(t.spark)
    late = (F.col("board") == "创业板") & (F.col("effective_from") == F.lit("2020-08-24").cast("date"))
    known = F.when(late, F.lit(LATE).cast("timestamp_ntz")).otherwise(F.col("available_at"))
    return ords.with_decision_terms(trading._intents(t), ords.price_limits(trading._terms(t), t.master, t.cal, table.withColumn("available_at", known)))


# Status events from orders: a security is put under warning or freed, known up to ten days before or after.

EVENTS = f"""
select * from (select security_id, effective_from as effective_date, case when cast(revision_id as bigint) % 2 = 0 then case when cast(revision_id as bigint) % 4 = 0 then 'ST' else '*ST' end else 'NONE' end as flag,
  effective_from + to_days(cast(cast(revision_id as bigint) % 21 - 10 as integer)) + interval 15 hours as available_at from membership where index_id = 'IDX1' and cast(revision_id as bigint) % 9 < 2) e"""
STATES = """
select g.security_id, g.trade_date as decision_date, coalesce((select case when arg_max(e.flag, {'d': e.effective_date, 'a': e.available_at, 'f': e.flag}) in ('ST', '*ST') then 'ST' else 'NORMAL' end from events0 e
  where e.security_id = g.security_id and e.available_at <= g.trade_date + interval 15 hours and e.effective_date <= coalesce(g.next_date, date '9999-01-01')
  and (g.next_date is not null or e.effective_date <= date '9999-01-01')), 'NORMAL') as status_flag
from (select x.security_id, c.trade_date, lead(c.trade_date) over (partition by x.security_id order by c.trade_date) as next_date from (select distinct security_id from events0) x cross join cal c) g"""
STATE_STEPS = (("events0", EVENTS), ("states", STATES))


def _events(t):
    n = F.col("revision_id").cast("bigint")
    flag = F.when(n % 4 == 0, "ST").when(n % 2 == 0, "*ST").otherwise("NONE")
    rows = t.membership.where((F.col("index_id") == "IDX1") & (n % 9 < 2))
    return rows.select("security_id", F.col("effective_from").alias("effective_date"), flag.alias("flag"), market_close_ts(F.date_add("effective_from", (n % 21 - 10).cast("int"))).alias("available_at"))


def _states(t):
    return t.landed("status_by_session", lambda: rules.status_by_session(_events(t), t.cal))


@case("d8_status_by_session", "security_id:s decision_date:d status_flag:s", "select * from states", ("membership", "cal"), STATE_STEPS)
def _(t):
    return rules.status_by_session(_events(t), t.cal)


def _flagged_steps():
    steps = []
    for name, body in CASES["e4_price_limits"].steps:
        if name == "limited":
            body = body.replace("left join master m on", "left join states st on st.security_id = q.security_id and st.decision_date = q.decision_date left join master m on")
            body = body.replace("case when board = '主板' and next_session >= date '2015-01-01' then 0.10", "case when board = '主板' and coalesce(st.status_flag, 'NORMAL') = 'ST' and next_session >= date '2026-07-06' then 0.10 when board = '主板' and coalesce(st.status_flag, 'NORMAL') = 'ST' then 0.05 when board = '主板' and next_session >= date '2015-01-01' then 0.10")
            body = body.replace("select q.*, m.board", "select q.*, coalesce(st.status_flag, 'NORMAL') as status_flag, m.board")
        steps.append((name, body))
    return (*STATE_STEPS, *steps)


@case(
    "d8_flagged_limits",
    "portfolio_id:i security_id:s decision_date:d side:s status_flag:s limit_check:s price_cap:f2 price_floor:f2",
    """select portfolio_id, security_id, decision_date, side, status_flag, limit_check0 as limit_check, case when limit_check0 = 'APPLIED' then up end as price_cap, case when limit_check0 = 'APPLIED' then down end as price_floor from limited""",
    (*CASES["e4_price_limits"].views, "membership"),
    _flagged_steps(),
)
def _(t):
    """Limits of securities under warning as known at the decision's close; new-listing exemptions come first."""
    flagged = rules.with_status(trading._terms(t), _states(t))
    return ords.with_decision_terms(trading._intents(t), ords.price_limits(flagged, t.master, t.cal, rules.rule_rows(t.spark)))


@case(
    "d7_rule_violations",
    "check:s key:s detail:s",
    """
with r as (select 'R' || cast(n as varchar) as rule_id, case when n % 10 = 1 then null else security_id end as board, 'NORMAL' as status_flag, ex_date as effective_from, case when n % 7 = 0 then ex_date when n % 7 = 1 then cast(ex_date + to_days(30) as date) end as effective_to,
    cast(case when n % 6 = 0 then 0 else 0.1 + 0.1 * (mk % 2) end as decimal(6,4)) as daily_rate, date_trunc('month', ex_date) + interval 15 hours as available_at from actions_src),
m as (select * replace (cast(date_trunc('month', effective_from) as date) as effective_from) from r where effective_to is null)
select 'RULE_FIELD_MISSING' as "check", concat_ws('/', board, status_flag, effective_from, rule_id) as "key", '' as detail from r where board is null
union all select 'RATE_NOT_POSITIVE', concat_ws('/', board, status_flag, effective_from, rule_id), cast(daily_rate as varchar) from r where daily_rate <= 0
union all select 'EMPTY_RULE', concat_ws('/', board, status_flag, effective_from, rule_id), cast(effective_to as varchar) from r where effective_to <= effective_from
union all select 'CONTRADICTORY_RULES', concat_ws('/', board, status_flag, effective_from, available_at), cast(count(*) as varchar) from r group by board, status_flag, effective_from, available_at having count(distinct coalesce(cast(effective_to as varchar), '') || cast(daily_rate as varchar)) > 1
""",
    ("actions_src",),
)
def _(t):
    src = t.source("actions_src")
    n, mk = F.col("n"), F.col("mk")
    table = src.select(
        F.concat(F.lit("R"), n.cast("string")).alias("rule_id"),
        F.when(n % 10 != 1, F.col("security_id")).alias("board"),
        F.lit("NORMAL").alias("status_flag"),
        F.col("ex_date").alias("effective_from"),
        F.when(n % 7 == 0, F.col("ex_date")).when(n % 7 == 1, F.date_add("ex_date", 30)).alias("effective_to"),
        market_close_ts(F.trunc("ex_date", "MM")).alias("available_at"),
        F.when(n % 6 == 0, 0).otherwise(F.lit("0.1").cast("decimal(6,4)") + F.lit("0.1").cast("decimal(6,4)") * (mk % 2)).cast("decimal(6,4)").alias("daily_rate"),
        F.lit("DAILY_LIMIT_FROM_LISTING").alias("new_listing_policy"),
        F.lit(None).cast("decimal(6,4)").alias("first_up"),
        F.lit(None).cast("decimal(6,4)").alias("first_down"),
    )
    return rules.rule_violations(table)


# -- universe eligibility ------------------------------------------------------------

UNIVERSE = universe.UniverseRules(boards=("主板", "创业板", "科创板"), min_listed_sessions=26, sessions=20, min_amount=Decimal("60000"), min_price=Decimal("10.2"), max_missing=Decimal("0.04"))
ELIGIBLE = """
select x.*, case when board is null then 'NOT_IN_MASTER' when board = '北交所' then 'BOARD_EXCLUDED' when coalesce(listed_sessions, 0) < 26 then 'LISTED_TOO_SHORT' when status_flag = 'ST' then 'UNDER_WARNING' when trade_status <> '正常' then 'NOT_TRADING'
  when close is null then 'NO_PRICE' when close < 10.2 then 'PRICE_TOO_LOW' when mean_amount is null or mean_amount < 60000 then 'AMOUNT_TOO_LOW' when missing_share > 0.04 then 'TOO_MANY_GAPS' end as reason
from (select b.security_id, b.trade_date, b.close, b.trade_status, m.board, coalesce(st.status_flag, 'NORMAL') as status_flag,
    case when b.trade_date >= m.list_date and m.list_date >= (select min(trade_date) from cal) then (select count(*) from cal c where c.trade_date between m.list_date and b.trade_date) end as listed_sessions,
    case when n > 0 then cast(s as double) / n end as mean_amount, 1.0 - closes / least(20, b.session_idx + 1) as missing_share
  from (select *, sum(case when amount >= 0 then amount end) over w as s, count(case when amount >= 0 then 1 end) over w as n, count(close) over w as closes from bars window w as (partition by security_id order by session_idx range between 19 preceding and current row)) b
  left join master m on m.security_id = b.security_id and m.available_at <= b.trade_date + interval 15 hours left join states st on st.security_id = b.security_id and st.decision_date = b.trade_date) x"""
ELIGIBLE_VIEWS = ("bars", "cal", "bars_src", "master", "membership")


def _judged(t):
    return universe.eligibility(t.bars, t.master, _states(t), t.cal, UNIVERSE)


@case("d9_eligibility", "security_id:s trade_date:d eligible:b reason:s listed_sessions:i status_flag:s mean_amount:f4 missing_share:f6", "select *, reason is null as eligible from judged", ELIGIBLE_VIEWS, (*STATE_STEPS, ("judged", ELIGIBLE)))
def _(t):
    return _judged(t)


@case(
    "d9_universe_changes",
    "security_id:s trade_date:d entered:b reason:s",
    "select security_id, trade_date, reason is null as entered, reason from (select *, lag(reason is null, 1, false) over (partition by security_id order by trade_date) as was from judged) x where (reason is null) <> was",
    ELIGIBLE_VIEWS,
    (*STATE_STEPS, ("judged", ELIGIBLE)),
)
def _(t):
    return universe.universe_changes(_judged(t))


# -- scenarios ---------------------------------------------------------------------


def _named(steps, prefix: str, replacements: dict[str, str]):
    """Oracle steps under other names, with parameters replaced."""
    names = [n for n, _ in steps]
    out = []
    for name, body in steps:
        for old, new in replacements.items():
            body = body.replace(old, new)
        for n in names:
            body = re.sub(rf"(?<![\w.'])({n})(?![\w'(])", f"{prefix}{n}", body)
        out.append((f"{prefix}{name}", body))
    return tuple(out)


SCENARIOS = (
    Scenario("base"),
    Scenario("dear", commission_rate=Decimal("0.0025"), opening_fraction=Decimal("0.01")),
    Scenario("slipping", slippage=Decimal("0.004")),
    Scenario("late", delay=2, slippage=Decimal("0.001")),
)


def _scenario_steps(s: Scenario, prefix: str):
    swap = {"* 0.05, 2)": f"* {s.opening_fraction}, 2)", "* 0.00025": f"* {s.commission_rate}"}
    if s.slippage:
        swap["round(open_price * locked_quantity, 2)"] = f"round(cast(round(open_price * (1 + case when side = 'buy' then {s.slippage} else -{s.slippage} end), 6) as decimal(14,6)) * locked_quantity, 2)"
    delayed = (f"{prefix}intents", f"select i.portfolio_id, i.security_id, d.trade_date as decision_date, i.side, i.quantity from intents_src i join cal c on c.trade_date = i.decision_date join cal d on d.session_idx = c.session_idx + {s.delay}")
    return (delayed, *_named(trading.FILL_STEPS, prefix, {"from intents_src i": f"from {prefix}intents i", **swap}))


SCENARIO_STEPS = tuple(step for k, s in enumerate(SCENARIOS) for step in _scenario_steps(s, f"s{k}_"))
EVERY = " union all ".join(f"select '{s.name}' as scenario_id, portfolio_id, security_id, decision_date, side, status, reason, case when status = 'FILLED' then locked_quantity else 0 end as filled_quantity, gross as gross_amount, fee as total_fee from s{k}_outcome" for k, s in enumerate(SCENARIOS))


def _scenarios(t):
    return t.landed("scenario_outcomes", lambda: run_scenarios(trading._intents(t), t.bars, t.actions, t.master, t.cal, trading._cash(t), SCENARIOS))


@case("d10_scenario_outcomes", "scenario_id:s portfolio_id:i security_id:s decision_date:d side:s status:s reason:s filled_quantity:i gross_amount:f2 total_fee:f2", EVERY, trading.BASE, SCENARIO_STEPS)
def _(t):
    return _scenarios(t)


@case(
    "d10_scenario_summary",
    "scenario_id:s orders:i filled:i cash_insufficient:i capacity_rejected:i limit_rejected:i filled_quantity:i gross_amount:f2 total_fee:f2",
    f"""select scenario_id, count(*) as orders, count(*) filter (status = 'FILLED') as filled, count(*) filter (reason = 'CASH_INSUFFICIENT') as cash_insufficient, count(*) filter (reason in ('CAPACITY_NO_ADV_DATA', 'CAPACITY_REJECTED')) as capacity_rejected,
  count(*) filter (reason in ('LIMIT_UP_NO_BUY', 'LIMIT_DOWN_NO_SELL')) as limit_rejected, sum(filled_quantity) as filled_quantity, sum(gross_amount) as gross_amount, sum(total_fee) as total_fee from ({EVERY}) e group by 1""",
    trading.BASE,
    SCENARIO_STEPS,
)
def _(t):
    return scenario_summary(_scenarios(t))


# -- whole runs --------------------------------------------------------------------

# Buys as given; four sessions after a fill half of it, in whole lots, is sold, so that no sell lacks inventory.
BUYS = "select * from intents_src where side = 'buy'"
ROUND_TRIPS = """
select portfolio_id, security_id, decision_date, side, quantity from a_buys
union all select o.portfolio_id, o.security_id, d.trade_date, 'sell', sum(o.locked_quantity // 200 * 100) from a_outcome o join cal c on c.trade_date = o.next_session join cal d on d.session_idx = c.session_idx + 4
where o.status = 'FILLED' and o.locked_quantity >= 200 group by 1, 2, 3"""
ROUND_STEPS = (
    ("a_buys", BUYS),
    *_named(trading.FILL_STEPS, "a_", {"from intents_src i": "from a_buys i"}),
    ("trips", ROUND_TRIPS),
    *[(n, b.replace("from intents_src i", "from trips i").replace("(2000000 +", "(100000000000 +")) for n, b in trading.CHAIN_STEPS],
    ("navq", trading.NAV_SQL.replace("10000000000", "100000000000")),
)


def _round_trips(t):
    order = Window.partitionBy("portfolio_id", "decision_date").orderBy(F.col("side").desc(), "security_id")
    buys = t.intents.where("side = 'buy'")
    numbered = t.landed("trip_buys", lambda: buys.withColumn("intent_seq", F.row_number().over(order)))
    locked = t.landed("trip_locked", lambda: ords.lock_orders(numbered, t.bars, t.actions, t.master, t.cal, execution=True))
    filled = ords.fill_orders(ords.admit_by_cash(locked, trading._cash(t)), t.bars).where("status = 'FILLED' and filled_quantity >= 200")
    later = next_session(filled.select("portfolio_id", "security_id", "filled_quantity", F.col("execution_date").alias("filled_on")), t.cal, "filled_on", 4, "decision_date").where("decision_date is not null")
    lots = F.floor(F.col("filled_quantity") / 200).cast("bigint") * 100
    sells = later.groupBy("portfolio_id", "security_id", "decision_date").agg(F.sum(lots).alias("quantity")).withColumn("side", F.lit("sell"))
    both = buys.unionByName(sells.select(*buys.columns))
    return t.landed("trips", lambda: both.withColumn("intent_seq", F.row_number().over(order)))


def _run(t):
    def build():
        intents = _round_trips(t)
        days = intents.select("portfolio_id", "decision_date").distinct()
        cash = days.withColumn("available_cash", (20000 + F.col("portfolio_id") % 7 * 3000).cast("decimal(18,2)"))
        opening = days.select("portfolio_id").distinct().withColumn("cash", F.lit("1000000000.00").cast("decimal(18,2)"))
        return run_portfolios(intents, t.bars, t.actions, t.master, t.cal, cash, opening)

    return t.shared("portfolio_run", build)


@case("p1_run_portfolios", CASES["e16_run_summary"].columns, CASES["e16_run_summary"].sql, trading.BASE, ROUND_STEPS)
def _(t):
    """Orders to NAV by the plan that checks itself: keys, inventory, ledger states and the accounting identity."""
    return _run(t).summary


@case("p1_run_nav", CASES["e14_daily_nav"].columns, "select * from navq", trading.BASE, ROUND_STEPS)
def _(t):
    return _run(t).nav


def _study(t):
    return t.shared("study", lambda: run_study(t.bars, t.actions, t.cal, t.ids, research._signal_dates(t), research.EVALUATION, research.LOOKBACK, research.SKIP, research.SPEC))


@case("p2_study_ic", CASES["a16_rank_ic"].columns, CASES["a16_rank_ic"].sql, CASES["a16_rank_ic"].views, CASES["a16_rank_ic"].steps)
def _(t):
    """Signals, labels and Rank-IC by the plan that checks its contracts first."""
    return _study(t).ic


@case("p2_study_quantiles", CASES["a19_quantile_returns"].columns, CASES["a19_quantile_returns"].sql, CASES["a19_quantile_returns"].views, CASES["a19_quantile_returns"].steps)
def _(t):
    return _study(t).quantiles


@case("p2_study_interval", CASES["a21_block_bootstrap_ci"].columns, CASES["a21_block_bootstrap_ci"].sql, CASES["a21_block_bootstrap_ci"].views, CASES["a21_block_bootstrap_ci"].steps)
def _(t):
    return _study(t).interval
