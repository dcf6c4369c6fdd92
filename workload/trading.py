"""Order, fill, ledger and NAV queries over every intent and trade."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ledger as led
from tidemark.operators import orders as ords
from tidemark.operators import pit
from workload.cases import case

BASE = ("bars", "actions", "cal", "bars_src", "master", "intents_src")


# -- Spark inputs -------------------------------------------------------------------


def _intents(t):
    order = Window.partitionBy("portfolio_id", "decision_date").orderBy(F.col("side").desc(), "security_id")
    return t.landed("order_intents", lambda: t.intents.withColumn("intent_seq", F.row_number().over(order)))


def _build_locked(t, execution=False):
    return ords.lock_orders(_intents(t), t.bars, t.actions, t.master, t.cal, execution=execution)


def _locked(t):
    return t.landed("locked_orders", lambda: _build_locked(t, True))


def _cash(t):
    days = _intents(t).select("portfolio_id", "decision_date").distinct()
    return days.withColumn("available_cash", (20000 + F.col("portfolio_id") % 7 * 3000).cast("decimal(18,2)"))


def _build_admitted(t):
    return ords.admit_by_cash(_locked(t), _cash(t))


def _admitted(t):
    return t.landed("admitted_orders", lambda: _build_admitted(t))


def _build_fills(t):
    # Admission and fills share a shuffle by day unless the admitted orders themselves were landed.
    return ords.fill_orders(_admitted(t) if t.has("admitted_orders") else _build_admitted(t), t.bars)


def _fills(t):
    return t.landed("fills", lambda: _build_fills(t))


def _trades(t):
    def build():
        charged = ords.fees(t.trades)
        return charged.select("portfolio_id", "security_id", "execution_date", "side", F.col("quantity").alias("filled_quantity"), "price", "net_amount", "total_fee")

    return t.landed("trades", build)


def _opening(t):
    return _trades(t).select("portfolio_id").distinct().withColumn("cash", F.lit("100000000.00").cast("decimal(18,2)"))


def _granted(t):
    return t.landed("entitlements", lambda: led.entitlements(_trades(t), t.actions, t.cal))


def _entries(t):
    return t.landed("ledger_entries", lambda: led.replay_ledger(_trades(t), t.actions, t.cal, _opening(t), granted=_granted(t)))


# -- oracle steps ----------------------------------------------------------------------

ORDERS = """
select i.*, row_number() over (partition by portfolio_id, decision_date order by side desc, security_id) as intent_seq, c.session_idx, n.trade_date as next_session
from intents_src i join cal c on c.trade_date = i.decision_date left join cal n on n.session_idx = c.session_idx + 1"""

STATE = """
select security_id, session_idx, trade_date,
  last_value(close ignore nulls) over (partition by security_id order by session_idx range between 59 preceding and current row) as last_close,
  sum(case when amount >= 0 then amount end) over w as s, count(case when amount >= 0 then amount end) over w as n
from bars window w as (partition by security_id order by session_idx range between 19 preceding and current row)"""

ADV = """
select security_id, session_idx, trade_date, round(last_close, 2) as last_close, n,
  case when n > 0 then cast((2 * cast(s * 10000 as hugeint) + 100 * n) // (200 * n) as decimal(18,2)) / 100 end as adv0 from state"""

ADV2 = "select *, cast(round(adv0, 2) as decimal(18,2)) as adv, cast(round(cast(round(adv0, 2) as decimal(18,2)) * 0.05, 2) as decimal(18,2)) as cap from adv_a"

REFERENCE = """
select d.security_id, d.decision_date, max(case when v.available_at <= d.decision_date + interval 15 hours then 1 else 0 end) as seen, 1 as later
from (select distinct security_id, decision_date, next_session from orders0 where next_session is not null) d
join actions v on v.security_id = d.security_id and v.ex_date = d.next_session and v.available_at <= d.next_session + interval 15 hours group by 1, 2"""

REF_INPUT = """
select security_id, decision_date,
  case when max(case when action_type in ('CASH_DIVIDEND','STOCK_DIVIDEND') and ex_right_cash_deduction_per_share is not null then 1 else 0 end) = 1
    then cast(sum(case when action_type in ('CASH_DIVIDEND','STOCK_DIVIDEND') then coalesce(ex_right_cash_deduction_per_share, cash_dividend_per_share) else 0 end) as decimal(18,6))
    else cast(round(sum(case when action_type in ('CASH_DIVIDEND','STOCK_DIVIDEND') then cash_dividend_per_share else 0 end), 2) as decimal(18,6)) end as cash,
  1 + sum(case when action_type in ('CASH_DIVIDEND','STOCK_DIVIDEND','RIGHTS_ISSUE') then share_ratio else 0 end) as den,
  sum(case when action_type = 'RIGHTS_ISSUE' then share_ratio * coalesce(rights_price_per_share, 0) else 0 end) as paid,
  max(case when action_type = 'RIGHTS_ISSUE' and share_ratio > 0 and rights_price_per_share is null then 1 else 0 end) as bad
from (select d.security_id, d.decision_date, v.action_type, v.cash_dividend_per_share, v.share_ratio, v.rights_price_per_share, v.ex_right_cash_deduction_per_share,
        row_number() over (partition by d.security_id, d.decision_date, v.action_type order by v.available_at desc) as rn
      from (select distinct security_id, decision_date, next_session from orders0 where next_session is not null) d
      join actions v on v.security_id = d.security_id and v.ex_date = d.next_session and v.available_at <= d.decision_date + interval 15 hours) where rn = 1 group by 1, 2"""

REFERENCED = """
select o.*, a.adv, a.cap, a.n as adv_days, a.last_close,
  coalesce(i.bad, 0) = 1 and a.last_close is not null as bad,
  case when a.last_close is null or i.bad = 1 then null when r.seen = 1 then cast((200 * cast((a.last_close - i.cash + i.paid) * 1000000 as hugeint) + cast(i.den * 1000000 as hugeint)) // (2 * cast(i.den * 1000000 as hugeint)) as decimal(18,2)) / 100
    else a.last_close end as ref0, r.seen, r.later
from orders0 o left join adv_b a on a.security_id = o.security_id and a.session_idx = o.session_idx
left join refs r on r.security_id = o.security_id and r.decision_date = o.decision_date
left join refin i on i.security_id = o.security_id and i.decision_date = o.decision_date"""

LIMITED = """
select x.*, case when bad then 'SKIPPED_CA_INPUT' when ref is null then 'SKIPPED_NO_PREV_CLOSE' when board is null then 'SKIPPED_NO_MASTER' when rate is null then 'SKIPPED_NO_RULE'
    when (policy = 'F5' and nth <= 5) or (policy = 'F1' and nth = 1) then 'EXEMPT_NEW_LISTING' else 'APPLIED' end as limit_check0,
  cast(round(ref * (1 + case when policy = 'FA' and nth = 1 then 0.44 else rate end), 2) as decimal(18,2)) as up,
  cast(round(ref * (1 - case when policy = 'FA' and nth = 1 then 0.36 else rate end), 2) as decimal(18,2)) as down
from (select q.*, m.board, case when m.list_date <= q.next_session and m.list_date >= (select min(trade_date) from cal) then (select count(*) from cal c where c.trade_date between m.list_date and q.next_session) end as nth,
    case when board = '主板' and next_session >= date '2015-01-01' then 0.10 when board = '创业板' and next_session >= date '2020-08-24' then 0.20 when board = '创业板' and next_session >= date '2015-01-01' then 0.10
      when board = '科创板' and next_session >= date '2019-07-22' then 0.20 when board = '北交所' and next_session >= date '2021-11-15' then 0.30 end as rate,
    case when board = '主板' and next_session >= date '2023-02-17' then 'F5' when board = '主板' then 'FA' when board = '创业板' and next_session >= date '2020-08-24' then 'F5'
      when board = '科创板' then 'F5' when board = '北交所' then 'F1' else 'D' end as policy
  from (select *, cast(round(ref0, 2) as decimal(18,2)) as ref from referenced) q left join master m on m.security_id = q.security_id and m.available_at <= q.decision_date + interval 15 hours) x"""


def _fee(gross: str, side: str, day: str) -> str:
    return f"""(round(greatest({gross} * 0.00025, 5.00), 2) + round({gross} * case when {day} >= date '2022-04-29' then 0.00001 else 0.00002 end, 2)
      + case when {side} = 'sell' then round({gross} * case when {day} >= date '2023-08-28' then 0.0005 else 0.001 end, 2) else 0 end)"""


LOCKED = f"""
select y.*, case when ok and side = 'buy' and locked_quantity > 0 and price is not null then cast(round(price * locked_quantity, 2) as decimal(18,2)) + {_fee("cast(round(price * locked_quantity, 2) as decimal(18,2))", "'buy'", "next_session")} else 0 end as reserved_cash
from (select z.*, reject_reason is null as ok, case when reject_reason is null then least(lots, coalesce(capped, lots)) else 0 end as locked_quantity,
    coalesce(case when limit_check0 = 'APPLIED' then up end, ref) as price
  from (select v.*, case when next_session is null then 'NO_NEXT_SESSION' when lots is null then 'ODD_LOT_REJECTED' when bad then 'CA_INPUT_VIOLATION' when lots > 0 and ref is not null and cap is null then 'CAPACITY_NO_ADV_DATA' when capped <= 0 then 'CAPACITY_REJECTED' end as reject_reason
    from (select l.*, case when side <> 'buy' then quantity when quantity // 100 > 0 then quantity // 100 * 100 end as lots,
        case when ref is not null and cap is not null and round(ref * (case when side <> 'buy' then quantity else quantity // 100 * 100 end), 2) > cap and (side <> 'buy' or quantity >= 100)
          then cast(cap * 100 as bigint) // cast(ref * 100 as bigint) // 100 * 100 end as capped from limited l) v) z) y"""

LOCK_STEPS = (
    ("orders0", ORDERS),
    ("state", STATE),
    ("adv_a", ADV),
    ("adv_b", ADV2),
    ("refs", REFERENCE),
    ("refin", REF_INPUT),
    ("referenced", REFERENCED),
    ("limited", LIMITED),
    ("locked", LOCKED),
)

ADMIT_STEPS = (
    *LOCK_STEPS,
    ("asking", "select portfolio_id, decision_date, security_id, reserved_cash as r, row_number() over (partition by portfolio_id, decision_date order by intent_seq) as n from locked where ok and side = 'buy' and reserved_cash > 0"),
    (
        "walk",
        """select portfolio_id, decision_date, cast(0 as bigint) as n, '' as security_id, cast(20000 + portfolio_id % 7 * 3000 as decimal(18,2)) as cash, true as accepted from (select distinct portfolio_id, decision_date from asking)
           union all select w.portfolio_id, w.decision_date, a.n, a.security_id, cast(case when a.r <= w.cash then w.cash - a.r else w.cash end as decimal(18,2)), a.r <= w.cash from walk w join asking a on a.portfolio_id = w.portfolio_id and a.decision_date = w.decision_date and a.n = w.n + 1""",
    ),
    (
        "admitted",
        """select l.* exclude (reject_reason, locked_quantity, reserved_cash), case when w.accepted = false then 'CASH_INSUFFICIENT' else l.reject_reason end as reject_reason,
             case when w.accepted = false then 0 else l.locked_quantity end as locked_quantity, case when w.accepted = false then 0 else l.reserved_cash end as reserved_cash,
             case when l.reject_reason = 'NO_NEXT_SESSION' then 'UNFILLED' when l.reject_reason is not null or w.accepted = false then 'REJECTED' else 'LOCKED' end as lock_status
           from locked l left join walk w on w.n > 0 and l.side = 'buy' and w.portfolio_id = l.portfolio_id and w.decision_date = l.decision_date and w.security_id = l.security_id""",
    ),
)

FILL_STEPS = (
    *ADMIT_STEPS,
    (
        "judged",
        """select a.*, b.open as open_price, case when lock_status <> 'LOCKED' then reject_reason when b.security_id is null then 'NO_OPEN_PRICE' when b.trade_status = '停牌' then 'NO_TRADE_SUSPENDED' when b.open is null then 'NO_OPEN_PRICE'
             when limit_check0 = 'APPLIED' and side = 'buy' and b.open >= up then 'LIMIT_UP_NO_BUY' when limit_check0 = 'APPLIED' and side = 'sell' and b.open <= down then 'LIMIT_DOWN_NO_SELL' else 'T1_OPEN_FILLED' end as reason
           from admitted a left join bars b on b.security_id = a.security_id and b.trade_date = a.next_session""",
    ),
    (
        "outcome",
        f"""select *, case when lock_status <> 'LOCKED' then lock_status when reason = 'NO_OPEN_PRICE' then 'UNFILLED' when reason = 'NO_TRADE_SUSPENDED' then 'SUSPENDED' when reason = 'T1_OPEN_FILLED' then 'FILLED' else 'REJECTED' end as status,
             case when reason = 'T1_OPEN_FILLED' then cast(round(open_price * locked_quantity, 2) as decimal(18,2)) else 0 end as gross,
             case when reason = 'T1_OPEN_FILLED' then {_fee("cast(round(open_price * locked_quantity, 2) as decimal(18,2))", "side", "next_session")} else 0 end as fee from judged""",
    ),
)


# -- E1 to E9 ---------------------------------------------------------------------------


@case(
    "e1_lot_quantity",
    "portfolio_id:i security_id:s decision_date:d side:s lot_quantity:f0 lot_reason:s strict_quantity:f0",
    """select portfolio_id, security_id, decision_date, side, case when side <> 'buy' then quantity when quantity // 100 > 0 then quantity // 100 * 100 end as lot_quantity,
       case when side = 'buy' and quantity < 100 then 'ODD_LOT_REJECTED' end as lot_reason, case when side <> 'buy' or quantity % 100 = 0 then quantity end as strict_quantity from intents_src""",
    ("intents_src",),
)
def _(t):
    strict = ords.lot_quantity(t.intents, "REJECT").withColumnRenamed("lot_quantity", "strict_quantity").drop("lot_reason")
    return ords.lot_quantity(strict)


@case(
    "e2_capacity",
    "portfolio_id:i security_id:s decision_date:d side:s trailing_adv_notional:f2 max_order_notional:f2 adv_window_status:s",
    """select portfolio_id, o.security_id, decision_date, side, adv as trailing_adv_notional, cap as max_order_notional, case when n >= 20 then 'ADV_FULL_WINDOW' when n > 0 then 'ADV_PARTIAL_WINDOW' end as adv_window_status
       from orders0 o join adv_b a on a.security_id = o.security_id and a.session_idx = o.session_idx""",
    BASE,
    LOCK_STEPS[:4],
)
def _(t):
    return ords.capacity(_intents(t), t.bars, t.cal)


@case(
    "j3_last_close_asof",
    "portfolio_id:i security_id:s decision_date:d side:s last_close:f2",
    "select portfolio_id, o.security_id, decision_date, side, last_close from orders0 o join adv_b a on a.security_id = o.security_id and a.session_idx = o.session_idx",
    BASE,
    LOCK_STEPS[:4],
)
def _(t):
    return ords.last_close_asof(_intents(t), t.sparse, t.cal)


@case(
    "j4_mark_to_last_close",
    "security_id:s day:d mark:f2 stale_sessions:i",
    """select x.security_id, x.day, x.c.close as mark, x.i - x.c.session_idx as stale_sessions from (
  select p.security_id, p.day, cal.session_idx as i, (select arg_max({'close': round(b.close, 2), 'session_idx': b.session_idx}, b.session_idx) from bars b where b.security_id = p.security_id and b.close is not null and b.trade_date <= p.day) as c
  from (select distinct security_id, decision_date as day from intents_src) p join cal on cal.trade_date = p.day) x where x.c is not null""",
    BASE,
)
def _(t):
    first = t.sparse.groupBy("security_id").agg(F.min("trade_date").alias("_f"))
    wanted = t.intents.select("security_id", F.col("decision_date").alias("day")).distinct().join(first, "security_id").where("day >= _f").drop("_f")
    return led.mark_to_last_close(wanted, t.bars, t.cal, "day")


@case(
    "j10_execution_bar",
    "portfolio_id:i security_id:s decision_date:d side:s open_price:f6 trade_status:s has_bar:b",
    "select o.portfolio_id, o.security_id, o.decision_date, o.side, s.open as open_price, s.trade_status, s.security_id is not null as has_bar from orders0 o left join sparse s on s.security_id = o.security_id and s.trade_date = o.next_session",
    (*BASE, "sparse"),
    LOCK_STEPS[:1],
)
def _(t):
    from tidemark.operators.calendar import next_session

    return ords.execution_bar(next_session(_intents(t), t.cal, "decision_date"), t.sparse)


@case(
    "j11_board_asof",
    "portfolio_id:i security_id:s decision_date:d side:s board:s list_date:d",
    "select i.portfolio_id, i.security_id, i.decision_date, i.side, m.board, m.list_date from intents_src i left join master m on m.security_id = i.security_id and m.available_at <= i.decision_date + interval 15 hours",
    BASE,
)
def _(t):
    return ords.board_asof(t.intents, t.master)


@case(
    "e3_limit_reference",
    "portfolio_id:i security_id:s decision_date:d side:s reference_price:f2 limit_reference_status:s",
    """select portfolio_id, security_id, decision_date, side, ref as reference_price,
       case when last_close is null then 'NONE' when bad then 'LIMIT_REF_INPUT_VIOLATION' when seen = 1 and ref <> last_close then 'LIMIT_REF_ADJUSTED_FOR_CA' when coalesce(seen, 0) = 0 and later = 1 then 'LIMIT_REF_UNADJUSTED_CA_INVISIBLE' else 'NONE' end as limit_reference_status from limited""",
    BASE,
    LOCK_STEPS[:8],
)
def _(t):
    return _reference(t)


@case(
    "e3_reference_violations",
    "check:s key:s detail:s",
    """select 'LIMIT_REFERENCE_INPUT' as "check", concat_ws('/', portfolio_id, decision_date, security_id, side) as "key", 'RIGHTS_ISSUE missing rights_price/rights_price_per_share; cannot construct PIT factor' as detail from limited where bad""",
    BASE,
    LOCK_STEPS[:8],
)
def _(t):
    return ords.reference_violations(_reference(t))


def _terms(t):
    """Reference prices of the distinct (security, decision date) of the intents."""
    from tidemark.operators.calendar import next_session

    def build():
        keys = next_session(ords.decision_keys(t.intents), t.cal, "decision_date")
        state = ords.market_state(t.bars, keys, t.cal).select("security_id", "decision_date", "last_close")
        return ords.limit_reference(keys.join(state, ["security_id", "decision_date"], "left"), t.actions)

    return t.landed("reference_terms", build)


def _reference(t):
    return ords.with_decision_terms(_intents(t), _terms(t))


@case(
    "e4_price_limits",
    "portfolio_id:i security_id:s decision_date:d side:s limit_check:s price_cap:f2 price_floor:f2",
    """select portfolio_id, security_id, decision_date, side, limit_check0 as limit_check, case when limit_check0 = 'APPLIED' then up end as price_cap, case when limit_check0 = 'APPLIED' then down end as price_floor from limited""",
    BASE,
    LOCK_STEPS[:8],
)
def _(t):
    return ords.with_decision_terms(_intents(t), ords.price_limits(_terms(t), t.master, t.cal))


@case(
    "e5_fees",
    "portfolio_id:i security_id:s execution_date:d side:s gross_amount:f2 total_fee:f2 net_amount:f2",
    f"""select portfolio_id, security_id, execution_date, side, g as gross_amount, {_fee('g', 'side', 'execution_date')} as total_fee,
       case when side = 'sell' then g - {_fee('g', 'side', 'execution_date')} else g + {_fee('g', 'side', 'execution_date')} end as net_amount
       from (select *, cast(round(price * quantity, 2) as decimal(18,2)) as g from trades_src)""",
    ("trades_src",),
)
def _(t):
    return ords.fees(t.trades)


LOCK_COLUMNS = "portfolio_id:i security_id:s decision_date:d side:s locked_quantity:i reference_price:f2 price_cap:f2 price_floor:f2 reserved_cash:f2 limit_check:s capacity_reason:s adv_window_status:s lock_status:s reject_reason:s"
LOCK_SELECT = """
select portfolio_id, security_id, decision_date, side, locked_quantity, case when ok then ref end as reference_price,
  case when ok and limit_check0 = 'APPLIED' then up end as price_cap, case when ok and limit_check0 = 'APPLIED' then down end as price_floor, reserved_cash,
  case when ok then limit_check0 else 'NOT_EVALUATED' end as limit_check, case when ok and capped is not null then 'CAPACITY_CAPPED' else 'NONE' end as capacity_reason,
  case when lots > 0 and ref is not null and (ok or reject_reason = 'CAPACITY_REJECTED') then case when adv_days >= 20 then 'ADV_FULL_WINDOW' when adv_days > 0 then 'ADV_PARTIAL_WINDOW' else 'NOT_EVALUATED' end else 'NOT_EVALUATED' end as adv_window_status,
  case when reject_reason = 'NO_NEXT_SESSION' then 'UNFILLED' when reject_reason is not null then 'REJECTED' else 'LOCKED' end as lock_status, reject_reason
from locked"""


@case("e6_lock_orders", LOCK_COLUMNS, LOCK_SELECT, BASE, LOCK_STEPS)
def _(t):
    return _build_locked(t)


@case(
    "e7_admit_by_cash",
    "portfolio_id:i security_id:s decision_date:d side:s locked_quantity:i reserved_cash:f2 lock_status:s reject_reason:s",
    "select portfolio_id, security_id, decision_date, side, locked_quantity, reserved_cash, lock_status, reject_reason from admitted",
    BASE,
    ADMIT_STEPS,
)
def _(t):
    return _build_admitted(t)


@case(
    "e8_fill_orders",
    "portfolio_id:i security_id:s decision_date:d side:s execution_date:d status:s reason:s filled_quantity:i gross_amount:f2 total_fee:f2 net_amount:f2 round_seq:i",
    """select portfolio_id, security_id, decision_date, side, case when lock_status = 'LOCKED' then next_session end as execution_date, status, reason, case when status = 'FILLED' then locked_quantity else 0 end as filled_quantity,
       gross as gross_amount, fee as total_fee, case when side = 'sell' then gross - fee else gross + fee end as net_amount, row_number() over (partition by portfolio_id, decision_date order by side desc, intent_seq) as round_seq from outcome""",
    BASE,
    FILL_STEPS,
)
def _(t):
    return _build_fills(t)


@case(
    "e9_sell_lock_check",
    "check:s key:s detail:s",
    """with p as (select portfolio_id, security_id, sum(quantity) // 7 as s from trades_src where side = 'buy' group by 1, 2)
select case when i.quantity > coalesce(p.s, 0) then 'SELL_EXCEEDS_SELLABLE' else 'ODD_LOT_SELL' end as "check", concat(i.portfolio_id, '/', i.decision_date, '/', i.security_id) as "key", cast(i.quantity as varchar) as detail
from intents_src i left join p on p.portfolio_id = i.portfolio_id and p.security_id = i.security_id
where i.side = 'sell' and (i.quantity > coalesce(p.s, 0) or (i.quantity % 100 <> 0 and i.quantity <> coalesce(p.s, 0)))""",
    ("trades_src", "intents_src"),
)
def _(t):
    held = t.trades.where("side = 'buy'").groupBy("portfolio_id", "security_id").agg(F.floor(F.sum("quantity") / 7).alias("sellable_quantity"))
    return ords.sell_lock_violations(t.intents.where("side = 'sell'"), held)


# -- E10 to E18 ----------------------------------------------------------------------------

LEDGER_ACTIONS = """
select security_id, ex_date, action_type, available_at, cash_dividend_per_share as cash, share_ratio as ratio, case when action_type in ('CASH_DIVIDEND','STOCK_DIVIDEND') then 'APPLY' else 'UNSUPPORTED' end as kind, 1 as ord
from (select *, row_number() over (partition by security_id, ex_date, action_type order by available_at desc) as rn from actions where available_at <= ex_date + interval 9 hours and ex_date in (select trade_date from cal)) where rn = 1
union all select security_id, ex_date, action_type, available_at, cash_dividend_per_share, share_ratio, 'UNPROCESSED', 0 from actions a
where available_at > ex_date + interval 9 hours and available_at <= ex_date + interval 15 hours and ex_date in (select trade_date from cal)
  and not exists (select 1 from actions b where b.security_id = a.security_id and b.ex_date = a.ex_date and b.action_type = a.action_type and b.available_at <= a.ex_date + interval 9 hours)"""


def _entitle_steps(base: str, holders: str) -> tuple[tuple[str, str], ...]:
    """``holders`` yields (portfolio_id, security_id); ``base`` is the position from fills before an event."""
    return (
        ("lact", LEDGER_ACTIONS),
        ("evt", f"select h.portfolio_id, h.security_id, l.* exclude (security_id), row_number() over (partition by h.portfolio_id, h.security_id order by l.ex_date, l.ord, l.action_type, l.available_at) as n, {base} as base from ({holders}) h join lact l on l.security_id = h.security_id"),
        (
            "fold",
            """select portfolio_id, security_id, cast(0 as bigint) as n, cast(0 as bigint) as prior, cast(0 as bigint) as share_delta, cast(0 as bigint) as bonus from (select distinct portfolio_id, security_id from evt)
               union all select e.portfolio_id, e.security_id, e.n, cast(e.base + f.bonus as bigint),
                 cast(case when e.kind = 'APPLY' and e.ratio > 0 and e.base + f.bonus > 0 then floor((e.base + f.bonus) * e.ratio) else 0 end as bigint),
                 cast(f.bonus + case when e.kind = 'APPLY' and e.ratio > 0 and e.base + f.bonus > 0 then floor((e.base + f.bonus) * e.ratio) else 0 end as bigint)
               from fold f join evt e on e.portfolio_id = f.portfolio_id and e.security_id = f.security_id and e.n = f.n + 1""",
        ),
        (
            "ent",
            """select e.*, f.prior, f.share_delta, case when e.kind = 'APPLY' and e.cash > 0 then cast(round(e.cash * f.prior, 2) as decimal(18,2)) else 0 end as accrued,
                 (select min(trade_date) from cal where trade_date > e.ex_date) as pay_date from evt e join fold f on f.portfolio_id = e.portfolio_id and f.security_id = e.security_id and f.n = e.n where f.prior > 0""",
        ),
    )


TRADES = f"""
select portfolio_id, security_id, execution_date, side, quantity, {_fee('g', 'side', 'execution_date')} as fee, case when side = 'sell' then g - {_fee('g', 'side', 'execution_date')} else g + {_fee('g', 'side', 'execution_date')} end as net
from (select *, cast(round(price * quantity, 2) as decimal(18,2)) as g from trades_src)"""
TRADE_VIEWS = ("actions", "cal", "bars_src", "trades_src")
NET_BASE = "coalesce((select sum(case when side = 'buy' then quantity else -quantity end) from trd t where t.portfolio_id = h.portfolio_id and t.security_id = h.security_id and t.execution_date < l.ex_date), 0)"
ENT_STEPS = (("trd", TRADES), *_entitle_steps(NET_BASE, "select distinct portfolio_id, security_id from trd"))
FIFO_STEPS = (
    *ENT_STEPS,
    (
        "lots",
        """select *, sum(quantity) over w as hi, sum(quantity) over w - quantity as lo, row_number() over w as lot_no from (
             select portfolio_id, security_id, execution_date as lot_date, 1 as lot_kind, '' as lot_tag, quantity, cast(net * 100 as bigint) as cents from trd where side = 'buy'
             union all select portfolio_id, security_id, ex_date, 0, action_type, share_delta, 0 from ent where share_delta > 0) window w as (partition by portfolio_id, security_id order by lot_date, lot_kind, lot_tag)""",
    ),
    ("sold", "select portfolio_id, security_id, execution_date as sell_date, quantity, net, sum(quantity) over w as hi, sum(quantity) over w - quantity as lo from trd where side = 'sell' window w as (partition by portfolio_id, security_id order by execution_date)"),
    (
        "seg",
        """select l.portfolio_id, l.security_id, l.lot_no, l.quantity as lot_quantity, l.cents, s.sell_date, least(l.hi, s.hi) - greatest(l.lo, s.lo) as q, row_number() over (partition by l.portfolio_id, l.security_id, l.lot_no order by s.sell_date) as m
           from lots l join sold s on s.portfolio_id = l.portfolio_id and s.security_id = l.security_id and s.lo < l.hi and s.hi > l.lo""",
    ),
    (
        "spend",
        """select portfolio_id, security_id, lot_no, cast(0 as bigint) as m, cast(quantity as bigint) as left_q, cents as left_c, cast(0 as bigint) as q, cast(0 as bigint) as part, cast(null as date) as sell_date from lots
           union all select s.portfolio_id, s.security_id, s.lot_no, s.m, cast(p.left_q - s.q as bigint),
             cast(p.left_c - case when s.q = p.left_q then p.left_c else (2 * cast(p.left_c as hugeint) * s.q + p.left_q) // (2 * p.left_q) end as bigint), cast(s.q as bigint),
             cast(case when s.q = p.left_q then p.left_c else (2 * cast(p.left_c as hugeint) * s.q + p.left_q) // (2 * p.left_q) end as bigint), s.sell_date
           from spend p join seg s on s.portfolio_id = p.portfolio_id and s.security_id = p.security_id and s.lot_no = p.lot_no and s.m = p.m + 1""",
    ),
    ("matches", "select p.*, l.lot_date, l.lot_kind, l.lot_tag from spend p join lots l using (portfolio_id, security_id, lot_no) where p.m > 0"),
    ("remaining", "select p.portfolio_id, p.security_id, l.lot_date, l.lot_kind, l.lot_tag, p.left_q as quantity, p.left_c as cents from (select *, row_number() over (partition by portfolio_id, security_id, lot_no order by m desc) as back from spend) p join lots l using (portfolio_id, security_id, lot_no) where back = 1 and left_q > 0"),
    ("booked", "select s.portfolio_id, s.security_id, s.sell_date, s.quantity, s.net, coalesce(sum(m.part), 0) as cents from sold s left join matches m on m.portfolio_id = s.portfolio_id and m.security_id = s.security_id and m.sell_date = s.sell_date group by 1, 2, 3, 4, 5"),
)


@case(
    "e10_fifo_match",
    "portfolio_id:i security_id:s lot_date:d lot_kind:i lot_tag:s sell_date:d quantity:i cost:f2",
    "select portfolio_id, security_id, lot_date, lot_kind, lot_tag, sell_date, q as quantity, part / 100.0 as cost from matches",
    TRADE_VIEWS,
    FIFO_STEPS,
)
def _(t):
    return led.fifo_match(_trades(t), _granted(t).where("share_delta > 0")).matches


@case(
    "e10_fifo_sells",
    "portfolio_id:i security_id:s sell_date:d quantity:i net_amount:f2 consumed_cost:f2 realized_pnl:f2",
    "select portfolio_id, security_id, sell_date, quantity, net as net_amount, cents / 100.0 as consumed_cost, cast(net as double) - cents / 100.0 as realized_pnl from booked",
    TRADE_VIEWS,
    FIFO_STEPS,
)
def _(t):
    return led.fifo_match(_trades(t), _granted(t).where("share_delta > 0")).sells


@case(
    "e10_fifo_violations",
    "check:s key:s detail:s",
    """select 'SELL_EXCEEDS_POSITION' as "check", concat(portfolio_id, '/', security_id, '/', execution_date) as "key", cast(quantity as varchar) as detail from trades_src where side = 'sell'""",
    ("trades_src",),
)
def _(t):
    return led.fifo_match(_trades(t).where("side = 'sell'")).violations


@case(
    "e11_dividend_entitlements",
    "portfolio_id:i security_id:s ex_date:d action_type:s kind:s prior:i share_delta:i accrued:f2 pay_date:d",
    "select portfolio_id, security_id, ex_date, action_type, kind, prior, share_delta, accrued, pay_date from ent",
    TRADE_VIEWS,
    _entitle_steps("h.q", "select portfolio_id, security_id, sum(quantity) as q from trades_src where side = 'buy' group by 1, 2"),
)
def _(t):
    held = t.trades.where("side = 'buy'").groupBy("portfolio_id", "security_id").agg(F.sum("quantity").alias("total_quantity"))
    return led.dividend_entitlements(t.actions, held, t.cal)


LEDGER = """
select portfolio_id, security_id, trade_date, event_type, quantity_delta, cash_cents, cost_cents, phase, sub from (
  select portfolio_id, security_id, execution_date as trade_date, 'BUY_FILL' as event_type, quantity as quantity_delta, -cast(net * 100 as bigint) as cash_cents, cast(net * 100 as bigint) as cost_cents, 4 as phase, '' as sub from trd where side = 'buy'
  union all select portfolio_id, security_id, sell_date, 'SELL_FILL', -quantity, cast(net * 100 as bigint), -cents, 3, '' from booked
  union all select portfolio_id, security_id, ex_date, 'CA_SHARES_ADJUSTED', share_delta, 0, 0, 2, concat(action_type, '|2') from ent where share_delta > 0
  union all select portfolio_id, security_id, ex_date, 'CA_DIVIDEND_ACCRUED', 0, 0, 0, 2, concat(action_type, '|1') from ent where accrued > 0
  union all select portfolio_id, security_id, ex_date, 'UNSUPPORTED_CORPORATE_EVENT', 0, 0, 0, 2, concat(action_type, '|0') from ent where kind = 'UNSUPPORTED'
  union all select portfolio_id, security_id, ex_date, 'UNPROCESSED_CA', 0, 0, 0, 1, concat(action_type, available_at) from ent where kind = 'UNPROCESSED'
  union all select portfolio_id, security_id, pay_date, 'CA_DIVIDEND_PAID', 0, cast(sum(accrued) * 100 as bigint), 0, 0, cast(ex_date as varchar) from ent where accrued > 0 and pay_date is not null group by portfolio_id, security_id, ex_date, pay_date)"""
LEDGER_STEPS = (*FIFO_STEPS, ("entries", LEDGER))


@case(
    "e12_replay_ledger",
    "portfolio_id:i security_id:s trade_date:d event_type:s quantity_delta:i cash_delta:f2 cost_basis_delta:f2 position_quantity_after:i cash_after:f2 event_id:i",
    """select portfolio_id, security_id, trade_date, event_type, quantity_delta, cash_cents / 100.0 as cash_delta, cost_cents / 100.0 as cost_basis_delta,
       sum(quantity_delta) over (partition by portfolio_id, security_id order by trade_date, phase, sub rows unbounded preceding) as position_quantity_after,
       (10000000000 + sum(cash_cents) over w) / 100.0 as cash_after, row_number() over w as event_id
       from entries window w as (partition by portfolio_id order by trade_date, phase, security_id, sub rows unbounded preceding)""",
    TRADE_VIEWS,
    LEDGER_STEPS,
)
def _(t):
    return led.replay_ledger(_trades(t), t.actions, t.cal, _opening(t), granted=_granted(t))


@case(
    "e13_position_view",
    "portfolio_id:i security_id:s total_quantity:i sellable_quantity:i locked_quantity:i unsellable_quantity:i cost_basis:f2",
    """select portfolio_id, security_id, sum(quantity) as total_quantity, sum(case when lot_kind = 0 or lot_date < date '2023-10-30' then quantity else 0 end) as sellable_quantity, 0 as locked_quantity,
       sum(case when lot_kind = 1 and lot_date >= date '2023-10-30' then quantity else 0 end) as unsellable_quantity, sum(cents) / 100.0 as cost_basis from remaining group by 1, 2""",
    TRADE_VIEWS,
    FIFO_STEPS,
)
def _(t):
    return led.position_view(_trades(t), t.actions, t.cal, "2023-10-30")


@case(
    "e13_locked_positions",
    "portfolio_id:i security_id:s total_quantity:i sellable_quantity:i locked_quantity:i unsellable_quantity:i cost_basis:f2",
    """with l as (select portfolio_id, security_id, sum(quantity) as q from intents_src where side = 'sell' and decision_date > date '2021-05-03' and decision_date <= date '2021-06-28' group by 1, 2),
v as (select portfolio_id, security_id, sum(quantity) as total_quantity, sum(case when lot_kind = 0 or lot_date < date '2021-06-28' then quantity else 0 end) as free, sum(cents) / 100.0 as cost_basis from remaining group by 1, 2)
select v.portfolio_id, v.security_id, total_quantity, free - least(coalesce(q, 0), free) as sellable_quantity, least(coalesce(q, 0), free) as locked_quantity, total_quantity - free as unsellable_quantity, cost_basis from v left join l using (portfolio_id, security_id)""",
    (*TRADE_VIEWS, "intents_src"),
    (
        ("trd", f"select * from ({TRADES}) x where execution_date <= date '2021-06-28'"),
        ("lact", f"select * from ({LEDGER_ACTIONS}) x where ex_date <= date '2021-06-28'"),
        *_entitle_steps(NET_BASE, "select distinct portfolio_id, security_id from trd")[1:],
        *FIFO_STEPS[len(ENT_STEPS) :],
    ),
)
def _(t):
    """Sells decided in the eight weeks before the date are still open: what they lock cannot be sold again."""
    day = F.lit("2021-06-28").cast("date")
    open_sells = t.intents.where((F.col("side") == "sell") & (F.col("decision_date") <= day) & (F.col("decision_date") > F.date_sub(day, 56)))
    locked = open_sells.groupBy("portfolio_id", "security_id").agg(F.sum("quantity").alias("locked_quantity"))
    return led.position_view(_trades(t), t.actions, t.cal, "2021-06-28", locked)


def _nav(t):
    return t.landed("nav_daily", lambda: led.daily_nav(_entries(t), t.bars, t.cal, _opening(t), _trades(t)))


NAV_SQL = """
with mv as (
  select e.portfolio_id, c.trade_date, sum(e.q * (select round(arg_max(b.close, b.trade_date), 2) from bars b where b.security_id = e.security_id and b.close is not null and b.trade_date <= c.trade_date)) as mv, sum(e.c) / 100.0 as cost
  from (select portfolio_id, security_id, trade_date, lead(trade_date) over (partition by portfolio_id, security_id order by trade_date) as until, q, c from (
          select portfolio_id, security_id, trade_date, sum(sum(quantity_delta)) over (partition by portfolio_id, security_id order by trade_date rows unbounded preceding) as q, sum(sum(cost_cents)) over (partition by portfolio_id, security_id order by trade_date rows unbounded preceding) as c
          from entries group by 1, 2, 3)) e join cal c on c.trade_date >= e.trade_date and (e.until is null or c.trade_date < e.until) where e.q <> 0 group by 1, 2),
d as (select portfolio_id, trade_date, sum(cash_cents) as cash, count(*) as n from entries group by 1, 2),
r as (select portfolio_id, day, sum(x) as x from (select portfolio_id, ex_date as day, cast(accrued * 100 as bigint) as x from ent where accrued > 0 union all select portfolio_id, pay_date, -cast(accrued * 100 as bigint) from ent where accrued > 0 and pay_date is not null) group by 1, 2),
g as (select p.portfolio_id, c.trade_date from (select portfolio_id, min(trade_date) as lo from entries group by 1) p join cal c on c.trade_date >= p.lo),
t as (select g.*, (10000000000 + sum(coalesce(d.cash, 0) + coalesce(r.x, 0)) over (partition by g.portfolio_id order by g.trade_date rows unbounded preceding)) / 100.0 as cash, coalesce(d.n, 0) as n
      from g left join d on d.portfolio_id = g.portfolio_id and d.trade_date = g.trade_date left join r on r.portfolio_id = g.portfolio_id and r.day = g.trade_date)
select t.portfolio_id, t.trade_date, t.cash + coalesce(cast(mv.mv as double), 0) as nav, t.cash, coalesce(cast(mv.mv as double), 0) as holdings_market_value, t.n as event_count, coalesce(cast(mv.mv as double), 0) - coalesce(mv.cost, 0) as unrealized_pnl
from t left join mv on mv.portfolio_id = t.portfolio_id and mv.trade_date = t.trade_date"""


@case("e14_daily_nav", "portfolio_id:i trade_date:d nav:f2 cash:f2 holdings_market_value:f2 event_count:i unrealized_pnl:f2", NAV_SQL, ("bars", *TRADE_VIEWS), LEDGER_STEPS)
def _(t):
    return led.daily_nav(_entries(t), t.bars, t.cal, _opening(t), _trades(t))


@case("e15_accounting_identity", "check:s key:s detail:s", """select 'ACCOUNTING_IDENTITY' as "check", '' as "key", '' as detail from cal where session_idx < 0""", ("cal",))
def _(t):
    return led.identity_violations(led.accounting_identity(_nav(t), _opening(t)))


# One chained run: locked orders, fills, ledger with sell locks, NAV, summary.


def _chain_entries(t):
    def build():
        filled = _fills(t).where("status = 'FILLED'")
        return led.replay_ledger(filled, t.actions, t.cal, _chain_opening(t), _fills(t))

    return t.landed("chain_entries", build)


def _chain_opening(t):
    return _intents(t).select("portfolio_id").distinct().withColumn("cash", F.lit("20000.00").cast("decimal(18,2)"))


def _chain_nav(t):
    return t.landed("chain_nav", lambda: led.daily_nav(_chain_entries(t), t.bars, t.cal, _chain_opening(t), _fills(t).where("status = 'FILLED'")))


CHAIN_TRADES = """
select portfolio_id, security_id, next_session as execution_date, side, locked_quantity as quantity, fee, case when side = 'sell' then gross - fee else gross + fee end as net
from outcome where status = 'FILLED'"""
LOCK_ENTRIES = """
select *, 0 as locked from ledger0
union all select portfolio_id, security_id, decision_date, 'SELL_LOCK', 0, 0, 0, 5, '', quantity from outcome where side = 'sell' and lock_status = 'LOCKED'
union all select portfolio_id, security_id, next_session, 'SELL_LOCK_RELEASE', 0, 0, 0, 3, '|r', -quantity from outcome where side = 'sell' and lock_status = 'LOCKED' and status <> 'FILLED'"""
CHAIN_STEPS = (
    *FILL_STEPS,
    ("trd", CHAIN_TRADES),
    *_entitle_steps(NET_BASE, "select distinct portfolio_id, security_id from trd"),
    *FIFO_STEPS[len(ENT_STEPS) :],
    ("ledger0", LEDGER),
    ("entries", LOCK_ENTRIES),
    (
        "chained",
        """select *, sum(quantity_delta) over p as position_quantity_after, sum(locked) over p as locked_quantity_after, (2000000 + sum(cash_cents) over w) / 100.0 as cash_after, row_number() over w as event_id
           from entries window p as (partition by portfolio_id, security_id order by trade_date, phase, sub rows unbounded preceding), w as (partition by portfolio_id order by trade_date, phase, security_id, sub rows unbounded preceding)""",
    ),
)
CHAIN_NAV = NAV_SQL.replace("10000000000", "2000000")


@case(
    "e12_chained_ledger",
    "portfolio_id:i security_id:s trade_date:d event_type:s quantity_delta:i cash_delta:f2 cost_basis_delta:f2 locked_quantity_delta:i position_quantity_after:i locked_quantity_after:i cash_after:f2 event_id:i",
    "select portfolio_id, security_id, trade_date, event_type, quantity_delta, cash_cents / 100.0 as cash_delta, cost_cents / 100.0 as cost_basis_delta, locked as locked_quantity_delta, position_quantity_after, locked_quantity_after, cash_after, event_id from chained",
    BASE,
    CHAIN_STEPS,
)
def _(t):
    return _chain_entries(t)


@case(
    "e15_ledger_violations",
    "check:s key:s",
    """select 'NEGATIVE_CASH' as "check", concat_ws('/', portfolio_id, security_id, trade_date, event_id) as "key" from chained where cash_after < 0
       union all select 'NEGATIVE_POSITION', concat_ws('/', portfolio_id, security_id, trade_date, event_id) from chained where position_quantity_after < 0
       union all select 'NEGATIVE_LOCK', concat_ws('/', portfolio_id, security_id, trade_date, event_id) from chained where locked_quantity_after < 0""",
    BASE,
    CHAIN_STEPS,
)
def _(t):
    return led.ledger_violations(_chain_entries(t))


@case(
    "e15_broken_identity",
    "check:s key:s detail:s",
    """select 'ACCOUNTING_IDENTITY' as "check", concat_ws('/', portfolio_id, trade_date) as "key", '1.00' as detail
       from (select *, lag(day(trade_date)) over (partition by portfolio_id order by trade_date) as before from navq) where day(trade_date) = 15 or before = 15""",
    ("bars", *TRADE_VIEWS),
    (*LEDGER_STEPS, ("navq", NAV_SQL)),
)
def _(t):
    """A NAV that is 1.00 too high on every 15th breaks the identity there and on the next session."""
    off = F.when(F.dayofmonth("trade_date") == 15, F.lit(1)).otherwise(F.lit(0))
    nav = _nav(t).withColumn("nav", (F.col("nav") + off).cast("decimal(28,2)"))
    return led.identity_violations(led.accounting_identity(nav, _opening(t)))


@case(
    "e16_run_summary",
    "portfolio_id:i filled:i rejected:i suspended:i unfilled:i limit_rejected:i cash_insufficient:i capacity_rejected:i no_open_price:i capacity_capped:i lot_adjusted:i total_fees:f2 ca_events:i unprocessed_ca:i sessions:i final_nav:f2",
    """select * from (select portfolio_id, count(*) filter (status = 'FILLED') as filled, count(*) filter (status = 'REJECTED') as rejected, count(*) filter (status = 'SUSPENDED') as suspended, count(*) filter (status = 'UNFILLED') as unfilled,
       count(*) filter (reason in ('LIMIT_UP_NO_BUY', 'LIMIT_DOWN_NO_SELL')) as limit_rejected, count(*) filter (reason = 'CASH_INSUFFICIENT') as cash_insufficient, count(*) filter (reason in ('CAPACITY_NO_ADV_DATA', 'CAPACITY_REJECTED')) as capacity_rejected,
       count(*) filter (reason = 'NO_OPEN_PRICE') as no_open_price, count(*) filter (lock_status = 'LOCKED' and capped is not null) as capacity_capped, count(*) filter (lock_status = 'LOCKED' and capped is null and quantity <> locked_quantity) as lot_adjusted, sum(fee) as total_fees
       from outcome group by 1)
       full join (select portfolio_id, count(*) filter (event_type like 'CA\\_%' escape '\\' or event_type in ('UNSUPPORTED_CORPORATE_EVENT', 'UNPROCESSED_CA')) as ca_events, count(*) filter (event_type = 'UNPROCESSED_CA') as unprocessed_ca from entries group by 1) using (portfolio_id)
       full join (select portfolio_id, arg_max(nav, trade_date) as final_nav, count(*) as sessions from navq group by 1) using (portfolio_id)""",
    BASE,
    (*CHAIN_STEPS, ("navq", CHAIN_NAV)),
)
def _(t):
    return led.run_summary(_fills(t), _chain_entries(t), _chain_nav(t))


@case(
    "e17_ca_observations",
    "portfolio_id:i event_type:s action_type:s security_id:s trade_date:d prior_position:i share_delta:i receivable_cash_delta:f2 total_cost_basis_before:f2 total_cost_basis_after:f2 sellable_date:d",
    """with run as (select *, sum(quantity_delta) over p as q, sum(cost_cents) over p as c from entries window p as (partition by portfolio_id, security_id order by trade_date, phase, sub rows unbounded preceding))
select r.portfolio_id, r.event_type, case event_type when 'CA_DIVIDEND_ACCRUED' then 'CASH_DIVIDEND' when 'CA_DIVIDEND_PAID' then 'CASH_DIVIDEND_PAYMENT' when 'CA_SHARES_ADJUSTED' then 'STOCK_DIVIDEND' when 'UNSUPPORTED_CORPORATE_EVENT' then 'UNSUPPORTED' else 'UNPROCESSED' end as action_type,
  r.security_id, r.trade_date, r.q - r.quantity_delta as prior_position, r.quantity_delta as share_delta, coalesce(e.accrued, 0) as receivable_cash_delta,
  (r.c - r.cost_cents) / 100.0 as total_cost_basis_before, r.c / 100.0 as total_cost_basis_after, case when event_type = 'CA_SHARES_ADJUSTED' then r.trade_date end as sellable_date
from run r left join ent e on event_type = 'CA_DIVIDEND_ACCRUED' and e.portfolio_id = r.portfolio_id and e.security_id = r.security_id and e.ex_date = r.trade_date and concat(e.action_type, '|1') = r.sub and e.accrued > 0
where event_type not in ('BUY_FILL', 'SELL_FILL')""",
    TRADE_VIEWS,
    LEDGER_STEPS,
)
def _(t):
    return led.ca_observations(_entries(t))


@case(
    "e18_entitlement_audit",
    "security_id:s ex_date:d action_type:s receivable_cash_delta:f2 deduction_cash_delta:f2 share_delta:i unit_cost_after:f8",
    """select l.security_id, l.ex_date, l.action_type, round(l.cash * 1000, 2) as receivable_cash_delta, round(a.ex_right_cash_deduction_per_share * 1000, 2) as deduction_cash_delta, floor(1000 * l.ratio) as share_delta, 10000.0 / (1000 + floor(1000 * l.ratio)) as unit_cost_after
       from lact l join actions a on a.security_id = l.security_id and a.ex_date = l.ex_date and a.action_type = l.action_type and a.available_at = l.available_at where l.kind = 'APPLY'""",
    ("actions", "cal"),
    (("lact", LEDGER_ACTIONS),),
)
def _(t):
    return led.entitlement_audit(t.actions, t.cal)


# -- E19 to E21 and J20 ---------------------------------------------------------------------


def _points(t):
    """A ranked point per decision date and security, from the day's traded quantity."""
    totals = t.intents.groupBy(F.col("decision_date").alias("signal_date"), "security_id").agg(F.sum("quantity").alias("score"))
    rank = F.row_number().over(Window.partitionBy("signal_date").orderBy(F.col("score").desc(), "security_id"))
    status = F.when(F.col("score") % 7 == 0, "NO_DATA").otherwise("OK")
    return totals.withColumn("status", status).where("status = 'OK'").withColumn("cross_sectional_rank", rank)


POINTS = """
select signal_date, security_id, row_number() over (partition by signal_date order by score desc, security_id) as rk
from (select decision_date as signal_date, security_id, sum(quantity) as score from intents_src group by 1, 2) where score % 7 <> 0"""
TARGETS = "select signal_date, security_id, rk, least(1.0 / count(*) over (partition by signal_date), 0.22) as weight from pts where rk <= 4"
HOLDINGS = """select portfolio_id, decision_date, security_id, sum(case when side = 'buy' then quantity * 3 else quantity end) as total_quantity, sum(case when side = 'sell' then quantity else quantity // 3 end) as sellable_quantity from intents_src group by 1, 2, 3"""
BOOK = """
select coalesce(h.portfolio_id, g.portfolio_id) as portfolio_id, coalesce(h.decision_date, g.decision_date) as decision_date, coalesce(h.security_id, g.security_id) as security_id,
  coalesce(total_quantity, 0) as total_quantity, coalesce(sellable_quantity, 0) as sellable_quantity, coalesce(weight, 0) as weight
from hold h full join (select p.portfolio_id, t.signal_date as decision_date, t.security_id, t.weight from tgt t join (select distinct portfolio_id, decision_date from hold) p on p.decision_date = t.signal_date) g
  on g.portfolio_id = h.portfolio_id and g.decision_date = h.decision_date and g.security_id = h.security_id"""
TARGET_STEPS = (("pts", POINTS), ("tgt", TARGETS), ("hold", HOLDINGS), ("book", BOOK))


@case("e19_equal_weight_targets", "signal_date:d security_id:s cross_sectional_rank:i weight:f8", "select signal_date, security_id, rk as cross_sectional_rank, weight from tgt", ("intents_src",), TARGET_STEPS[:2])
def _(t):
    return ords.equal_weight_targets(_points(t), 4, Decimal("0.22"))


def _holdings(t):
    buy = F.col("side") == "buy"
    total = F.sum(F.when(buy, F.col("quantity") * 3).otherwise(F.col("quantity")))
    sellable = F.sum(F.when(~buy, F.col("quantity")).otherwise(F.floor(F.col("quantity") / 3).cast("bigint")))
    return t.intents.groupBy("portfolio_id", "decision_date", "security_id").agg(total.alias("total_quantity"), sellable.alias("sellable_quantity"))


def _book(t):
    held = _holdings(t)
    targets = ords.equal_weight_targets(_points(t), 4, Decimal("0.22")).select(F.col("signal_date").alias("decision_date"), "security_id", "weight")
    per_portfolio = held.select("portfolio_id", "decision_date").distinct().join(targets, "decision_date")
    return ords.holdings_vs_targets(held, per_portfolio)


@case("j20_holdings_vs_targets", "portfolio_id:i decision_date:d security_id:s total_quantity:i sellable_quantity:i weight:f8", "select * from book", ("intents_src",), TARGET_STEPS)
def _(t):
    return _book(t)


@case(
    "e20_orders_to_targets",
    "portfolio_id:i decision_date:d security_id:s side:s quantity:i intent_seq:i",
    """with s as (select b.*, case when weight > 0 then floor(floor((500000 * 0.98 * cast(weight as double)) / (10 + length(security_id) % 3 + 1.0) + 1e-7) / 100) * 100 else 0 end as tq from book b),
q as (select portfolio_id, decision_date, security_id, 'sell' as side, case when total_quantity > tq then case when tq > 0 then floor(least(total_quantity - tq, sellable_quantity) / 100) * 100 else least(total_quantity - tq, sellable_quantity) end else 0 end as quantity from s
  union all select portfolio_id, decision_date, security_id, 'buy', case when tq > total_quantity then floor((tq - total_quantity) / 100) * 100 else 0 end from s)
select *, row_number() over (partition by portfolio_id, decision_date order by side desc, security_id) as intent_seq from q where quantity > 0""",
    ("intents_src",),
    TARGET_STEPS,
)
def _(t):
    price = (F.lit(10) + F.length("security_id") % 3 + 1).cast("decimal(18,6)")
    nav = _holdings(t).select("portfolio_id", "decision_date").distinct().withColumn("nav", F.lit("500000.00").cast("decimal(18,2)"))
    return ords.orders_to_targets(_book(t).withColumn("price", price), nav, signal_hash="h0")


@case(
    "e21_fixed_universe_orders",
    "portfolio_id:i decision_date:d security_id:s side:s quantity:i",
    """with tg as (select trade_date, security_id from (select trade_date, security_id, row_number() over (partition by trade_date order by security_id) as rn from bars where trade_status = '正常') where rn <= 10)
select h.portfolio_id, h.decision_date, h.security_id, 'sell' as side, h.sellable_quantity as quantity from hold h left join tg on tg.trade_date = h.decision_date and tg.security_id = h.security_id where tg.security_id is null and h.sellable_quantity > 0
union all select p.portfolio_id, p.decision_date, tg.security_id, 'buy', 100 from (select distinct portfolio_id, decision_date from hold) p join tg on tg.trade_date = p.decision_date
left join hold h on h.portfolio_id = p.portfolio_id and h.decision_date = p.decision_date and h.security_id = tg.security_id where h.security_id is null""",
    ("bars", "intents_src"),
    TARGET_STEPS[2:3],
)
def _(t):
    held = _holdings(t).withColumnRenamed("decision_date", "trade_date")
    return ords.fixed_universe_orders(pit.tradable_universe(t.bars), held, 10, 100)
