"""Calendar, point-in-time and adjusted-return queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.pricing import REFERENCE_PRICE_RULES, effective_rule, reference_price
from tidemark.functions.scalars import market_close_ts
from tidemark.operators import actions as act
from tidemark.operators import calendar as calops
from tidemark.operators import pit, returns
from tidemark.operators.evaluation import blocked_rate, status_diagnostics
from workload.cases import case

ASOF = "2021-06-30 15:00:00"
END = "2023-12-31 15:00:00"

ORDER_DAYS = "select o_orderkey, cast(o_orderdate + to_days(8036) as date) as day from orders"


def _order_days(t):
    return t.base("orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 8036).alias("day"))


# -- C: calendar -----------------------------------------------------------------


@case(
    "c1_is_session",
    "o_orderkey:i day:d is_session:b",
    f"select d.*, c.trade_date is not null as is_session from ({ORDER_DAYS}) d left join cal c on c.trade_date = d.day",
    ("cal",),
)
def _(t):
    return calops.is_session(_order_days(t), t.cal, "day")


def _offset_sql(op: str, direction: str, n: int) -> str:
    pick = "max" if direction == "desc" else "min"
    del pick
    return f"""
select d.o_orderkey, d.day, x.trade_date as session, case when x.trade_date is null then '{'NO_PREVIOUS_SESSION' if op == '<' else 'NO_NEXT_SESSION'}' end as reason
from ({ORDER_DAYS}) d
left join (select day, (select trade_date from cal where trade_date {op} k.day order by trade_date {direction} limit 1 offset {n - 1}) as trade_date
           from (select distinct day from ({ORDER_DAYS})) k) x on x.day = d.day"""


@case("c2_prev_session", "o_orderkey:i day:d session:d reason:s", _offset_sql("<", "desc", 3), ("cal",))
def _(t):
    return calops.prev_session(_order_days(t), t.cal, "day", 3, "session", "reason")


@case("c3_next_session", "o_orderkey:i day:d session:d reason:s", _offset_sql(">", "asc", 2), ("cal",))
def _(t):
    return calops.next_session(_order_days(t), t.cal, "day", 2, "session", "reason")


@case(
    "c4_sessions_between",
    "o_orderkey:i inclusive:i exclusive:i",
    f"""
with r as (select o_orderkey, day as a, cast(day + to_days(cast(o_orderkey % 90 as integer)) as date) as b from ({ORDER_DAYS})),
n as (select o_orderkey, a, b, (select count(*) from cal where trade_date <= b) - (select count(*) from cal where trade_date < a) as inclusive,
  (select count(*) from cal where trade_date = a) as ea, (select count(*) from cal where trade_date = b) as eb from r)
select o_orderkey, inclusive, greatest(inclusive - ea - eb, 0) as exclusive from n""",
    ("cal",),
)
def _(t):
    rows = _order_days(t).withColumn("b", F.date_add("day", (F.col("o_orderkey") % 90).cast("int")))
    both = calops.sessions_between(rows, t.cal, "day", "b", True, "inclusive")
    return calops.sessions_between(both, t.cal, "day", "b", False, "exclusive")


@case("c5_session_range", "trade_date:d session_idx:i", "select * from cal where trade_date between date '2019-01-01' and date '2020-06-30'", ("cal",))
def _(t):
    return calops.session_range(t.cal, "2019-01-01", "2020-06-30")


@case(
    "c6_month_first_sessions",
    "month:d trade_date:d",
    "select date_trunc('month', trade_date) as month, min(trade_date) as trade_date from cal where trade_date between date '2018-01-01' and date '2023-06-30' group by 1",
    ("cal",),
)
def _(t):
    return calops.month_first_sessions(t.cal, "2018-01-01", "2023-06-30")


@case(
    "c7_every_nth_session",
    "trade_date:d session_idx:i",
    "select * from cal where trade_date >= date '2018-01-01' and (session_idx - (select min(session_idx) from cal where trade_date >= date '2018-01-01')) % 7 = 0",
    ("cal",),
)
def _(t):
    return calops.every_nth_session(t.cal, 7, "2018-01-01")


@case(
    "c8_densify_bars",
    "security_id:s trade_date:d open:f6 high:f6 low:f6 close:f6 volume:i amount:f4 trade_status:s available_at:t event_ts:t price_basis:s bar_frequency:s",
    """select security_id, trade_date, open, high, low, close, volume, amount, trade_status, available_at, available_at as event_ts,
       'RAW_UNADJUSTED' as price_basis, 'daily' as bar_frequency from bars_wide""",
    ("bars", "bars_src"),
    (("bars_wide", "select b.*, s.high, s.low from (select * from bars) b left join (select security_id, trade_date, high, low from bars_src) s using (security_id, trade_date)"),),
)
def _(t):
    return t.bars


@case(
    "c9_listing_session_number",
    "security_id:s trade_date:d listing_session:f0",
    """select b.security_id, b.trade_date, case when b.trade_date >= m.list_date and m.list_date >= (select min(trade_date) from cal)
         then (select count(*) from cal c where c.trade_date between m.list_date and b.trade_date) end as listing_session
       from bars b join master m using (security_id)""",
    ("bars", "master", "cal"),
)
def _(t):
    joined = t.bars.select("security_id", "trade_date").join(t.master.select("security_id", "list_date"), "security_id")
    return calops.listing_session_number(joined, t.cal, "list_date", "trade_date")


# -- F: point in time ---------------------------------------------------------------


@case(
    "f1_pit_query",
    "security_id:s ex_date:d action_type:s cash_dividend_per_share:f6 share_ratio:f6 available_at:t",
    f"select security_id, ex_date, action_type, cash_dividend_per_share, share_ratio, available_at from actions where available_at <= timestamp '{ASOF}'",
    ("actions",),
)
def _(t):
    return pit.pit_query(t.actions, "corporate_actions", f"{ASOF}+08:00", columns=["security_id", "ex_date", "action_type", "cash_dividend_per_share", "share_ratio", "available_at"])


@case(
    "f1_pit_query_bars",
    "security_id:s trade_date:d close:f6",
    f"select security_id, trade_date, close from bars join (select distinct security_id from actions) using (security_id) where available_at <= timestamp '{ASOF}'",
    ("bars", "actions"),
)
def _(t):
    return pit.pit_query(t.bars, "daily_bar_raw", ASOF, ids=t.actions, columns=["security_id", "trade_date", "close"])


@case(
    "f2_pit_query_many",
    "asof_ts:t visible_rows:i cash:f6",
    """select a.asof_ts, count(v.available_at) as visible_rows, coalesce(sum(v.cash_dividend_per_share), 0) as cash
       from (select trade_date + interval 9 hours as asof_ts from cal union all select trade_date + interval 15 hours from cal) a
       left join actions v on v.available_at <= a.asof_ts group by 1""",
    ("cal", "actions"),
)
def _(t):
    asofs = t.cal.sessions.select(F.explode(F.array(F.col("trade_date").cast("timestamp_ntz") + F.expr("interval 9 hours"), market_close_ts("trade_date"))).alias("asof_ts"))
    firsts = pit.pit_query_many(t.actions, asofs).groupBy(F.col("visible_from").alias("asof_ts")).agg(F.count(F.lit(1)).alias("n"), F.sum("cash_dividend_per_share").alias("c"))
    from pyspark.sql import Window

    order = Window.orderBy("asof_ts").rowsBetween(Window.unboundedPreceding, 0)
    stepped = asofs.join(firsts, "asof_ts", "left")
    return stepped.select("asof_ts", F.sum(F.coalesce("n", F.lit(0))).over(order).alias("visible_rows"), F.coalesce(F.sum("c").over(order), F.lit(0)).alias("cash"))


@case(
    "f3_asof_view",
    "security_id:s trade_date:d close:f6 volume:f0",
    "select security_id, trade_date, close, volume from bars where trade_date <= date '2020-03-30'",
    ("bars",),
)
def _(t):
    return pit.asof_view(t.bars, "daily_bar_raw", "2020-03-30")


@case(
    "f4_mask_future_fields",
    "security_id:s board:s is_st:s status:s is_st_available_at:t",
    """select security_id, board, case when snapshot_at <= timestamp '2019-06-28 15:00:00' then cast(is_st as varchar) end as is_st,
       case when snapshot_at <= timestamp '2019-06-28 15:00:00' then status end as status,
       case when snapshot_at <= timestamp '2019-06-28 15:00:00' then snapshot_at end as is_st_available_at
       from master where available_at <= timestamp '2019-06-28 15:00:00'""",
    ("master",),
)
def _(t):
    return pit.pit_query(t.master, "security_master", "2019-06-28 15:00:00", columns=["security_id", "board", "is_st", "status"])


@case(
    "f5_with_companions",
    "security_id:s status:s status_available_at:t status_point_in_time_capability:s status_evidence_level:s",
    f"""select security_id, case when snapshot_at <= timestamp '{END}' then status end as status, case when snapshot_at <= timestamp '{END}' then snapshot_at end as status_available_at,
       'CURRENT_SNAPSHOT_ONLY' as status_point_in_time_capability, 'EXPLORATORY_TAINTED' as status_evidence_level from master where available_at <= timestamp '{END}'""",
    ("master",),
)
def _(t):
    return pit.pit_query(t.master, "security_master", END, columns=["security_id", "status"])


@case(
    "f6_field_capabilities",
    "field:s available_at:s point_in_time_capability:s evidence_level:s",
    """select f.field, '2020-06-30 15:00:00' as available_at, 'CURRENT_SNAPSHOT_ONLY' as point_in_time_capability, 'EXPLORATORY_TAINTED' as evidence_level
       from (values ('is_st'), ('status')) f(field) where (select count(*) from master) > 0""",
    ("master",),
)
def _(t):
    return pit.field_capabilities(pit.pit_query(t.master, "security_master", END))


STAMP_TEXT = """concat(strftime(trade_date, '%Y-%m-%d'), case k % 5 when 0 then 'T15:00:00' when 1 then 'T15:00:00+00:00' when 2 then ' 15:00:00+08:00' else 'T15:00:00+08:00' end)"""


@case(
    "f7_check_exchange_stamps",
    "check:s key:s detail:s",
    f"""select 'NOT_EXCHANGE_TIMESTAMP:stamp' as "check", concat(security_id, '/', cast(trade_date as varchar)) as "key", {STAMP_TEXT} as detail
        from bars_src where k % 5 in (0, 1)""",
    ("bars_src",),
)
def _(t):
    tail = F.when(F.col("k") % 5 == 0, "T15:00:00").when(F.col("k") % 5 == 1, "T15:00:00+00:00").when(F.col("k") % 5 == 2, " 15:00:00+08:00").otherwise("T15:00:00+08:00")
    return pit.check_exchange_stamps(t.bars_src.withColumn("stamp", F.concat(F.col("trade_date").cast("string"), tail)), ["stamp"], ["security_id", "trade_date"])


RESOLVED = """
select a.*, case when disclosure_time_known is null then case when available_at is null then 'NO_DISCLOSURE_FLAG_AND_NO_AVAILABLE_AT' end
    when disclosure_time_known then case when disclosure_ts is null then 'DISCLOSURE_TS_REQUIRED' when strftime(disclosure_ts, '%H:%M:%S') = '00:00:00' then 'DISCLOSURE_TS_IS_MIDNIGHT' end
    when disclosure_date is null then 'DISCLOSURE_DATE_REQUIRED' when nxt is null then 'NO_NEXT_SESSION_AFTER_DISCLOSURE'
    when nxt + interval 570 minutes >= cast(ex_date as timestamp) then 'NOT_VERIFIABLE_BEFORE_EX_DATE' end as availability_reason,
  case when disclosure_time_known is null then available_at when disclosure_time_known then disclosure_ts else nxt + interval 570 minutes end as derived
from (select x.*, (select min(trade_date) from cal where trade_date > x.disclosure_date) as nxt from actions x) a"""


@case(
    "f8_resolve_available_at",
    "security_id:s ex_date:d action_type:s revision_id:s resolved_available_at:t availability_reason:s",
    "select security_id, ex_date, action_type, revision_id, case when availability_reason is null then derived end as resolved_available_at, availability_reason from resolved",
    ("actions", "cal"),
    (("resolved", RESOLVED),),
)
def _(t):
    return pit.resolve_available_at(t.actions, t.cal)


@case(
    "f9_materialize_available_at",
    "security_id:s ex_date:d action_type:s revision_id:s available_at:t",
    """select security_id, ex_date, action_type, revision_id,
       case when disclosure_time_known is not null then case when availability_reason is null then derived end else available_at end as available_at from resolved""",
    ("actions", "cal"),
    (("resolved", RESOLVED),),
)
def _(t):
    return pit.materialize_available_at(t.actions, t.cal)


@case(
    "f10_classify_visibility",
    "security_id:s ex_date:d action_type:s revision_id:s visibility:s visibility_reason:s",
    """with a as (select *, timestamp '2020-04-06 09:00:00' as cut from actions)
select security_id, ex_date, action_type, revision_id,
  case when available_at > cut and (ex_date < cast(cut as date) or ex_date = cast(cut as date)) then 'UNPROCESSED_BOUNDARY' when available_at > cut then 'NOT_YET_VISIBLE'
       when action_type not in ('CASH_DIVIDEND','STOCK_DIVIDEND') then 'UNSUPPORTED_TYPE' else 'VISIBLE_APPLICABLE' end as visibility,
  case when available_at > cut and ex_date <= cast(cut as date) then 'CA_AVAILABLE_AFTER_APPLICATION_ASOF' when available_at > cut then 'CA_NOT_YET_VISIBLE_AT_ASOF'
       when action_type not in ('CASH_DIVIDEND','STOCK_DIVIDEND') then concat('UNSUPPORTED_CA_TYPE:', action_type) else 'CA_VISIBLE_AND_APPLICABLE' end as visibility_reason
from a""",
    ("actions",),
)
def _(t):
    from tidemark.contracts import LEDGER_ACTION_TYPES

    return pit.classify_visibility(t.actions, "2020-04-06 09:00:00", LEDGER_ACTION_TYPES)


@case(
    "f11_visible_on_own_date",
    "security_id:s trade_date:d",
    "select security_id, trade_date from bars where available_at + to_hours(case when session_idx % 3 = 0 then 1 else 0 end) <= trade_date + interval 15 hours",
    ("bars",),
)
def _(t):
    late = calops.with_session_idx(t.bars, t.cal, "trade_date").withColumn("available_at", F.when(F.col("session_idx") % 3 == 0, F.col("available_at") + F.expr("interval 1 hour")).otherwise(F.col("available_at")))
    return pit.visible_on_own_date(late)


@case("f12_tradable_universe", "trade_date:d security_id:s", "select trade_date, security_id from bars where trade_status = '正常'", ("bars",))
def _(t):
    return pit.tradable_universe(t.bars)


@case(
    "f14_wrong_basis",
    "check:s key:s detail:s",
    """select 'BARS_NOT_RAW_UNADJUSTED' as "check", b as "key", cast(count(*) as varchar) as detail
       from (select case session_idx % 4 when 0 then 'VENDOR_ADJUSTED' when 1 then '<null>' else 'RAW_UNADJUSTED' end as b from bars) where b <> 'RAW_UNADJUSTED' group by b""",
    ("bars",),
)
def _(t):
    mixed = calops.with_session_idx(t.bars, t.cal, "trade_date").withColumn("price_basis", F.when(F.col("session_idx") % 4 == 0, "VENDOR_ADJUSTED").when(F.col("session_idx") % 4 != 1, "RAW_UNADJUSTED"))
    return pit.raw_basis_violations(mixed)


@case(
    "f17_filter_by_ex_date",
    "security_id:s ex_date:d action_type:s revision_id:s",
    "select security_id, ex_date, action_type, revision_id from actions where ex_date between date '2019-03-01' and date '2021-09-30'",
    ("actions",),
)
def _(t):
    return pit.filter_by_ex_date(t.actions, "2019-03-01", "2021-09-30")


@case(
    "f20_freeze_snapshot",
    "security_id:s trade_date:d close:f6 snapshot_id:s source_snapshot_id:s",
    """select security_id, trade_date, close, 'slice_20231231_ADJUSTMENT_ONLY' as snapshot_id, 's1' as source_snapshot_id from bars
       where security_id in (select security_id from master where board = '主板') and trade_date between date '2019-01-01' and date '2022-12-31'""",
    ("bars", "master"),
)
def _(t):
    return pit.freeze_bars(t.bars, t.master.where("board = '主板'"), "2019-01-01", "2022-12-31", "slice_20231231_ADJUSTMENT_ONLY", "ADJUSTMENT_ONLY")


@case(
    "f20_freeze_violations",
    "check:s key:s detail:s",
    """select 'MISSING_SECURITY' as "check", security_id as "key", '' as detail from master where security_id not in (select security_id from actions)
       union all select 'DUPLICATE_BAR', concat(security_id, '/', cast(trade_date as varchar)), '2' from bars where trade_status = '停牌' and security_id in (select security_id from actions)""",
    ("bars", "master", "actions"),
)
def _(t):
    bars = t.bars.join(t.actions.select("security_id").distinct(), "security_id", "left_semi")
    doubled = bars.unionByName(bars.where("trade_status = '停牌'"))
    return pit.freeze_violations(doubled, t.master, t.master)


@case(
    "f21_verify_snapshot",
    "check:s key:s detail:s",
    """select 'ROW_COUNT' as "check", cast(count(*) as varchar) as "key", '1' as detail from bars
       union all select 'SNAPSHOT_ID', 's1/s1', '' union all
       select 'DISCLOSURE_TIME_NOT_UNKNOWN', concat(security_id, '/', cast(ex_date as varchar)), '' from actions where disclosure_time_known is distinct from false
       union all select 'DUPLICATE_ACTION', concat(security_id, '/', cast(ex_date as varchar)), cast(count(*) as varchar) from actions group by security_id, ex_date having count(*) > 1""",
    ("bars", "actions"),
)
def _(t):
    return pit.verify_frozen(t.bars, "another_snapshot", 1, t.actions.drop("available_at"))


# -- J and A: actions and returns ------------------------------------------------------

NEWEST = """
select * exclude (rn) from (select *, row_number() over (partition by security_id, ex_date, action_type order by available_at desc) as rn
  from actions where available_at <= timestamp '{asof}') where rn = 1"""

INPUTS = """
select security_id, ex_date,
  sum(case when action_type <> 'RIGHTS_ISSUE' then cash_dividend_per_share else 0 end) as cash,
  sum(case when action_type <> 'RIGHTS_ISSUE' then share_ratio else 0 end) as split_ratio,
  sum(case when action_type = 'RIGHTS_ISSUE' then share_ratio else 0 end) as rights_ratio,
  sum(case when action_type = 'RIGHTS_ISSUE' then share_ratio * coalesce(rights_price_per_share, 0) else 0 end) as paid,
  string_agg(action_type, '|' order by action_type) as types,
  coalesce(min(case when action_type = 'SPIN_OFF' then 'UNSUPPORTED_CA_TYPE:SPIN_OFF' end),
    max(case when action_type = 'RIGHTS_ISSUE' and share_ratio > 0 and rights_price_per_share is null
      then 'RIGHTS_ISSUE missing rights_price/rights_price_per_share; cannot construct PIT factor' end)) as input_reason
from newest group by 1, 2"""

POINTS = """
select p.security_id, p.trade_date, p.session_idx, p.bar_no, p.open, p.close, p.previous_date, p.previous_close, i.types,
  case when p.close is null or p.previous_close is null then 'NO_DATA' when p.gap <> 1 or i.input_reason is not null then 'BLOCKED' else 'OK' end as status,
  case when p.close is null or p.previous_close is null then 'MISSING_CLOSE_OR_PREVIOUS_CLOSE' when p.gap <> 1 then 'PREVIOUS_CLOSE_NOT_ADJACENT_TRADING_DAY' else i.input_reason end as block_reason,
  (cast(p.previous_close as double) - coalesce(cast(i.cash as double), 0) + coalesce(cast(i.paid as double), 0)) / (1 + coalesce(cast(i.split_ratio as double), 0) + coalesce(cast(i.rights_ratio as double), 0)) as ref
from (select *, row_number() over w as bar_no, lag(trade_date) over w as previous_date, lag(close) over w as previous_close, session_idx - lag(session_idx) over w as gap
      from {bars} where available_at <= timestamp '{asof}' window w as (partition by security_id order by trade_date)) p
left join inputs i on i.security_id = p.security_id and i.ex_date = p.trade_date"""

HOLES = """
select distinct n.security_id, n.ex_date from newest n
join (select security_id, min(trade_date) as lo, max(trade_date) as hi from {bars} where available_at <= timestamp '{asof}' group by 1) e
  on e.security_id = n.security_id and n.ex_date between e.lo and e.hi
where not exists (select 1 from {bars} b where b.security_id = n.security_id and b.trade_date = n.ex_date and b.available_at <= timestamp '{asof}')"""


def asof_steps(asof: str = END, bars: str = "bars") -> tuple[tuple[str, str], ...]:
    fill = {"asof": asof, "bars": bars}
    return (("newest", NEWEST.format(**fill)), ("inputs", INPUTS), ("points", POINTS.format(**fill)), ("holes", HOLES.format(**fill)))


@case(
    "j1_with_previous_bar",
    "security_id:s trade_date:d previous_date:d previous_close:f6",
    "select security_id, trade_date, lag(trade_date) over w as previous_date, lag(close) over w as previous_close from bars window w as (partition by security_id order by trade_date)",
    ("bars",),
)
def _(t):
    return returns.with_previous_bar(t.bars)


@case(
    "j2_adjacent_session",
    "security_id:s trade_date:d is_adjacent:b",
    "select security_id, trade_date, coalesce(session_idx - lag(session_idx) over (partition by security_id order by trade_date) = 1, false) as is_adjacent from sparse",
    ("sparse",),
)
def _(t):
    return returns.adjacent_session(t.sparse, t.cal)


@case(
    "j5_effective_rule",
    "o_orderkey:i day:d rule:s",
    f"""select o_orderkey, day, case when day >= date '2026-07-06' then 'cn_a_share_ex_right_reference_price_2026' when day >= date '2023-02-17' then 'cn_a_share_ex_right_reference_price_2023'
       when day >= date '2013-07-29' then 'cn_a_share_ex_right_reference_price_2013' when day >= date '2011-02-28' then 'cn_a_share_ex_right_reference_price_2011' end as rule from ({ORDER_DAYS})""",
)
def _(t):
    return _order_days(t).withColumn("rule", effective_rule("day", REFERENCE_PRICE_RULES))


@case(
    "j6_actions_on_ex_date",
    "security_id:s trade_date:d cash:f6 split_ratio:f6 rights_ratio:f6 types:s",
    f"select b.security_id, b.trade_date, i.cash, i.split_ratio, i.rights_ratio, i.types from bars b left join inputs i on i.security_id = b.security_id and i.ex_date = b.trade_date",
    ("bars", "actions"),
    asof_steps(ASOF)[:2],
)
def _(t):
    return act.actions_on_ex_date(t.bars, t.actions, ASOF).withColumn("types", F.array_join("action_types", "|"))


WINDOWS = "select security_id, cast(y as date) as start_date, cast(y + interval 2 years as date) as end_date from (select distinct security_id, date_trunc('year', trade_date) as y from sparse)"


@case(
    "j7_windows_with_missing_ex_date",
    "security_id:s start_date:d end_date:d first_missing_ex_date:d",
    f"""select e.security_id, e.start_date, e.end_date, min(n.ex_date) as first_missing_ex_date
from (select w.security_id, w.start_date, w.end_date, min(s.trade_date) as lo, max(s.trade_date) as hi from ({WINDOWS}) w
      join sparse s on s.security_id = w.security_id and s.trade_date between w.start_date and w.end_date group by 1, 2, 3) e
join actions n on n.security_id = e.security_id and n.ex_date between e.lo and e.hi
where not exists (select 1 from sparse b where b.security_id = n.security_id and b.trade_date = n.ex_date) group by 1, 2, 3""",
    ("sparse", "actions"),
)
def _(t):
    years = t.sparse.select("security_id", F.trunc("trade_date", "YEAR").alias("start_date")).distinct()
    return act.windows_with_missing_ex_date(t.actions, t.sparse, years.withColumn("end_date", F.add_months("start_date", 24)))


@case(
    "a1_reference_price",
    "security_id:s ex_date:d reference_price:f10",
    """select security_id, ex_date, (10 - cast(cash as double) + cast(paid as double)) / (1 + cast(split_ratio as double) + cast(rights_ratio as double)) as reference_price from inputs""",
    ("actions",),
    asof_steps(END)[:2],
)
def _(t):
    inputs = act.visible_inputs(t.actions, END)
    price = reference_price("ex_date", F.lit("10").cast("decimal(18,6)"), F.col("cash"), F.col("split_ratio"), F.col("rights_ratio"), F.col("rights_price"))
    return inputs.withColumn("reference_price", price)


@case(
    "a2_rights_terms",
    "security_id:s ex_date:d revision_id:s rights_terms_ratio:f6 rights_terms_price:f6 rights_reason:s",
    """select security_id, ex_date, revision_id, share_ratio as rights_terms_ratio, rights_price_per_share as rights_terms_price,
       case when rights_price_per_share is null then 'RIGHTS_ISSUE missing rights_price/rights_price_per_share; cannot construct PIT factor' end as rights_reason
       from actions where action_type = 'RIGHTS_ISSUE'""",
    ("actions",),
)
def _(t):
    return act.with_rights_terms(t.actions).where("action_type = 'RIGHTS_ISSUE'")


@case(
    "a3_pricing_inputs",
    "security_id:s ex_date:d cash:f6 split_ratio:f6 rights_ratio:f6 paid:f6 types:s input_reason:s",
    "select * from inputs",
    ("actions",),
    asof_steps(END)[:2],
)
def _(t):
    return act.visible_inputs(t.actions, END).withColumn("types", F.array_join("action_types", "|")).withColumn("paid", F.col("rights_consideration"))


@case(
    "a3_pricing_inputs_deduction",
    "security_id:s ex_date:d cash:f6 split_ratio:f6 rights_ratio:f6",
    """select security_id, ex_date, case when max(case when action_type in ('CASH_DIVIDEND','STOCK_DIVIDEND') and ex_right_cash_deduction_per_share is not null then 1 else 0 end) = 1
         then cast(sum(case when action_type in ('CASH_DIVIDEND','STOCK_DIVIDEND') then coalesce(ex_right_cash_deduction_per_share, cash_dividend_per_share) else 0 end) as double)
         else cast(round(sum(case when action_type in ('CASH_DIVIDEND','STOCK_DIVIDEND') then cash_dividend_per_share else 0 end), 2) as double) end as cash,
       sum(case when action_type in ('CASH_DIVIDEND','STOCK_DIVIDEND') then share_ratio else 0 end) as split_ratio,
       sum(case when action_type = 'RIGHTS_ISSUE' then share_ratio else 0 end) as rights_ratio from newest group by 1, 2""",
    ("actions",),
    asof_steps(END)[:1],
)
def _(t):
    return act.visible_inputs(t.actions, END, "deduction")


DAILY_COLUMNS = "security_id:s trade_date:d status:s block_reason:s reference_price:f10 adjusted_return:f10 types:s"


def _daily_sql(low: str = "2000-01-01", high: str = "2099-01-01") -> str:
    return f"""
select p.security_id, p.trade_date, case when h.security_id is not null then 'BLOCKED' else p.status end as status,
  case when h.security_id is not null then 'CA_EX_DATE_ON_MISSING_BAR_DATE' when p.status <> 'OK' then p.block_reason end as block_reason,
  case when h.security_id is null and p.status = 'OK' then p.ref end as reference_price,
  case when h.security_id is null and p.status = 'OK' then cast(p.close as double) / p.ref - 1 end as adjusted_return,
  case when h.security_id is null then p.types end as types
from points p left join (select distinct security_id from holes) h on h.security_id = p.security_id
where p.trade_date between date '{low}' and date '{high}'"""


@case("a4_daily_adjusted_returns", DAILY_COLUMNS, _daily_sql(), ("bars", "actions"), asof_steps(ASOF))
def _(t):
    return returns.daily_adjusted_returns(t.bars, t.actions, t.cal, ASOF).withColumn("types", F.array_join("action_types", "|"))


@case("a4_daily_adjusted_returns_sparse", DAILY_COLUMNS, _daily_sql(), ("sparse", "actions"), asof_steps(END, "sparse"))
def _(t):
    return returns.daily_adjusted_returns(t.sparse, t.actions, t.cal, END).withColumn("types", F.array_join("action_types", "|"))


@case(
    "a5_applied_events",
    "security_id:s events:s",
    f"""select security_id, string_agg(concat(cast(ex_date as varchar), ':', action_type, ':', source_id), ';' order by ex_date, action_type) as events
        from newest where action_type in ('CASH_DIVIDEND','STOCK_DIVIDEND','RIGHTS_ISSUE') and ex_date <= date '{ASOF[:10]}' group by 1""",
    ("actions",),
    asof_steps(ASOF)[:1],
)
def _(t):
    events = act.applied_events(t.actions, ASOF)
    text = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["ex_date"].cast("string"), e["action_type"], e["source_id"])), ";")
    return events.select("security_id", text.alias("events"))


def _lookback_sql(n: int) -> str:
    return f"""
with w as (select p.*, case when bar_no >= {n} then bar_no - {n - 1} else 1 end as start_no from points p),
j as (select w.security_id, w.trade_date, w.bar_no, q.bar_no as qn, q.status as qs, q.block_reason as qr, case when q.status = 'OK' then cast(q.close as double)/q.ref else 1.0 end as g, w.start_no
      from w join points q on q.security_id = w.security_id and q.bar_no between w.start_no and w.bar_no),
f as (select j.security_id, j.trade_date, j.bar_no, min(j.start_no) as start_no, min(case when qs='BLOCKED' then qn end) as nb, arg_min(qr, qn) filter (qs='BLOCKED') as rb,
        min(case when qs='NO_DATA' then qn end) as nn, arg_min(qr, qn) filter (qs='NO_DATA') as rn, product(g) as g from j group by 1,2,3),
h as (select f.security_id, f.trade_date, count(*) as n from f join points a on a.security_id=f.security_id and a.bar_no=f.start_no
      join holes x on x.security_id=f.security_id and x.ex_date between a.trade_date and f.trade_date group by 1,2)
select f.security_id, f.trade_date, case when h.n > 0 or nb is not null then 'BLOCKED' when nn is not null then 'NO_DATA' else 'OK' end as status,
  case when h.n > 0 then 'CA_EX_DATE_ON_MISSING_BAR_DATE' when nb is not null then rb when nn is not null then rn end as block_reason,
  case when h.n is null and nb is null and nn is null then g - 1 end as cumulative_return
from f left join h on h.security_id=f.security_id and h.trade_date=f.trade_date"""


CUMULATIVE_COLUMNS = "security_id:s trade_date:d status:s block_reason:s cumulative_return:f8"


@case("a6_cumulative_return", CUMULATIVE_COLUMNS, _lookback_sql(13), ("bars", "actions"), asof_steps(END))
def _(t):
    return returns.cumulative_return(t.bars, t.actions, t.cal, END, 13)


@case("a6_cumulative_return_sparse", CUMULATIVE_COLUMNS, _lookback_sql(26), ("sparse", "actions"), asof_steps(END, "sparse"))
def _(t):
    return returns.cumulative_return(t.sparse, t.actions, t.cal, END, 26)


@case(
    "a7_factor_series",
    "security_id:s trade_date:d status:s factor:f6 factor_break:f8",
    f"""with d as ({_daily_sql()}),
g as (select *, sum(case when status = 'OK' then 0 else 1 end) over (partition by security_id order by trade_date rows unbounded preceding) as seg from d)
select security_id, trade_date, status,
  case when status = 'OK' then product(case when status='OK' then 1 + adjusted_return end) over (partition by security_id order by trade_date rows unbounded preceding) end as factor,
  case when status = 'OK' then product(case when status='OK' then 1 + adjusted_return end) over (partition by security_id, seg order by trade_date rows unbounded preceding) end as factor_break
from g""",
    ("bars", "actions"),
    asof_steps(END),
)
def _(t):
    daily = returns.daily_adjusted_returns(t.bars, t.actions, t.cal, END)
    plain = returns.adjustment_factor(daily)
    return returns.adjustment_factor(plain.withColumnRenamed("factor", "f0"), break_on_gap=True).withColumnsRenamed({"factor": "factor_break", "f0": "factor"})


@case(
    "a22_status_diagnostics",
    "level:s status:s block_reason:s security_id:s points:i",
    f"""with d as ({_daily_sql()})
select 'status' as level, status, null as block_reason, null as security_id, count(*) as points from d group by status
union all select 'reason', status, block_reason, null, count(*) from d where block_reason is not null group by status, block_reason
union all select 'security', status, null, security_id, count(*) from d group by status, security_id""",
    ("sparse", "actions"),
    asof_steps(END, "sparse"),
)
def _(t):
    return status_diagnostics(returns.daily_adjusted_returns(t.sparse, t.actions, t.cal, END))


@case(
    "a22_blocked_rate",
    "points:i blocked:i blocked_rate:f8 within_limit:b",
    f"""with d as ({_daily_sql()}) select count(*) as points, count(*) filter (status = 'BLOCKED') as blocked, (count(*) filter (status = 'BLOCKED'))/count(*) as blocked_rate,
       (count(*) filter (status = 'BLOCKED'))/count(*) <= 0.05 as within_limit from d""",
    ("bars", "actions"),
    asof_steps(END),
)
def _(t):
    return blocked_rate(returns.daily_adjusted_returns(t.bars, t.actions, t.cal, END))


@case(
    "w3_close_jumps",
    "security_id:s jumps:i",
    """select security_id, count(*) filter (abs(cast(close as double)/p - 1) > 0.05) as jumps from
       (select *, cast(lag(close) over (partition by security_id order by trade_date) as double) as p from bars) group by 1""",
    ("bars",),
)
def _(t):
    from tidemark.operators.quality import close_jumps

    return close_jumps(t.bars, 0.05)


@case(
    "w5_latest_revision",
    "security_id:s ex_date:d action_type:s cash_dividend_per_share:f6 available_at:t revision_id:s",
    "select security_id, ex_date, action_type, cash_dividend_per_share, available_at, revision_id from newest",
    ("actions",),
    asof_steps(END)[:1],
)
def _(t):
    return pit.latest_revision(t.actions.where(F.col("available_at") <= F.lit(END).cast("timestamp_ntz")))


@case(
    "w5_revision_conflicts",
    "check:s key:s",
    """select 'CONFLICTING_REVISIONS' as "check", concat_ws('/', security_id, cast(ex_date as varchar), action_type, cast(available_at as varchar)) as "key" from actions where revision_id = 'r2'""",
    ("actions",),
)
def _(t):
    clash = t.actions.where("revision_id = 'r2'").withColumn("cash_dividend_per_share", F.col("cash_dividend_per_share") + 1)
    return pit.revision_conflicts(t.actions.unionByName(clash))
