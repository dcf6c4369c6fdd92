"""Market tables derived from the given test tables.

Every view reads its whole source tables and grows with them: companies follow the
number of suppliers, portfolios the number of parts, sessions are weeks shifted to
2017-2023 so that the dated fee, limit and pricing rules are crossed. The SQL is the
common subset of Spark and DuckDB; ``{S}`` is the string type of the dialect.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import board_from_id, market_close_ts
from tidemark.operators.calendar import SessionCalendar, densify_bars
from tidemark.operators.returns import Timeline, prepare_timeline
from tidemark.staging import stage

BASE_TABLES = ("lineitem", "orders", "supplier", "customer", "part", "events", "documents", "pages", "nation", "labels", "conversations")


def _security(k: str) -> str:
    tail = f"cast(cast(floor({k} / 4) as bigint) as {{S}})"
    return (
        f"concat(case {k} % 4 when 0 then '600' when 1 then '300' when 2 then '688' else '830' end, "
        f"case when length({tail}) < 3 then lpad({tail}, 3, '0') else {tail} end)"
    )


WEEK = "cast(cast(date_trunc('week', {c}) as date) + interval 8036 days as date)"

SOURCES = {
    "bars_src": f"""
with g as (
  select cast(floor(l_suppkey / 5) as bigint) as k,
         {WEEK.format(c='l_shipdate')} as trade_date,
         count(*) as n,
         sum(cast(round(l_discount*100) as bigint)) as d,
         sum(cast(round(l_tax*100) as bigint)) as t,
         sum(cast(l_quantity as bigint)) as q
  from lineitem group by 1, 2),
p as (
  select k, trade_date, n, q,
    cast(1000 + cast(floor(cast(20*d as double)/n) as bigint) as decimal(18,6))/100 as o,
    case when (q + n) % 199 = 0 then null
         else cast(1000 + cast(floor(cast(20*t as double)/n) as bigint) as decimal(18,6))/100 end as c
  from g)
select {_security('k')} as security_id, k, trade_date,
  cast(o as decimal(18,6)) as open,
  cast(case when c is null then null else greatest(o, c) + 0.05 end as decimal(18,6)) as high,
  cast(case when c is null then null else least(o, c) - 0.05 end as decimal(18,6)) as low,
  cast(c as decimal(18,6)) as close,
  case when q % 37 = 0 then 0 else q*100 end as volume,
  cast(case when c is null then null when q % 37 = 0 then 0 else q*50*(o + c) end as decimal(24,4)) as amount
from p
""",
    "actions_src": f"""
with w as (
  select cast(floor(o_custkey / 75) as bigint) as k, o_custkey, o_orderkey, cast(date_trunc('week', o_orderdate) as date) as wk from orders),
q as (
  select k, date_trunc('quarter', wk) as qtr, count(*) as n, sum(o_custkey) as s, max(o_orderkey) as mk, max_by(wk, o_orderkey) as wk
  from w group by 1, 2),
a as (
  select {_security('k')} as security_id, cast(wk + interval 8036 days as date) as ex_date, n, s, mk,
    case when n % 29 = 0 then 'SPIN_OFF' when mk % 5 in (0, 1) then 'CASH_DIVIDEND' when mk % 5 in (2, 3) then 'STOCK_DIVIDEND' else 'RIGHTS_ISSUE' end as action_type,
    cast(floor(mk / 97) as bigint) % 12 - 1 as lead_days
  from q)
select security_id, ex_date, action_type, n, s, mk, lead_days,
  cast(cast(case when action_type = 'RIGHTS_ISSUE' then 0 else s % 50 + 1 end as decimal(18,6))/100 as decimal(18,6)) as cash,
  cast(cast(case action_type when 'STOCK_DIVIDEND' then s % 5 + 1 when 'RIGHTS_ISSUE' then s % 3 + 1 else 0 end as decimal(18,6))/10 as decimal(18,6)) as ratio,
  case when action_type = 'RIGHTS_ISSUE' and mk % 7 <> 0 then 800 end as rights_cents
from a
""",
    "intents_src": f"""
with l as (
  select cast(floor(l_partkey / 100) as bigint) as portfolio_id, cast(floor(l_suppkey / 5) as bigint) as k,
    {WEEK.format(c='l_shipdate')} as decision_date,
    case when l_returnflag = 'A' then 'sell' else 'buy' end as side, cast(l_quantity as bigint) as q
  from lineitem)
select portfolio_id, {_security('k')} as security_id, decision_date, side, sum(q)*37 as quantity
from l group by portfolio_id, k, decision_date, side
""",
    "trades_src": f"""
with l as (
  select cast(floor(l_partkey / 100) as bigint) as portfolio_id, cast(floor(l_suppkey / 5) as bigint) as k,
    {WEEK.format(c='l_shipdate')} as d, l_returnflag as flag, cast(l_quantity as bigint) as q
  from lineitem),
b as (
  select portfolio_id, k, d as execution_date, 'buy' as side, sum(q)*100 as quantity from l group by portfolio_id, k, d
  union all
  select portfolio_id, k, cast(d + interval 21 days as date) as execution_date, 'sell' as side, cast(floor(sum(q)/2.0) as bigint)*100 as quantity
  from l where flag = 'A' and d <= (select cast(max(d) - interval 21 days as date) from l) group by portfolio_id, k, d)
select portfolio_id, {_security('k')} as security_id, execution_date, side, cast(quantity as bigint) as quantity,
  cast(cast(1000 + (cast(quantity / 100 as bigint) * 7 + portfolio_id * 13 + k * 31) % 200 as decimal(18,6))/100 as decimal(18,6)) as price
from b where quantity > 0
""",
    "membership_src": f"""
with o as (
  select o_orderkey as ok, o_custkey as ck, cast(floor(o_custkey / 75) as bigint) as k, {WEEK.format(c='o_orderdate')} as wk from orders)
select concat('IDX', cast(ok % 4 as {{S}})) as index_id, {_security('k')} as security_id, wk as effective_from,
  case when ok % 5 = 0 then null else cast(ck % 40 * 7 + 7 as int) end as days, ok % 6 <> 1 as is_member,
  cast(ck % 150 as int) - 60 as lag_days, lpad(cast(ok as {{S}}), 12, '0') as revision_id
from o
""",
    "releases_src": f"""
with o as (
  select o_orderkey as ok, o_custkey as ck, o_totalprice as price, cast(floor(o_custkey / 75) as bigint) as k, {WEEK.format(c='o_orderdate')} as wk from orders)
select {_security('k')} as security_id, concat('M', cast(ok % 3 as {{S}})) as metric_name, ok as filing_version,
  cast(date_trunc('quarter', wk) as date) as quarter_start, cast(1 + (ck * 7 + ok) % 220 as int) as lag_days,
  cast(cast(floor(price) as bigint) - 20000 as decimal(18,6)) as metric_value
from o
""",
    "announcements_src": f"""
select event_id, {_security('k')} as security_id,
  case event_type when 'click' then '2023年年度权益分派实施公告' when 'view' then '关于现金红利派发的公告' when 'purchase' then '利润分配预案的公告'
    when 'error' then '权益分派实施公告的更正公告' else '关于召开股东大会的通知' end as title_kind,
  event_type, value, epoch_ms, concat('finalpage/', cast(event_id as {{S}}), '.PDF') as adjunct_url
from (
  select event_id, event_type, value, cast(floor(user_id / 10) as bigint) as k,
    cast({{EPOCH_MS}} as bigint) as epoch_ms
  from events) e
""",
}


def source_sql(name: str, dialect: str) -> str:
    gap = "(ts - timestamp_ntz'1970-01-01 00:00:00')"
    spark_ms = f"floor((extract(day from {gap}) * 86400 + extract(hour from {gap}) * 3600 + extract(minute from {gap}) * 60 + extract(second from {gap})) * 1000)"
    epoch = {"spark": spark_ms, "duckdb": "floor(epoch_us(ts) / 1000.0)"}[dialect]
    text = SOURCES[name].replace("{S}", {"spark": "string", "duckdb": "varchar"}[dialect]).replace("{EPOCH_MS}", epoch)
    return text.strip()


# Oracle-side definitions of the contract tables, written independently of the operators.
ORACLE_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "cal": (("bars_src",), "select trade_date, row_number() over (order by trade_date) - 1 as session_idx from (select distinct trade_date from bars_src)"),
    "bars": (
        ("bars_src", "cal"),
        """
select s.security_id, s.k, c.trade_date, c.session_idx, b.open, b.high, b.low, b.close, b.volume, b.amount,
  case when b.close is not null and coalesce(b.volume, -1) = 0 then '停牌' when b.close is not null then '正常'
       when c.trade_date between s.first_date and s.last_date then '停牌' else '缺失' end as trade_status,
  c.trade_date + interval 15 hours as available_at
from (select security_id, k, min(trade_date) as first_date, max(trade_date) as last_date from bars_src group by 1, 2) s
cross join cal c left join bars_src b on b.security_id = s.security_id and b.trade_date = c.trade_date
""",
    ),
    "sparse": (("bars",), "select * from bars where close is not null"),
    "actions": (
        ("actions_src",),
        """
with b as (
  select security_id, ex_date, action_type, cash, ratio, rights_cents, s, mk, n,
    case when n % 11 = 0 then null else cast(ex_date - to_days(cast(lead_days as integer)) as date) end as announcement_date from actions_src),
v as (
  select *, coalesce(announcement_date, ex_date) + interval 15 hours as available_at, 'r1' as revision_id from b
  union all
  select security_id, ex_date, action_type, case when cash > 0 then cash + 0.01 else cash end, ratio, rights_cents, s, mk, n, announcement_date,
    coalesce(announcement_date, ex_date) + interval 39 hours, 'r2' from b where mk % 4 = 0
  union all
  select security_id, ex_date, 'CASH_DIVIDEND', cast(0.05 as decimal(18,6)), cast(0 as decimal(18,6)), null, s, mk, n, announcement_date,
    coalesce(announcement_date, ex_date) + interval 15 hours, 'r1' from b where action_type = 'STOCK_DIVIDEND' and mk % 6 = 0)
select security_id, ex_date, action_type, cast(cash as decimal(18,6)) as cash_dividend_per_share, cast(ratio as decimal(18,6)) as share_ratio,
  case when action_type = 'RIGHTS_ISSUE' then cast(rights_cents as decimal(18,6))/100 end as rights_price_per_share,
  case when s % 3 = 0 and action_type <> 'RIGHTS_ISSUE' then cast(cash*9/10 as decimal(18,6)) end as ex_right_cash_deduction_per_share,
  announcement_date, cast(ex_date - to_days(1) as date) as record_date, available_at, revision_id,
  case when mk % 2 = 0 then 'em' else 'cninfo' end as source_id, 's1' as snapshot_id,
  case n % 3 when 0 then null when 1 then true else false end as disclosure_time_known,
  case when n % 3 = 2 then cast(ex_date - to_days(14) as date) end as disclosure_date,
  case when n % 3 = 1 then ex_date - to_days(3) + interval 18 hours end as disclosure_ts
from v
""",
    ),
    "membership": (
        ("membership_src",),
        """
select index_id, security_id, effective_from, cast(effective_from + days as date) as effective_to, is_member,
  cast(effective_from + lag_days as date) + interval 15 hours as available_at, revision_id
from membership_src
""",
    ),
    "releases": (
        ("releases_src",),
        """
select security_id, metric_name, filing_version, metric_value, cast(quarter_start + interval 3 months - interval 1 day as date) as report_period_end,
  cast(quarter_start + interval 3 months as date) + to_days(lag_days) + interval 15 hours as available_at
from releases_src
""",
    ),
    "master": (
        ("bars_src",),
        """
select security_id, case substr(security_id, 1, 3) when '688' then '科创板' when '300' then '创业板' when '830' then '北交所' else '主板' end as board,
  cast(min(trade_date) + to_days(cast(min(k) % 3 * 7 as integer)) as date) as list_date,
  cast(min(trade_date) + to_days(cast(min(k) % 3 * 7 as integer)) as date) + interval 15 hours as available_at,
  min(k) % 6 = 0 as is_st, case when min(k) % 7 = 0 then '停牌' else '正常' end as status,
  timestamp '2020-06-30 15:00:00' as snapshot_at
from bars_src group by 1
""",
    ),
}


def oracle_ctes(names: tuple[str, ...]) -> str:
    """``with`` clause holding the named views and everything they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        if name in ORACLE_VIEWS:
            for parent in ORACLE_VIEWS[name][0]:
                visit(parent)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        body = source_sql(name, "duckdb") if name in SOURCES else ORACLE_VIEWS[name][1].strip()
        parts.append(f"{name} as materialized ({body})")
    return ",\n".join(parts)


# Landed tables and shared intermediates, built once per session and folder.
_SHARED: dict[tuple[str, str, str], object] = {}


def forget_shared() -> None:
    """Drop the shared tables, so that the next query pays for building them."""
    _SHARED.clear()


class Tables:
    """Spark-side views over one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def source(self, name: str) -> DataFrame:
        text = source_sql(name, "spark")
        frames = {t: self.base(t) for t in BASE_TABLES if f"from {t}" in text or f"join {t}" in text}
        for table in frames:
            text = text.replace(f"from {table}", f"from {{{table}}}").replace(f"join {table}", f"join {{{table}}}")
        return self.spark.sql(text, **frames)

    @cached_property
    def bars_src(self) -> DataFrame:
        return self.source("bars_src")

    def shared(self, name: str, build):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _SHARED:
            _SHARED[key] = build()
        return _SHARED[key]

    def has(self, name: str) -> bool:
        return (self.spark.sparkContext.applicationId, self.sf_dir, name) in _SHARED

    def landed(self, name: str, build) -> DataFrame:
        return self.shared(name, lambda: stage(build(), name))

    @property
    def cal(self) -> SessionCalendar:
        """Read once per session and folder: its few hundred dates are a parameter of every plan."""

        def read() -> SessionCalendar:
            week = F.date_add(F.to_date(F.date_trunc("week", "l_shipdate")), 8036)
            return SessionCalendar.from_table(self.base("lineitem").select(week.alias("trade_date")))

        return self.shared("calendar", read)

    @property
    def bars(self) -> DataFrame:
        return self.landed("daily_bar_raw", lambda: densify_bars(self.bars_src.drop("k"), self.cal).repartition("security_id").sortWithinPartitions("security_id", "trade_date"))

    @property
    def sparse(self) -> DataFrame:
        return self.bars.where(F.col("close").isNotNull())

    @property
    def ids(self) -> DataFrame:
        return self.landed("universe", lambda: self.bars.select("security_id").distinct())

    @property
    def actions(self) -> DataFrame:
        return self.landed("corporate_actions", self._actions)

    def _actions(self) -> DataFrame:
        src = self.source("actions_src")
        announced = F.when(F.col("n") % 11 != 0, F.date_sub("ex_date", F.col("lead_days").cast("int")))
        base = src.withColumn("announcement_date", announced).withColumn("_day", F.coalesce("announcement_date", "ex_date"))
        zero = F.lit(0).cast("decimal(18,6)")
        first = base.withColumn("available_at", market_close_ts("_day")).withColumn("revision_id", F.lit("r1"))
        second = (
            base.where(F.col("mk") % 4 == 0)
            .withColumn("cash", F.when(F.col("cash") > 0, F.col("cash") + F.lit("0.01").cast("decimal(18,6)")).otherwise(F.col("cash")))
            .withColumn("available_at", market_close_ts(F.date_add("_day", 1)))
            .withColumn("revision_id", F.lit("r2"))
        )
        extra = (
            first.where((F.col("action_type") == "STOCK_DIVIDEND") & (F.col("mk") % 6 == 0))
            .withColumn("action_type", F.lit("CASH_DIVIDEND"))
            .withColumn("cash", F.lit("0.05").cast("decimal(18,6)"))
            .withColumn("ratio", zero)
            .withColumn("rights_cents", F.lit(None).cast("int"))
        )
        rows = first.unionByName(second).unionByName(extra)
        rights = F.col("action_type") == "RIGHTS_ISSUE"
        return rows.select(
            "security_id",
            "ex_date",
            "action_type",
            F.col("cash").cast("decimal(18,6)").alias("cash_dividend_per_share"),
            F.col("ratio").cast("decimal(18,6)").alias("share_ratio"),
            F.when(rights, (F.col("rights_cents").cast("decimal(18,6)") / 100).cast("decimal(18,6)")).alias("rights_price_per_share"),
            F.when((F.col("s") % 3 == 0) & ~rights, (F.col("cash") * 9 / 10).cast("decimal(18,6)")).alias("ex_right_cash_deduction_per_share"),
            "announcement_date",
            F.date_sub("ex_date", 1).alias("record_date"),
            "available_at",
            "revision_id",
            F.when(F.col("mk") % 2 == 0, "em").otherwise("cninfo").alias("source_id"),
            F.lit("s1").alias("snapshot_id"),
            F.when(F.col("n") % 3 == 1, True).when(F.col("n") % 3 == 2, False).alias("disclosure_time_known"),
            F.when(F.col("n") % 3 == 2, F.date_sub("ex_date", 14)).alias("disclosure_date"),
            F.when(F.col("n") % 3 == 1, F.date_sub("ex_date", 3).cast("timestamp_ntz") + F.expr("interval 18 hours")).alias("disclosure_ts"),
        )

    @property
    def timeline(self) -> Timeline:
        return self.shared("timeline", lambda: prepare_timeline(self.bars, self.actions, self.cal, self.ids))

    @property
    def master(self) -> DataFrame:
        return self.landed("security_master", self._master)

    def _master(self) -> DataFrame:
        agg = self.bars_src.groupBy("security_id").agg(F.min("trade_date").alias("_d"), F.min("k").alias("_k"))
        listed = F.date_add("_d", (F.col("_k") % 3 * 7).cast("int"))
        snap = F.lit("2020-06-30 15:00:00").cast("timestamp_ntz")
        out = agg.select("security_id", board_from_id("security_id").alias("board"), listed.alias("list_date"), market_close_ts(listed).alias("available_at"), (F.col("_k") % 6 == 0).alias("is_st"), F.when(F.col("_k") % 7 == 0, "停牌").otherwise("正常").alias("status"))
        for name in ("is_st", "status"):
            out = out.withColumns(
                {
                    f"{name}_available_at": snap,
                    f"{name}_as_of": snap,
                    f"{name}_point_in_time_capability": F.lit("CURRENT_SNAPSHOT_ONLY"),
                    f"{name}_evidence_level": F.lit("EXPLORATORY_TAINTED"),
                }
            )
        return out.withColumn("snapshot_id", F.lit("s1"))

    @cached_property
    def intents(self) -> DataFrame:
        return self.source("intents_src")

    @cached_property
    def trades(self) -> DataFrame:
        return self.source("trades_src")

    @cached_property
    def announcements(self) -> DataFrame:
        return self.source("announcements_src")

    @property
    def membership(self) -> DataFrame:
        return self.landed("index_membership", self._membership)

    def _membership(self) -> DataFrame:
        src = self.source("membership_src")
        return src.select("index_id", "security_id", "effective_from", F.date_add("effective_from", F.col("days")).alias("effective_to"), "is_member", market_close_ts(F.date_add("effective_from", F.col("lag_days"))).alias("available_at"), "revision_id")

    @property
    def releases(self) -> DataFrame:
        return self.landed("fundamental_releases", self._releases)

    def _releases(self) -> DataFrame:
        src = self.source("releases_src").withColumn("_next", F.add_months("quarter_start", 3))
        return src.select("security_id", "metric_name", "filing_version", "metric_value", F.date_sub("_next", 1).alias("report_period_end"), market_close_ts(F.date_add("_next", F.col("lag_days"))).alias("available_at"))

    def dates(self, first: int, last: int, step: int = 1) -> list[dt.date]:
        """Sessions by position; negative counts from the end, like a slice."""
        return list(self.cal.dates[first:last:step])
