"""Landing queries: vendor frames, builders, sources, sinks, quality and build statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.contracts import union_all
from tidemark.functions import scalars as sc
from tidemark.operators import calendar as calops
from tidemark.operators import evaluation as ev
from tidemark.operators import quality as q
from tidemark.operators import returns
from tidemark.operators.actions import visible_inputs
from tidemark.operators.orders import EXECUTION
from tidemark.plans.build import build_bars
from tidemark.sources import builders as bld
from tidemark.sources import readers, vendor, writers
from tidemark.staging import checkpoint_root
from workload import research, trading
from workload.cases import CASES, case
from workload.market import END, asof_steps

SNAPSHOT = "20230630_landed"


def _scratch(t, name: str) -> str:
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


# -- P: vendor frames ---------------------------------------------------------------------

RAW_BARS = """
select concat('sh', case cast(floor(l_suppkey / 5) as bigint) % 2 when 0 then '600' else '300' end, lpad(cast(cast(floor(l_suppkey / 5) as bigint) % 1000 as varchar), 3, '0')) as code,
  cast(cast(date_trunc('week', l_shipdate) as date) + interval 8036 days as date) as trade_date,
  round(l_discount * 100) as o, round(l_tax * 100) as c, cast(l_quantity as bigint) as v, l_returnflag as f, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as seq, l_extendedprice as amt from lineitem"""


def _raw_bars(t):
    k = F.floor(F.col("l_suppkey") / 5)
    code = F.concat(F.lit("sh"), F.when(k % 2 == 0, "600").otherwise("300"), F.lpad((k % 1000).cast("string"), 3, "0"))
    return t.base("lineitem").select(
        code.alias("股票代码"),
        F.date_add(F.to_date(F.date_trunc("week", "l_shipdate")), 8036).cast("string").alias("日期"),
        F.round(F.col("l_discount") * 100).cast("int").cast("string").alias("开盘"),
        F.lit("-").alias("最高"),
        F.lit("1").alias("最低"),
        F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.round(F.col("l_tax") * 100).cast("int").cast("string")).alias("收盘"),
        F.col("l_quantity").cast("bigint").cast("string").alias("成交量"),
        F.col("l_extendedprice").cast("decimal(24,2)").cast("string").alias("成交额"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"),
    )


VENDOR_SQL = f"""
select substr(code, 3) as security_id, trade_date, o as open, cast(null as double) as high, case when f = 'R' then null else c end as close, v as volume, round(amt, 2) as amount
from (select *, row_number() over (partition by code, trade_date order by seq desc) as rn from ({RAW_BARS})) where rn = 1"""
BAR_COLUMNS = "security_id:s trade_date:d open:f4 high:f4 close:f4 volume:i amount:f2"


@case("p1_normalize_vendor_bars", BAR_COLUMNS, VENDOR_SQL)
def _(t):
    return vendor.normalize_vendor_bars(_raw_bars(t))


@case("p2_normalize_sina_bars", BAR_COLUMNS, VENDOR_SQL)
def _(t):
    raw = _raw_bars(t).withColumnsRenamed({"日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount"})
    return vendor.normalize_sina_bars(raw, F.substring("股票代码", 3, 6))


@case(
    "p3_extract_codes",
    "code:s",
    "select distinct lpad(cast(o_custkey as varchar), 6, '0') as code from orders",
)
def _(t):
    rows = t.base("orders").select(F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("证券代码"), F.col("o_orderstatus").alias("简称"), F.lit("600000").alias("代码"))
    return vendor.extract_codes(rows, ["代码", "证券代码", "简称"])


# Raw vendor action: per-10-share amounts taken from each order.
ACTION_SQL = """
select lpad(cast(cast(floor(o_custkey / 75) as bigint) as varchar), 6, '0') as security_id, case when o_orderkey % 10 = 0 then null else cast(o_orderdate as date) end as ex_date, o_orderkey,
  case when o_custkey % 4 = 0 then 0.0 else (o_custkey % 30) / 10.0 end as cash10, case when o_orderkey % 3 = 0 then (o_custkey % 5) else 0 end as sent, case when o_orderkey % 6 = 0 then 2 else 0 end as moved from orders"""
ACTION_COLUMNS = "security_id:s ex_date:d action_type:s cash_dividend_per_share:f6 share_ratio:f6 announcement_date:d source_id:s"


def _action_sql(source: str) -> str:
    return f"""select security_id, ex_date, case when sent + moved > 0 then 'STOCK_DIVIDEND' when cash10 > 0 then 'CASH_DIVIDEND' else 'OTHER' end as action_type, round(cash10 / 10, 6) as cash_dividend_per_share, (sent + moved) / 10.0 as share_ratio,
      ex_date as announcement_date, '{source}' as source_id from ({ACTION_SQL}) where cash10 > 0 or sent + moved > 0"""


def _raw_actions(t, names: dict[str, str]):
    day = F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate").cast("string"))
    cash = F.when(F.col("o_custkey") % 4 == 0, F.lit("--")).otherwise(((F.col("o_custkey") % 30).cast("decimal(9,1)") / 10).cast("decimal(9,1)").cast("string"))
    sent = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") % 5).cast("string"))
    moved = F.when(F.col("o_orderkey") % 6 == 0, F.lit("2"))
    raw = {"ex": day, "cash": cash, "sent": sent, "moved": moved, "announced": day, "record": day}
    columns = [raw[key].alias(label) for key, label in names.items()]
    security = F.lpad(F.floor(F.col("o_custkey") / 75).cast("string"), 6, "0")
    return t.base("orders").select(security.alias("_security"), *columns, F.col("o_orderkey").alias("ingest_seq"))


@case("p4_normalize_actions_em", ACTION_COLUMNS, _action_sql("em"))
def _(t):
    raw = _raw_actions(t, {"ex": "除权除息日", "cash": "现金分红-现金分红比例", "sent": "送转股份-送股比例", "moved": "送转股份-转股比例", "announced": "最新公告日期", "record": "股权登记日"})
    return vendor.normalize_actions_em(raw, F.col("_security"), check=False)


@case("p4_normalize_actions_cninfo", ACTION_COLUMNS, _action_sql("cninfo"))
def _(t):
    raw = _raw_actions(t, {"ex": "除权日", "cash": "派息比例", "sent": "送股比例", "moved": "转增比例", "announced": "实施方案公告日期", "record": "股权登记日"})
    return vendor.normalize_actions_cninfo(raw, F.col("_security"), check=False)


@case("p4_normalize_actions_sina", ACTION_COLUMNS, _action_sql("sina"))
def _(t):
    raw = _raw_actions(t, {"ex": "除权除息日", "cash": "派息", "sent": "送股", "moved": "转增", "announced": "公告日期", "record": "股权登记日"})
    return vendor.normalize_actions_sina(raw, F.col("_security"), check=False)


@case("p5_normalize_actions_text", ACTION_COLUMNS, _action_sql("ths"))
def _(t):
    raw = _raw_actions(t, {"ex": "A股除权除息日", "cash": "c", "sent": "s", "moved": "m", "announced": "实施公告日", "record": "A股股权登记日"})
    plan = F.concat_ws("", F.lit("10"), F.concat(F.lit("送"), "s"), F.concat(F.lit("转增 "), "m"), F.when(F.col("c") != "--", F.concat(F.lit("派"), F.col("c"), F.lit("元"))))
    return vendor.normalize_actions_text(raw.withColumn("分红方案说明", plan), F.col("_security"), check=False)


@case(
    "p6_normalize_rights",
    "security_id:s ex_date:d action_type:s share_ratio:f6 rights_price_per_share:f6",
    f"select security_id, ex_date, 'RIGHTS_ISSUE' as action_type, sent / 10.0 as share_ratio, case when o_orderkey % 6 = 0 then 2 end as rights_price_per_share from ({ACTION_SQL})",
)
def _(t):
    raw = _raw_actions(t, {"ex": "除权日", "sent": "配股方案", "moved": "配股价格", "announced": "公告日期", "record": "股权登记日"})
    return vendor.normalize_rights(raw, F.col("_security"), check=False)


@case("p7_missing_ex_date", "check:s key:s detail:s", f"""select 'ACTION_WITHOUT_EX_DATE' as "check", concat(security_id, '/em') as "key", '' as detail from ({_action_sql('em')}) where ex_date is null""")
def _(t):
    raw = _raw_actions(t, {"ex": "除权除息日", "cash": "现金分红-现金分红比例", "sent": "送转股份-送股比例", "moved": "送转股份-转股比例"})
    return vendor.missing_ex_date_violations(vendor.normalize_actions_em(raw, F.col("_security"), check=False))


@case("p8_classify_action", "o_orderkey:i action_type:s", f"select o_orderkey, case when sent + moved > 0 then 'STOCK_DIVIDEND' when cash10 > 0 then 'CASH_DIVIDEND' else 'OTHER' end as action_type from ({ACTION_SQL})")
def _(t):
    raw = _raw_actions(t, {"cash": "c", "sent": "s", "moved": "m"})
    shares = F.coalesce(F.col("s").cast("int"), F.lit(0)) + F.coalesce(F.col("m").cast("int"), F.lit(0))
    return raw.select(F.col("ingest_seq").alias("o_orderkey"), vendor.classify_action(F.coalesce(F.col("c").try_cast("double"), F.lit(0.0)), shares).alias("action_type"))


@case(
    "p9_pick_provider",
    "security_id:s ex_date:d action_type:s revision_id:s source_id:s",
    """select security_id, ex_date, action_type, revision_id, source_id from actions a where source_id = (
         select case when bool_or(source_id = 'cninfo') then 'cninfo' else 'em' end from actions b where b.security_id = a.security_id)""",
    ("actions",),
)
def _(t):
    return vendor.pick_provider(t.actions, ["cninfo", "em"])


@case(
    "p10_combine_actions",
    "security_id:s ex_date:d action_type:s cash_dividend_per_share:f6 share_ratio:f6",
    "select distinct security_id, ex_date, action_type, cash_dividend_per_share, share_ratio from actions",
    ("actions",),
)
def _(t):
    arrived = F.unix_seconds(F.col("available_at").cast("timestamp")).alias("ingest_seq")
    slim = t.actions.select("security_id", "ex_date", "action_type", "cash_dividend_per_share", "share_ratio", "source_id", arrived)
    return vendor.combine_actions(slim, slim.where("action_type = 'RIGHTS_ISSUE'"))


NAMES_SQL = """select lpad(cast(s_suppkey as varchar), 6, '0') as security_id, concat(case s_suppkey % 5 when 0 then '*ST ' when 1 then 's t' else '' end, s_name, case when s_suppkey % 7 = 0 then '退' else '' end) as name, s_suppkey as k from supplier"""


def _names(t):
    k = F.col("s_suppkey")
    prefix = F.when(k % 5 == 0, "*ST ").when(k % 5 == 1, "s t").otherwise("")
    rows = t.base("supplier").select(F.concat(F.lit("sz"), F.lpad(k.cast("string"), 6, "0")).alias("code"), F.concat(prefix, "s_name", F.when(k % 7 == 0, "退").otherwise("")).alias("name"), k.alias("ingest_seq"))
    return vendor.code_names(rows)


LISTING_SQL = """
select security_id, exchange_name, list_date, list_date_source_id, exchange_board from (
  select lpad(cast(s_suppkey as varchar), 6, '0') as security_id, concat('B', s_name) as exchange_name, case when s_suppkey % 4 = 0 then null else cast(date '2000-01-01' + to_days(cast(s_suppkey % 900 as integer)) as date) end as list_date, 'second' as list_date_source_id, '科创板' as exchange_board from supplier where s_nationkey % 2 = 0
  union all select lpad(cast(s_suppkey as varchar), 6, '0'), concat('A', s_name), cast(date '2001-01-01' + to_days(cast(s_suppkey % 900 as integer)) as date), 'first', '主板' from supplier where s_nationkey % 2 = 1)"""


def _listings(t):
    base = t.base("supplier").withColumn("ingest_seq", F.col("s_suppkey")).withColumn("证券代码", F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    shift = (F.col("s_suppkey") % 900).cast("int")
    first = base.select("证券代码", F.concat(F.lit("A"), "s_name").alias("证券简称"), F.date_add(F.lit("2001-01-01").cast("date"), shift).cast("string").alias("上市日期"), "ingest_seq")
    second = base.where("s_nationkey % 2 = 0").select("证券代码", F.concat(F.lit("B"), "s_name").alias("简称"), F.when(F.col("s_suppkey") % 4 != 0, F.date_add(F.lit("2000-01-01").cast("date"), shift).cast("string")).otherwise("未知").alias("上市日期"), F.lit("科创板").alias("板块"), "ingest_seq")
    return vendor.combine_listings(
        [
            vendor.normalize_listing(first, "first", "证券代码", "证券简称", "上市日期", "主板"),
            vendor.normalize_listing(second, "second", "证券代码", "简称", "上市日期", board_column="板块"),
        ]
    )


@case("p11_normalize_listing", "security_id:s exchange_name:s list_date:d list_date_source_id:s exchange_board:s", LISTING_SQL)
def _(t):
    return _listings(t)


@case("p12_current_st", "security_id:s", f"select security_id from ({NAMES_SQL}) where k % 5 in (0, 1)")
def _(t):
    return vendor.current_st(_names(t))


def _overrides(t):
    halted = t.base("supplier").where("s_acctbal < 0").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("security_id"))
    return vendor.status_overrides(halted, _names(t))


OVERRIDES_SQL = f"""select n.security_id, case when contains(n.name, '退') then '退市' else '停牌' end as status from ({NAMES_SQL}) n join supplier s on s.s_suppkey = n.k where contains(n.name, '退') or s.s_acctbal < 0"""


@case("p13_status_overrides", "security_id:s status:s", OVERRIDES_SQL)
def _(t):
    return _overrides(t)


@case("p13_suspended_only", "security_id:s", f"select security_id from ({OVERRIDES_SQL}) where status = '停牌'")
def _(t):
    return vendor.suspended_only(_overrides(t))


@case(
    "p14_attach_action_pit",
    "security_id:s ex_date:d action_type:s revision_kept:s available_at:t event_ts:t",
    "select security_id, ex_date, action_type, revision_id as revision_kept, coalesce(announcement_date, ex_date) + interval 15 hours as available_at, ex_date + interval 15 hours as event_ts from actions",
    ("actions",),
)
def _(t):
    return bld.attach_action_pit(t.actions.withColumn("revision_kept", F.col("revision_id")), SNAPSHOT, "r1")


@case(
    "p15_build_security_master",
    "security_id:s name:s list_date:d board:s is_st:s status:s available_at:t is_st_available_at:t list_date_source_id:s",
    f"""select n.security_id, n.name, l.list_date, case when substr(n.security_id, 1, 1) in ('8', '9', '4') then '北交所' else '主板' end as board, case when n.k % 5 in (0, 1) then 'true' else 'false' end as is_st, coalesce(o.status, '正常') as status,
       coalesce(l.list_date + interval 15 hours, timestamp '1990-12-19 15:00:00') as available_at, timestamp '2023-06-30 15:00:00' as is_st_available_at, l.list_date_source_id
       from ({NAMES_SQL}) n left join ({LISTING_SQL}) l on l.security_id = n.security_id left join ({OVERRIDES_SQL}) o on o.security_id = n.security_id""",
)
def _(t):
    names = _names(t)
    return bld.build_security_master(names, names, _listings(t), vendor.current_st(names), _overrides(t), F.lit("2023-07-01 09:00:00").cast("timestamp_ntz"), SNAPSHOT, "r1")


@case(
    "p16_board_from_id",
    "p_partkey:i board:s",
    """select p_partkey, case when starts_with(s, '688') or starts_with(s, '689') then '科创板' when starts_with(s, '300') or starts_with(s, '301') then '创业板' when substr(s, 1, 1) in ('8', '9', '4') then '北交所' else '主板' end as board
       from (select p_partkey, concat(case p_partkey % 4 when 0 then '68' when 1 then '30' else '' end, lpad(cast(p_partkey as varchar), case when p_partkey % 4 < 2 then 4 else 6 end, cast(p_partkey % 10 as varchar))) as s from part)""",
)
def _(t):
    k = F.col("p_partkey")
    width = F.when(k % 4 < 2, 4).otherwise(6)
    text = F.concat(F.when(k % 4 == 0, "68").when(k % 4 == 1, "30").otherwise(""), F.lpad(k.cast("string"), width, (k % 10).cast("string")))
    return t.base("part").select("p_partkey", sc.board_from_id(text).alias("board"))


@case(
    "p17_clock_columns",
    "security_id:s list_date:d close_ts:t known_ts:t snapshot_day:d",
    "select security_id, list_date, list_date + interval 15 hours as close_ts, coalesce(case when is_st then null else list_date + interval 15 hours end, timestamp '1990-12-19 15:00:00') as known_ts, date '2023-06-30' as snapshot_day from master",
    ("master",),
)
def _(t):
    known = F.when(~F.col("is_st"), F.col("list_date"))
    return t.master.select("security_id", "list_date", sc.market_close_ts("list_date").alias("close_ts"), sc.close_ts_or_unknown(known).alias("known_ts"), sc.snapshot_date(F.lit(SNAPSHOT)).alias("snapshot_day"))


@case("p18_universe_from_bars", "security_id:s", "select distinct security_id from bars_src", ("bars_src",))
def _(t):
    return bld.universe_from_bars(t.bars)


SHEET = """
select security_id, ex_date, record_date, cast(record_date - to_days(case when n % 9 = 0 then -2 else 5 end) as date) as disclosure_date, cash, case when n % 4 = 0 then null else round(cash * 0.9, 6) end as deduction, case when action_type = 'STOCK_DIVIDEND' then ratio end as ratio,
  concat(case when n % 8 = 0 then '000000' else security_id end, '_', ex_date, '_', mk, '.pdf') as source_file, n, action_type, mk
from (select *, cast(ex_date - to_days(1) as date) as record_date from actions_src) where action_type in ('CASH_DIVIDEND', 'STOCK_DIVIDEND') and n % 6 <> 0"""


def _sheet(t):
    src = t.source("actions_src")
    record = F.date_sub("ex_date", 1)
    shift = F.when(F.col("n") % 9 == 0, -2).otherwise(5)
    file = F.concat_ws("_", F.when(F.col("n") % 8 == 0, "000000").otherwise(F.col("security_id")), F.col("ex_date").cast("string"), F.col("mk").cast("string"))
    raw = {
        "code": F.col("security_id"),
        "公告日": F.date_sub(record, shift).cast("string"),
        "股权登记日": record.cast("string"),
        "除权息日": F.col("ex_date").cast("string"),
        "每股现金红利_税前": F.col("cash").cast("string"),
        "除权实际扣减_每股": F.when(F.col("n") % 4 != 0, F.round(F.col("cash") * F.lit("0.9").cast("decimal(3,1)"), 6).cast("string")).otherwise(""),
        "送股比例_每股": F.when(F.col("action_type") == "STOCK_DIVIDEND", F.col("ratio").cast("string")).otherwise(""),
        "有无折算节": F.lit("有"),
        "类型": F.when(F.col("action_type").isin("CASH_DIVIDEND", "STOCK_DIVIDEND") & (F.col("n") % 6 != 0), "普通股").otherwise("优先股"),
        "源文件": F.concat(file, F.lit(".pdf")),
        "公告标题": F.lit(" 实施公告 "),
    }
    return bld.load_verified_actions(src.select(*[c.alias(name) for name, c in raw.items()]))


@case(
    "f19_load_verified_actions",
    "security_id:s ex_date:d disclosure_date:d cash_dividend_per_share:f6 ex_right_cash_deduction_per_share:f6 share_ratio:f6 source_file:s",
    f"select security_id, ex_date, disclosure_date, cash as cash_dividend_per_share, coalesce(deduction, cash) as ex_right_cash_deduction_per_share, coalesce(ratio, 0) as share_ratio, source_file from ({SHEET})",
    ("actions_src",),
)
def _(t):
    return _sheet(t)


@case(
    "f19_verified_violations",
    "check:s key:s detail:s",
    f"""with s as ({SHEET}) select 'DATE_ORDER' as "check", concat_ws('/', security_id, ex_date, source_file) as "key", '' as detail from s where not (disclosure_date <= record_date and record_date < ex_date)
        union all select 'FILE_PREFIX', concat_ws('/', security_id, ex_date, source_file), '' from s where not starts_with(source_file, concat(security_id, '_'))
        union all select 'FILE_MISSING', concat_ws('/', security_id, ex_date, source_file), '' from s where mk % 5 = 0
        union all select 'SHA256_MISMATCH', concat_ws('/', security_id, ex_date, source_file), '' from s where mk % 5 <> 0 and mk % 3 = 0""",
    ("actions_src",),
)
def _(t):
    records = _sheet(t)
    mk = F.regexp_extract("source_file", r"_(\d+)\.pdf$", 1).cast("bigint")
    files = records.select(F.col("source_file").alias("file_name"), F.sha2("source_file", 256).alias("sha256")).where(F.regexp_extract("file_name", r"_(\d+)\.pdf$", 1).cast("bigint") % 5 != 0)
    listing = records.select(F.col("source_file").alias("file_name"), F.when(mk % 3 == 0, "0").otherwise(F.sha2("source_file", 256)).alias("sha256"))
    counts = records.groupBy("security_id").agg(F.count(F.lit(1)).alias("expected"))
    return bld.verified_violations(records, counts, files, listing)


@case(
    "p19_verified_action_rows",
    "security_id:s ex_date:d action_type:s cash_dividend_per_share:f6 actual:f6 share_ratio:f6 event_ts:t",
    f"""select security_id, ex_date, case when coalesce(ratio, 0) > 0 then 'STOCK_DIVIDEND' else 'CASH_DIVIDEND' end as action_type, coalesce(deduction, cash) as cash_dividend_per_share, cash as actual, coalesce(ratio, 0) as share_ratio, ex_date + interval 15 hours as event_ts from ({SHEET})""",
    ("actions_src",),
)
def _(t):
    rows = bld.verified_action_rows(_sheet(t).withColumn("source_sha256", F.lit("")), "adjustment", SNAPSHOT)
    return rows.withColumn("actual", F.col("cash_dividend_per_share").cast("decimal(18,6)") * 0 + F.col("cash_dividend_actual_per_share"))


# -- S: sources and sinks --------------------------------------------------------------------


@case("s1_read_table", "security_id:s trade_date:d close:f6", "select security_id, trade_date, close from bars", ("bars",))
def _(t):
    path = _scratch(t, "s1")
    writers.write_bars(t.bars, path)
    return readers.read_table(t.spark, "daily_bar_raw", path, ("security_id", "trade_date", "available_at"))


@case("s2_read_calendar", "trade_date:d session_idx:i", "select * from cal", ("cal",))
def _(t):
    path = _scratch(t, "s2")
    t.bars.select(F.col("trade_date").alias("day"), "trade_status").write.parquet(path)
    return readers.read_calendar(t.spark, path).sessions


@case(
    "s3_read_manifest_csv",
    "security_id:s title:s bytes:s",
    "select concat('id', doc_id) as security_id, concat(source, ', \"', lang, '\"') as title, cast(n_chars as varchar) as bytes from documents",
)
def _(t):
    path = _scratch(t, "s3")
    rows = t.base("documents").select(F.concat(F.lit("id"), "doc_id").alias("﻿security_id"), F.concat("source", F.lit(', "'), "lang", F.lit('"')).alias("title"), F.col("n_chars").cast("string").alias("bytes"))
    rows.write.csv(path, header=True, escape='"')
    return readers.read_manifest_csv(t.spark, path, ["security_id", "title"])


def _nav_file(t):
    def build():
        path = _scratch(t, "nav")
        one = trading._nav(t).groupBy("trade_date").agg(*[F.sum(c).alias(c) for c in ("nav", "cash", "holdings_market_value", "event_count")])
        writers.write_nav_csv(one, path)
        return path

    return t.shared("nav_csv", build)


NAV_TOTAL = f"select trade_date, sum(nav) as nav, sum(cash) as cash, sum(holdings_market_value) as market_value from ({trading.NAV_SQL}) group by 1"


@case("s5_read_nav_csv", "trade_date:d nav:f2 cash:f2 market_value:f2", NAV_TOTAL, ("bars", *trading.TRADE_VIEWS), trading.LEDGER_STEPS)
def _(t):
    return readers.read_nav_csv(t.spark, _nav_file(t))


@case("s8_write_nav_csv", "trade_date:d nav:s cash:s", f"select trade_date, cast(cast(nav as decimal(28,2)) as varchar) as nav, cast(cast(cash as decimal(28,2)) as varchar) as cash from ({NAV_TOTAL})", ("bars", *trading.TRADE_VIEWS), trading.LEDGER_STEPS)
def _(t):
    return t.spark.read.csv(_nav_file(t), header=True)


@case(
    "s6_fingerprint_files",
    "sha256:s bytes:i too_small:b",
    """select sha256(body) as sha256, strlen(body) as bytes, strlen(body) < 65536 as too_small
       from (select string_agg(concat(html, chr(10)), '' order by page_id) as body from (select page_id, html, page_id // 64 as g from pages) group by g)""",
)
def _(t):
    """One text file per 64 pages, lines in page order, read back as files."""
    path = _scratch(t, "s6")
    grouped = t.base("pages").select("page_id", "html", F.floor(F.col("page_id") / 64).alias("g"))
    grouped.repartition("g").sortWithinPartitions("g", "page_id").select("html", "g").write.partitionBy("g").text(path)
    return readers.fingerprint_files(t.spark, f"{path}/g=*/*.txt", 64 * 1024)


@case("s7_write_actions", "security_id:s ex_date:d action_type:s revision_id:s", "select security_id, ex_date, action_type, revision_id from actions", ("actions",))
def _(t):
    path = _scratch(t, "s7")
    writers.write_actions(t.actions, path)
    return t.spark.read.parquet(path)


@case("s7_write_master", "security_id:s board:s list_date:d", "select security_id, board, list_date from master", ("master",))
def _(t):
    path = _scratch(t, "s7m")
    writers.write_master(t.master, path)
    return t.spark.read.parquet(path)


@case("s9_write_manifest", "rows:i securities:i last_date:d", "select count(*) as rows, count(distinct security_id) as securities, max(trade_date) as last_date from bars", ("bars",))
def _(t):
    path = _scratch(t, "s9")
    writers.write_manifest(t.bars.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("security_id").alias("securities"), F.max("trade_date").alias("last_date")), path)
    return t.spark.read.json(path)


@case("s10_write_predictions", "signal_asof_ts:t security_id:s signal_status:s year:i", "select signal_date + interval 15 hours as signal_asof_ts, security_id, status as signal_status, year(signal_date) as year from points", research.BASE, research.SIGNAL_STEPS)
def _(t):
    path = _scratch(t, "s10")
    writers.write_predictions(ev.prediction_frame(research._signal(t), research._labels(t), research._ic(t)), path)
    return t.spark.read.parquet(path)


# The four tables of one run: what was locked and admitted, its outcomes, its ledger and its NAV.
MONEY_TEXT = "cast(cast({0} as decimal(18,2)) as varchar)"
RUN_TABLES = f"""
select 'orders' as tab, portfolio_id, security_id, decision_date as day, side as what, locked_quantity as quantity, {MONEY_TEXT.format('reserved_cash')} as money from admitted
union all select 'fills', portfolio_id, security_id, decision_date, concat(side, '/', reason), case when status = 'FILLED' then locked_quantity else 0 end, {MONEY_TEXT.format("case when side = 'sell' then gross - fee else gross + fee end")} from outcome
union all select 'ledger', portfolio_id, security_id, trade_date, concat(event_id, '/', event_type), quantity_delta, {MONEY_TEXT.format('cash_after')} from chained
union all select 'nav', portfolio_id, '', trade_date, '', event_count, {MONEY_TEXT.format('nav')} from navq"""


@case("s11_write_run_tables", "tab:s portfolio_id:i security_id:s day:d what:s quantity:i money:s", RUN_TABLES, trading.BASE, (*trading.CHAIN_STEPS, ("navq", trading.CHAIN_NAV)))
def _(t):
    """Written and read back: orders, fills, ledger and NAV of the chained run, money as decimal text."""
    path = _scratch(t, "s11")
    writers.write_run_tables({"orders": trading._admitted(t).drop(*EXECUTION), "fills": trading._fills(t), "ledger": trading._chain_entries(t), "nav": trading._chain_nav(t)}, path)
    back = {name: t.spark.read.parquet(f"{path}/{name}") for name in ("orders", "fills", "ledger", "nav")}

    def rows(name, day, what, quantity, money, security="security_id"):
        return back[name].select(F.lit(name).alias("tab"), "portfolio_id", (F.col(security) if security else F.lit("")).alias("security_id"), F.col(day).alias("day"), what.alias("what"), F.col(quantity).alias("quantity"), F.col(money).alias("money"))

    parts = [
        rows("orders", "decision_date", F.col("side"), "locked_quantity", "reserved_cash"),
        rows("fills", "decision_date", F.concat_ws("/", "side", "reason"), "filled_quantity", "net_amount"),
        rows("ledger", "trade_date", F.concat_ws("/", F.col("event_id").cast("string"), "event_type"), "quantity_delta", "cash_after"),
        rows("nav", "trade_date", F.lit(""), "event_count", "nav", None),
    ]
    return union_all(parts)


# -- Q: quality ------------------------------------------------------------------------------


def _flawed(t):
    pct = F.when(F.col("volume") % 700 == 0, 25.0).otherwise(1.0)
    bars = t.bars.withColumn("pct_change", pct).withColumn("close", F.when(F.col("volume") % 1100 == 0, -F.col("close")).otherwise(F.col("close")))
    return bars.unionByName(bars.where("volume % 1300 = 0 and volume > 0"))


FLAWED = """
select security_id, trade_date, open, volume, case when volume % 1100 = 0 then -close else close end as close, case when volume % 700 = 0 then 25.0 else 1.0 end as pct, x.copy from bars
join (values (1), (2)) x(copy) on x.copy = 1 or (volume % 1300 = 0 and volume > 0)"""
DETAIL = """
select *, c * 1000 + v + p * 50 + j * 100 + d * 500 + e * 1000 as score, concat_ws('; ', case when c > 0 then '收盘价<=0天数' end, case when v > 0 then '成交量=0天数' end, case when p > 0 then '单日涨跌幅绝对值>21%天数' end,
  case when j > 0 then '收盘价较前日变动>50%天数' end, case when d > 0 then '重复日期条数' end, case when e > 0 then '关键字段NaN条数' end) as flags, round(date_diff('day', lo, hi) / 365, 2) as years
from (select security_id, min(trade_date) as lo, max(trade_date) as hi, count(*) as n, count(*) filter (close <= 0) as c, count(*) filter (volume = 0) as v, count(*) filter (abs(pct) > 21) as p, count(*) filter (dup > 1) as d,
        count(*) filter (close is null or open is null or volume is null) as e, count(*) filter (abs(cast(close as double) / prev - 1) > 0.5) as j
      from (select *, count(*) over (partition by security_id, trade_date) as dup, cast(lag(close) over (partition by security_id order by trade_date, copy) as double) as prev from flawed) group by 1)"""
QSTEPS = (("flawed", FLAWED), ("detail", DETAIL))


@case("q1_quality_detail", "security_id:s first_date:d last_date:d rows:i years:f2 close_not_positive:i zero_volume:i pct_over_limit:i close_jumps:i duplicate_dates:i null_key_fields:i flags:s score:i", "select security_id, lo as first_date, hi as last_date, n as rows, years, c as close_not_positive, v as zero_volume, p as pct_over_limit, j as close_jumps, d as duplicate_dates, e as null_key_fields, flags, score from detail", ("bars",), QSTEPS)
def _(t):
    return q.quality_detail(_flawed(t))


@case("q2_quality_summary", "securities:i rows:i full_history:i five_to_ten_years:i under_five_years:i under_two_years:i flagged:i", "select count(*) as securities, sum(n) as rows, count(*) filter (years >= 10) as full_history, count(*) filter (years >= 5 and years < 10) as five_to_ten_years, count(*) filter (years < 5) as under_five_years, count(*) filter (years < 2) as under_two_years, count(*) filter (flags <> '') as flagged from detail", ("bars",), QSTEPS)
def _(t):
    return q.quality_summary(q.quality_detail(_flawed(t)))


@case("q3_top_problems", "security_id:s score:i", "select security_id, score from detail where score > 0 order by score desc, e desc, c desc, d desc, j desc, p desc, v desc, security_id limit 15", ("bars",), QSTEPS)
def _(t):
    return q.top_problems(q.quality_detail(_flawed(t)))


@case(
    "q4_availability_diagnostics",
    "announced:i announced_ratio:f8 fallback_to_ex_date:i min_lag_days:i max_lag_days:i zero_lag:i",
    """select count(announcement_date) as announced, avg(case when announcement_date is null then 0.0 else 1.0 end) as announced_ratio, count(*) - count(announcement_date) as fallback_to_ex_date, min(ex_date - announcement_date) as min_lag_days, max(ex_date - announcement_date) as max_lag_days,
       count(*) filter (ex_date = announcement_date) as zero_lag from actions""",
    ("actions",),
)
def _(t):
    return q.availability_diagnostics(t.actions)


@case("q4_zero_lag_ids", "security_id:s zero_lag:i", "select security_id, count(*) as zero_lag from actions where ex_date = announcement_date group by 1", ("actions",))
def _(t):
    return q.zero_lag_ids(t.actions)


def _stats_sql(parts: list[str]) -> str:
    return " union all ".join(parts)


@case(
    "q5_action_build_stats",
    "stat:s item:s value:i",
    _stats_sql(["select 'rows' as stat, '' as item, count(*) as value from actions", "select 'securities_with_actions', '', count(distinct security_id) from actions", "select 'securities_without_actions', '', count(*) from (select distinct security_id from bars_src) where security_id not in (select security_id from actions)", "select 'action_type', action_type, count(*) from actions group by 2", "select 'source_id', source_id, count(*) from actions group by 2"]),
    ("actions", "bars_src"),
)
def _(t):
    return q.action_build_stats(t.actions, t.ids)


@case(
    "q6_bar_build_stats",
    "stat:s item:s value:i",
    _stats_sql(["select 'rows' as stat, '' as item, count(*) as value from bars", "select 'securities', '', count(distinct security_id) from bars", "select 'sessions', '', count(distinct trade_date) from bars", "select 'trade_status', trade_status, count(*) from bars group by 2", "select 'source_id', 'landed.daily', count(*) from bars"]),
    ("bars",),
)
def _(t):
    return q.bar_build_stats(t.bars)


@case("s9_build_manifest", "stat:s item:s value:i", CASES["q6_bar_build_stats"].sql, ("bars",))
def _(t):
    """The bar build writes its manifest beside the table; it is read back here."""
    path = _scratch(t, "s9b")
    build_bars(t.bars_src.drop("k"), t.cal, path, "landed.daily", "r1", "snap_base")
    return t.spark.read.json(f"{path}_manifest")


@case(
    "q6_master_build_stats",
    "stat:s item:s value:i",
    _stats_sql(["select 'securities' as stat, '' as item, count(*) as value from master", "select 'board', board, count(*) from master group by 2", "select 'st', '', count(*) filter (is_st) from master", "select 'missing_list_date', '', count(*) filter (list_date is null) from master"]),
    ("master",),
)
def _(t):
    return q.master_build_stats(t.master)


@case(
    "q7_cash_split_diagnostics",
    "different:i same:i security_id:s ex_date:d largest_difference:f6",
    """with d as (select *, abs(cash_dividend_per_share - ex_right_cash_deduction_per_share) as g from actions where ex_right_cash_deduction_per_share is not null), m as (select * from d order by g desc, ex_date, security_id desc limit 1)
select (select count(*) from d where g > 0) as different, (select count(*) from d where g = 0) as same, security_id, ex_date, g as largest_difference from m""",
    ("actions",),
)
def _(t):
    return q.cash_split_diagnostics(t.actions)


@case(
    "q8_verification_slots",
    "security_id:s ex_date:d action_type:s revision_id:s claimed_count:i manual_focus:s",
    """select security_id, ex_date, action_type, revision_id, n as claimed_count, concat_ws(';', case when n > 12 then 'CA_COUNT_GT_3_PER_YEAR' end, case when action_type not in ('CASH_DIVIDEND', 'STOCK_DIVIDEND') then concat('COMPLEX_ACTION:', action_type) end) as manual_focus
       from (select *, count(*) over (partition by security_id) as n from actions where ex_date between date '2019-01-01' and date '2021-12-31')""",
    ("actions",),
)
def _(t):
    return q.verification_slots(t.actions, t.ids, "2019-01-01", "2021-12-31")


@case(
    "q9_dependency_coverage",
    "first_signal:d last_signal:d dependency_start:d dependency_end:d first_ex_date:d last_ex_date:d",
    """with e as (select min(session_idx) as a, max(session_idx) as b from cal where trade_date between date '2019-03-01' and date '2022-06-30')
select (select trade_date from cal where session_idx = a) as first_signal, (select trade_date from cal where session_idx = b) as last_signal, (select trade_date from cal where session_idx = a - 52) as dependency_start, (select trade_date from cal where session_idx = b + 22) as dependency_end,
  (select min(ex_date) from actions) as first_ex_date, (select max(ex_date) from actions) as last_ex_date from e""",
    ("cal", "actions"),
)
def _(t):
    return q.dependency_coverage(t.cal, "2019-03-01", "2022-06-30", t.actions, back=52, ahead=22)


def _scaled(t):
    source = F.when(F.col("trade_date") < F.lit("2018-01-01").cast("date"), "lots").otherwise("shares")
    return t.bars.withColumn("source_id", source).withColumn("amount", F.when(source == "lots", F.col("amount") * 100).otherwise(F.col("amount")))


@case(
    "q18_unit_ratio",
    "source_id:s rows:i out_of_range:i",
    "select case when trade_date < date '2018-01-01' then 'lots' else 'shares' end as source_id, count(*) as rows, count(*) filter (trade_date < date '2018-01-01' and volume > 0 and close is not null) as out_of_range from bars group by 1",
    ("bars",),
)
def _(t):
    return q.unit_ratio_by_source(_scaled(t))


@case(
    "q19_coverage_vs_reference",
    "security_id:s start_gap_days:i end_gap_days:i row_ratio:f8 consistent:b",
    """with a as (select security_id, min(trade_date) as lo, max(trade_date) as hi, count(*) as n from bars where trade_status <> '缺失' group by 1), b as (select security_id, min(trade_date) as lo, max(trade_date) as hi, count(*) as n from sparse where trade_date >= date '2017-09-01' group by 1)
select a.security_id, abs(a.lo - b.lo) as start_gap_days, abs(a.hi - b.hi) as end_gap_days, a.n / b.n as row_ratio, abs(a.lo - b.lo) <= 180 and abs(a.hi - b.hi) <= 5 and a.n / b.n > 0.8 and a.n / b.n < 1.3 as consistent from a join b using (security_id)""",
    ("bars", "sparse"),
)
def _(t):
    return q.coverage_vs_reference(t.bars, t.sparse.where("trade_date >= date '2017-09-01'"))


@case(
    "q21_availability_check",
    "check:s key:s detail:s",
    """select 'NOT_RESOLVED' as "check", concat_ws('/', security_id, ex_date, action_type, revision_id) as "key", case when nxt is null then 'NO_NEXT_SESSION_AFTER_DISCLOSURE' else 'NOT_VERIFIABLE_BEFORE_EX_DATE' end as detail
       from (select *, (select min(trade_date) from cal where trade_date > disclosure_date) as nxt from actions where disclosure_time_known = false) where nxt is null or nxt >= ex_date""",
    ("actions", "cal"),
)
def _(t):
    return q.availability_check(t.actions, t.cal)


@case(
    "q21_unresolved_disclosure",
    "check:s key:s",
    """select 'NOT_RESOLVED' as "check", concat_ws('/', security_id, ex_date, action_type, revision_id) as "key" from actions""",
    ("actions", "cal"),
)
def _(t):
    """Every disclosure put after the calendar's end, known by date only: none can resolve."""
    last = F.date_add(F.lit(t.cal.dates[-1]), 1)
    moved = t.actions.withColumns({"disclosure_time_known": F.lit(False), "disclosure_date": last})
    return q.availability_check(moved, t.cal).where("check = 'NOT_RESOLVED'")


@case(
    "q22_combined_event_check",
    "security_id:s ex_date:d hand_price:f8 reference_price:f8 uses_both_legs:b",
    """select p.security_id, p.trade_date as ex_date, (cast(p.previous_close as double) - cast(i.cash as double)) / (1 + cast(i.split_ratio as double)) as hand_price, p.ref as reference_price, true as uses_both_legs
       from points p join inputs i on i.security_id = p.security_id and i.ex_date = p.trade_date where p.status = 'OK' and i.cash > 0 and i.split_ratio > 0 and i.rights_ratio = 0""",
    ("bars", "actions"),
    asof_steps(END),
)
def _(t):
    daily = returns.daily_adjusted_returns(t.bars, t.actions, t.cal, END)
    return q.combined_event_check(daily, visible_inputs(t.actions, END))


@case(
    "j12_diff_sources",
    "only_in:s security_id:s ex_date:d action_type:s",
    """select 'a' as only_in, security_id, ex_date, action_type from actions a where source_id = 'em' and not exists (select 1 from actions b where b.source_id = 'cninfo' and b.security_id = a.security_id and b.ex_date = a.ex_date)
       union all select 'b', security_id, ex_date, action_type from actions a where source_id = 'cninfo' and not exists (select 1 from actions b where b.source_id = 'em' and b.security_id = a.security_id and b.ex_date = a.ex_date)""",
    ("actions",),
)
def _(t):
    return q.diff_sources(t.actions.where("source_id = 'em'"), t.actions.where("source_id = 'cninfo'"), ["security_id", "ex_date"], ["action_type"])


# -- X: scalars ----------------------------------------------------------------------------------


@case("x1_money", "l_orderkey:i l_linenumber:i l_partkey:i money:f2 money_text:s", "select l_orderkey, l_linenumber, l_partkey, round(cast(l_extendedprice as decimal(18,4)) * cast(l_discount as decimal(6,4)), 2) as money, cast(cast(round(cast(l_extendedprice as decimal(18,4)) * cast(l_discount as decimal(6,4)), 2) as decimal(18,2)) as varchar) as money_text from lineitem")
def _(t):
    value = F.col("l_extendedprice").cast("decimal(18,4)") * F.col("l_discount").cast("decimal(6,4)")
    return t.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sc.money(value).alias("money"), sc.money_text(value).alias("money_text"))


@case("x2_decimal_or_null", "event_id:i number:f6 or_zero:f6", "select event_id, case when event_id % 3 = 0 then null else cast(cast(value as decimal(12,2)) as double) end as number, case when event_id % 3 = 0 then 0 else cast(cast(value as decimal(12,2)) as double) end as or_zero from events")
def _(t):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), F.col("value").cast("decimal(12,2)").cast("string")))
    return t.base("events").select("event_id", sc.decimal_or_null(text).alias("number"), sc.decimal_or_zero(text).alias("or_zero"))


@case("x3_round_down_lot", "l_orderkey:i l_linenumber:i l_partkey:i lot:i", "select l_orderkey, l_linenumber, l_partkey, greatest(0, floor(((cast(l_quantity as bigint) - 10) * 37) / 100) * 100) as lot from lineitem")
def _(t):
    return t.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sc.round_down_lot((F.col("l_quantity").cast("bigint") - 10) * 37).alias("lot"))


@case("x4_limit_prices", "security_id:s trade_date:d up:f2 down:f2", "select security_id, trade_date, round(round(close, 2) * 1.1, 2) as up, round(round(close, 2) * 0.8, 2) as down from sparse", ("sparse",))
def _(t):
    up, down = sc.limit_prices("close", F.lit("0.10").cast("decimal(6,4)"), F.lit("0.20").cast("decimal(6,4)"))
    return t.sparse.select("security_id", "trade_date", up.alias("up"), down.alias("down"))


@case("x5_ids", "o_orderkey:i padded:s symbol:s", "select o_orderkey, case when length(s) < 6 then lpad(s, 6, '0') else s end as padded, concat(case when starts_with(s, '6') then 'sh' else 'sz' end, s) as symbol from (select o_orderkey, cast(o_orderkey * 7919 as varchar) as s from orders)")
def _(t):
    text = (F.col("o_orderkey") * 7919).cast("string")
    return t.base("orders").select("o_orderkey", sc.pad_id(text).alias("padded"), sc.exchange_symbol(text).alias("symbol"))


@case("x6_epoch_ms_to_local", "event_id:i local_ts:s minute:s", "select event_id, strftime(timestamp '1970-01-01 08:00:00' + to_milliseconds(epoch_ms), '%Y-%m-%d %H:%M:%S') as local_ts, strftime(timestamp '1970-01-01 08:00:00' + to_milliseconds(epoch_ms), '%Y-%m-%d %H:%M') as minute from announcements_src", ("announcements_src",))
def _(t):
    local = sc.epoch_ms_to_local("epoch_ms")
    return t.announcements.select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_ts"), sc.minute_text(local).alias("minute"))


@case("x10_market_clock", "trade_date:d opens:t closes:t", "select trade_date, trade_date + interval 570 minutes as opens, trade_date + interval 15 hours as closes from cal", ("cal",))
def _(t):
    days = calops.session_range(t.cal, t.cal.first, t.cal.last)
    return days.select("trade_date", sc.market_open_ts("trade_date").alias("opens"), sc.market_close_ts("trade_date").alias("closes"))
