"""Splits, index membership and fundamental releases: every sample, membership row and filing of the derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.scalars import market_close_ts
from tidemark.operators import membership, releases, splits
from tidemark.operators.calendar import month_first_sessions, with_session_idx
from tidemark.plans import incremental
from tidemark.staging import checkpoint_root
from workload.cases import case

# -- walk-forward folds ------------------------------------------------------------

PLAN = splits.WalkForward(validation=26, min_train=104, test=13, embargo=4)
ROLLING = splits.WalkForward(validation=13, min_train=52, train=78, step=20, embargo=2, purge_validation=False)

SAMPLES = """
select concat(security_id, '/', cast(trade_date as varchar)) as sample_id, security_id, trade_date as day, session_idx as idx, trade_date + interval 15 hours as decision_ts,
  case when least(session_idx + cast(floor(coalesce(volume, 0) / 100) as bigint) % 9 + 1, n - 1) > session_idx
       then (select c.trade_date from cal c where c.session_idx = least(b.session_idx + cast(floor(coalesce(volume, 0) / 100) as bigint) % 9 + 1, n - 1)) + interval 15 hours
       else trade_date + interval 39 hours end as label_end_ts
from bars b, (select count(*) as n from cal) s
"""


def _folds_sql(plan: splits.WalkForward) -> str:
    """Folds by plain ranges of session positions, until a fold's last block leaves the calendar."""
    test = f"v + {plan.validation + plan.embargo}" if plan.test else "null"
    train = "0" if plan.train is None else f"greatest(0, v - {plan.train})"
    return f"""select f as fold, {train} as t0, v as v0, v + {plan.validation} - 1 as v1, {test} as e0, {test} + {plan.test} - 1 as e1
from (select f, {plan.min_train} + f * {plan.stride} as v from range(0, 1000) r(f)) x, (select count(*) as n from cal) c where v + {plan.tail} <= n"""


def _roles_sql(plan: splits.WalkForward) -> str:
    block = f"""case when idx between t0 and v0 - 1 then 'TRAIN' when idx between v0 and v1 then 'VALIDATION' when idx between e0 and e1 then 'TEST'
      when idx between v1 + 1 and v1 + {plan.embargo} or idx between e1 + 1 and e1 + {plan.embargo} then 'EMBARGO' end"""
    validation = "or block = 'VALIDATION' and label_end_ts >= ft" if plan.purge_validation else ""
    return f"""
select sample_id, fold, block, day, decision_ts, label_end_ts, case when block = 'TRAIN' and label_end_ts >= coalesce(fv, ft) {validation} then 'PURGED' else block end as role
from (select *, min(decision_ts) filter (block = 'VALIDATION') over (partition by fold) as fv, min(decision_ts) filter (block = 'TEST') over (partition by fold) as ft
  from (select s.*, f.fold, {block} as block from samples s join folds f on true) x where block is not null) y"""


def _steps(plan: splits.WalkForward) -> tuple[tuple[str, str], ...]:
    return (("samples", SAMPLES), ("folds", _folds_sql(plan)), ("roles", _roles_sql(plan)))


def _samples(t):
    return splits.calendar_samples(t.bars, t.cal, F.floor(F.coalesce("volume", F.lit(0)) / 100) % 9 + 1)


ROLE_COLUMNS = "sample_id:s fold:i block:s role:s"


@case("d1_walk_forward", ROLE_COLUMNS, "select * from roles", ("bars", "cal"), _steps(PLAN))
def _d1(t):
    return splits.walk_forward(_samples(t), t.cal, PLAN)


@case("d1_walk_forward_rolling", ROLE_COLUMNS, "select * from roles", ("bars", "cal"), _steps(ROLLING))
def _d1_rolling(t):
    return splits.walk_forward(_samples(t), t.cal, ROLLING)


@case(
    "d1_fold_summary",
    "fold:i role:s samples:i dates:i first_decision:t last_decision:t last_label_end:t",
    "select fold, role, count(*) as samples, count(distinct day) as dates, min(decision_ts) as first_decision, max(decision_ts) as last_decision, max(label_end_ts) as last_label_end from roles group by 1, 2",
    ("bars", "cal"),
    _steps(PLAN),
)
def _d1_summary(t):
    return splits.fold_summary(splits.walk_forward(_samples(t), t.cal, PLAN))


@case(
    "d1_fold_borders",
    "fold:i train_start:d train_end:d validation_start:d validation_end:d test_start:d test_end:d",
    "select fold, " + ", ".join(f"(select trade_date from cal where session_idx = {e}) as {n}" for n, e in (("train_start", "t0"), ("train_end", "v0 - 1"), ("validation_start", "v0"), ("validation_end", "v1"), ("test_start", "e0"), ("test_end", "e1"))) + " from folds",
    ("cal",),
    (("folds", _folds_sql(PLAN)),),
)
def _d1_borders(t):
    return splits.fold_borders(t.cal, PLAN)


@case(
    "d1_sample_violations",
    "check:s key:s detail:s",
    """
with b as (select case when idx % 50 = 7 and d = '1' then null when idx % 50 = 9 and d = '2' then 'twice' else sample_id end as sample_id,
    case when idx % 50 = 11 and d = '3' then decision_ts + interval 1 day else decision_ts end as decision_ts,
    case when idx % 50 = 13 and d = '4' then decision_ts else label_end_ts end as label_end_ts,
    case when idx % 50 = 15 and d = '5' then decision_ts + interval 1 second else decision_ts end as feature_asof_ts
  from (select *, substr(security_id, 6, 1) as d from samples) s)
select 'SAMPLE_FIELD_MISSING' as "check", '' as key, '' as detail from b where sample_id is null
union all select 'DECISION_NOT_A_SESSION', coalesce(sample_id, ''), cast(cast(decision_ts as date) as varchar) from b where cast(decision_ts as date) not in (select trade_date from cal)
union all select 'LABEL_ENDS_BEFORE_DECISION', coalesce(sample_id, ''), cast(label_end_ts as varchar) from b where label_end_ts <= decision_ts
union all select 'FEATURE_AFTER_DECISION', coalesce(sample_id, ''), cast(feature_asof_ts as varchar) from b where feature_asof_ts > decision_ts
union all select 'DUPLICATE_SAMPLE', sample_id, cast(count(*) as varchar) from b where sample_id is not null group by sample_id having count(*) > 1
""",
    ("bars", "cal"),
    (("samples", SAMPLES),),
)
def _d1_sample_violations(t):
    rows = with_session_idx(_samples(t).withColumn("_decided", F.col("decision_ts").cast("date")), t.cal, "_decided", "idx")
    at = lambda k, d: (F.col("idx") % 50 == k) & (F.substring("security_id", 6, 1) == d)
    broken = rows.withColumns(
        {
            "sample_id": F.when(at(7, "1"), None).when(at(9, "2"), "twice").otherwise(F.col("sample_id")),
            "feature_asof_ts": F.when(at(15, "5"), F.col("decision_ts") + F.expr("interval 1 second")).otherwise(F.when(at(11, "3"), F.col("decision_ts")).otherwise(F.col("feature_asof_ts"))),
            "label_end_ts": F.when(at(13, "4"), F.col("decision_ts")).otherwise(F.col("label_end_ts")),
        }
    ).withColumn("decision_ts", F.when(at(11, "3"), F.col("decision_ts") + F.expr("interval 1 day")).otherwise(F.col("decision_ts")))
    return splits.sample_violations(broken, t.cal)


BROKEN_ROLES = """
select fold, sample_id, day, decision_ts, label_end_ts,
  case when role = 'PURGED' and fold % 2 = 0 then block when role = 'EMBARGO' and fold % 3 = 1 then 'TEST' when role = 'VALIDATION' and sample_id like '6%' and fold % 4 = 2 then 'TRAIN' else role end as role from roles
"""


@case(
    "d1_fold_violations",
    "check:s key:s detail:s",
    f"""
with u as (select * from broken where role in ('TRAIN', 'VALIDATION', 'TEST')),
span as (select fold, max(decision_ts) filter (role = 'TRAIN') as lt, min(decision_ts) filter (role = 'VALIDATION') as fv, max(decision_ts) filter (role = 'VALIDATION') as lv, min(decision_ts) filter (role = 'TEST') as ft from u group by fold),
x as (select u.*, s.fv, s.ft, c.session_idx as idx, f.v1, f.e1 from u join span s using (fold) join folds f using (fold) join cal c on c.trade_date = u.day)
select 'LABEL_REACHES_LATER_BLOCK' as "check", concat(fold, '/', sample_id) as key, cast(label_end_ts as varchar) as detail from x where label_end_ts >= case role when 'TRAIN' then coalesce(fv, ft) when 'VALIDATION' then ft end
union all select 'DATE_ON_TWO_SIDES', concat(fold, '/', cast(day as varchar)), cast(count(distinct role) as varchar) from u group by fold, day having count(distinct role) > 1
union all select 'BLOCKS_OUT_OF_ORDER', cast(fold as varchar), bad from (select fold, concat_ws(',', case when cast(lt as date) >= cast(fv as date) then 'TRAIN-VALIDATION' end, case when cast(lv as date) >= cast(ft as date) then 'VALIDATION-TEST' end, case when cast(lt as date) >= cast(ft as date) then 'TRAIN-TEST' end) as bad from span) z where bad <> ''
union all select 'INSIDE_EMBARGO', concat(fold, '/', sample_id), role from x where idx between v1 + 1 and v1 + {PLAN.embargo} or idx between e1 + 1 and e1 + {PLAN.embargo}
""",
    ("bars", "cal"),
    (*_steps(PLAN), ("broken", BROKEN_ROLES)),
)
def _d1_fold_violations(t):
    right = splits.walk_forward(_samples(t), t.cal, PLAN)
    role = (
        F.when((F.col("role") == "PURGED") & (F.col("fold") % 2 == 0), F.col("block"))
        .when((F.col("role") == "EMBARGO") & (F.col("fold") % 3 == 1), "TEST")
        .when((F.col("role") == "VALIDATION") & F.col("sample_id").startswith("6") & (F.col("fold") % 4 == 2), "TRAIN")
        .otherwise(F.col("role"))
    )
    return splits.fold_violations(right.withColumn("role", role), t.cal, PLAN)


# -- index membership --------------------------------------------------------------

MONTHS = "months as (select min(trade_date) as d from cal group by date_trunc('month', trade_date))"
ASKS = f"""with {MONTHS} select index_id, d as date, d + interval 15 hours + to_days(lag) as asof_ts from (select distinct index_id from membership) i, months, (values (0), (120)) l(lag)"""


def _month_firsts(t):
    return month_first_sessions(t.cal, t.cal.first, t.cal.last).select(F.col("trade_date").alias("date"))


def _asks(t):
    """Every index on every month's first session, as known then and 120 days later; a calendar-sized list per index."""
    days = [r["date"] for r in _month_firsts(t).orderBy("date").collect()]
    return _spread(t.membership.select("index_id").distinct(), days)


def _spread(keys, days):
    dated = keys.withColumn("date", F.explode(F.lit(days)))
    return dated.withColumn("lag", F.explode(F.array(F.lit(0), F.lit(120)))).withColumn("asof_ts", market_close_ts(F.date_add("date", F.col("lag")))).drop("lag")


@case(
    "d2_index_members",
    "index_id:s date:d asof_ts:t security_id:s available_at:t revision_id:s",
    """select index_id, date, asof_ts, security_id, available_at, revision_id from (
  select a.index_id, a.date, a.asof_ts, m.security_id, m.available_at, m.revision_id, m.is_member, row_number() over (partition by a.index_id, a.date, a.asof_ts, m.security_id order by m.available_at desc, m.revision_id desc) as rn
  from asks a join membership m on m.index_id = a.index_id and m.effective_from <= a.date and (m.effective_to is null or a.date < m.effective_to) and m.available_at <= a.asof_ts) x where rn = 1 and is_member""",
    ("membership", "cal"),
    (("asks", ASKS),),
)
def _d2(t):
    return membership.members_at(t.membership, _asks(t))


STAMPS = ("2018-06-29 15:00:00", "2020-03-31 15:00:00", "2024-12-31 15:00:00")


@case(
    "d2_known_intervals",
    "asof_ts:t index_id:s security_id:s effective_from:d effective_to:d",
    """
select asof_ts, index_id, security_id, min(day) as effective_from, case when max(day) < (select max(day) from days) then max(day) + 1 end as effective_to from (
  select *, day - cast(row_number() over (partition by asof_ts, index_id, security_id order by day) as integer) as island from best where is_member) x group by asof_ts, index_id, security_id, island
""",
    ("membership",),
    (
        ("stamps", "select cast(s as timestamp) as asof_ts from (values " + ", ".join(f"('{s}')" for s in STAMPS) + ") v(s)"),
        ("days", "select cast(unnest(range(lo, hi + interval 1 day, interval 1 day)) as date) as day from (select min(effective_from) as lo, max(greatest(effective_from, coalesce(effective_to, effective_from))) as hi from membership) b"),
        (
            "best",
            """select asof_ts, index_id, security_id, day, max({'a': available_at, 'r': revision_id, 'm': is_member}).m as is_member
from stamps join membership m on m.available_at <= asof_ts join days d on d.day >= m.effective_from and (m.effective_to is null or d.day < m.effective_to) group by 1, 2, 3, 4""",
        ),
    ),
)
def _d2_intervals(t):
    return membership.known_intervals(t.membership, STAMPS)


@case(
    "d2_membership_violations",
    "check:s key:s detail:s",
    """
with b as (select *, coalesce(index_id, '') || case when index_id is null then '' else '/' end || security_id || '/' || cast(effective_from as varchar) || '/' || revision_id as key from broken),
ok as (select * from b where index_id is not null)
select 'MEMBERSHIP_FIELD_MISSING' as "check", key, '' as detail from b where index_id is null
union all select 'EMPTY_MEMBERSHIP', key, cast(effective_to as varchar) from b where effective_to <= effective_from
union all select 'AVAILABLE_BEFORE_ANNOUNCED', key, cast(available_at as varchar) from b where available_at < announcement_at
union all select 'CONTRADICTORY_MEMBERSHIP', x.index_id || '/' || x.security_id || '/' || cast(greatest(x.effective_from, y.effective_from) as varchar) || '/' || x.revision_id, cast(x.available_at as varchar)
  from ok x join ok y on x.index_id = y.index_id and x.security_id = y.security_id and x.available_at = y.available_at and x.revision_id = y.revision_id and x.is_member and not y.is_member
  and greatest(x.effective_from, y.effective_from) < least(coalesce(x.effective_to, date '9999-01-01'), coalesce(y.effective_to, date '9999-01-01'))
""",
    ("membership",),
    (
        (
            "broken",
            """select case when cast(revision_id as bigint) % 97 = 3 then null else index_id end as index_id, security_id, effective_from,
  case when cast(revision_id as bigint) % 89 = 5 then effective_from else effective_to end as effective_to, is_member, available_at,
  case when cast(revision_id as bigint) % 7 = 2 then 'same' else revision_id end as revision_id,
  available_at + to_days(cast(case when cast(revision_id as bigint) % 83 = 1 then 1 else -1 end as integer)) as announcement_at from membership""",
        ),
    ),
)
def _d2_violations(t):
    n = F.col("revision_id").cast("bigint")
    rows = t.membership.select(
        F.when(n % 97 != 3, F.col("index_id")).alias("index_id"),
        "security_id",
        "effective_from",
        F.when(n % 89 == 5, F.col("effective_from")).otherwise(F.col("effective_to")).alias("effective_to"),
        "is_member",
        "available_at",
        F.when(n % 7 == 2, "same").otherwise(F.col("revision_id")).alias("revision_id"),
        (F.col("available_at") + F.when(n % 83 == 1, F.expr("interval 1 day")).otherwise(F.expr("interval -1 day"))).alias("announcement_at"),
    )
    return membership.membership_violations(rows)


# -- fundamental releases ----------------------------------------------------------

RELEASE_ASKS = f"""with {MONTHS} select security_id, metric_name, d + interval 15 hours as asof_ts from (select distinct security_id, metric_name from releases) k, months"""
NOW = """select *, row_number() over (partition by security_id, metric_name, asof_ts order by report_period_end desc nulls last, available_at desc, filing_version desc) as rn
from (select a.security_id, a.metric_name, a.asof_ts, r.report_period_end, r.available_at, r.filing_version, r.metric_value
  from asks a left join releases r on r.security_id = a.security_id and r.metric_name = a.metric_name and r.available_at <= a.asof_ts) x"""


def _release_asks(t):
    days = [r["date"] for r in _month_firsts(t).orderBy("date").collect()]
    return t.releases.select("security_id", "metric_name").distinct().withColumn("asof_ts", F.explode(F.transform(F.lit(days), lambda d: market_close_ts(d))))


@case(
    "d3_latest_release",
    "security_id:s metric_name:s asof_ts:t report_period_end:d available_at:t filing_version:i metric_value:f2",
    "select * from now where rn = 1",
    ("releases", "cal"),
    (("asks", RELEASE_ASKS), ("now", NOW)),
)
def _d3(t):
    return releases.latest_release(_release_asks(t), t.releases)


@case(
    "d3_year_on_year",
    "security_id:s metric_name:s asof_ts:t report_period_end:d metric_value:f2 prior_period_end:d prior_available_at:t prior_metric_value:f2 growth:f8",
    """
select security_id, metric_name, asof_ts, report_period_end, metric_value, prior_period_end, prior_available_at, prior_metric_value, case when prior_metric_value > 0 then cast(metric_value as double) / cast(prior_metric_value as double) - 1 end as growth from (
  select n.*, last_day(n.report_period_end - interval 12 months) as prior_period_end, p.available_at as prior_available_at, p.metric_value as prior_metric_value,
    row_number() over (partition by n.security_id, n.metric_name, n.asof_ts order by p.available_at desc nulls last, p.filing_version desc) as pn
  from (select * exclude (rn) from now where rn = 1) n left join releases p on p.security_id = n.security_id and p.metric_name = n.metric_name and p.report_period_end = last_day(n.report_period_end - interval 12 months) and p.available_at <= n.asof_ts) x where pn = 1
""",
    ("releases", "cal"),
    (("asks", RELEASE_ASKS), ("now", NOW)),
)
def _d3_growth(t):
    return releases.year_on_year(_release_asks(t), t.releases)


@case(
    "d3_release_history",
    "security_id:s metric_name:s report_period_end:d available_at:t filing_version:i metric_value:f2 previous_value:f2 newest_period:d kind:s",
    """
with p as (select f.security_id, f.metric_name, f.report_period_end, f.available_at, f.filing_version, f.metric_value, q.metric_value as previous_value, q.filing_version is not null as has,
    row_number() over (partition by f.filing_version order by q.available_at desc nulls last, q.filing_version desc) as rn,
    (select max(z.report_period_end) from releases z where z.security_id = f.security_id and z.metric_name = f.metric_name and z.available_at < f.available_at) as newest_period
  from releases f left join releases q on q.security_id = f.security_id and q.metric_name = f.metric_name and q.report_period_end = f.report_period_end and q.available_at < f.available_at)
select *, case when has and metric_value is not distinct from previous_value then 'REPEAT' when newest_period > report_period_end and not has then 'LATE_FIRST_FILING' when newest_period > report_period_end then 'LATE_RESTATEMENT'
  when not has then 'FIRST_FILING' else 'RESTATEMENT' end as kind from p where rn = 1
""",
    ("releases",),
)
def _d3_history(t):
    return releases.release_history(t.releases)


@case(
    "d3_release_violations",
    "check:s key:s detail:s",
    """
with b as (select *, concat_ws('/', security_id, metric_name, cast(report_period_end as varchar), cast(filing_version as varchar)) as key from broken)
select 'RELEASE_FIELD_MISSING' as "check", key, '' as detail from b where metric_name is null
union all select 'KNOWN_BEFORE_PERIOD_END', key, cast(available_at as varchar) from b where cast(available_at as date) <= report_period_end
union all select 'AVAILABLE_BEFORE_ANNOUNCED', key, cast(available_at as varchar) from b where available_at < announcement_at
union all select 'MIXED_CURRENCY', concat_ws('/', security_id, metric_name), cast(count(distinct currency) as varchar) from b group by security_id, metric_name having count(distinct currency) > 1
union all select 'CONTRADICTORY_FILING', concat_ws('/', security_id, metric_name, cast(report_period_end as varchar), cast(filing_version as varchar)), cast(available_at as varchar)
  from b group by security_id, metric_name, report_period_end, available_at, filing_version having min(metric_value) <> max(metric_value) or (count(metric_value) > 0 and count(metric_value) < count(*))
""",
    ("releases",),
    (
        (
            "broken",
            """select security_id, case when filing_version % 101 = 4 then null else metric_name end as metric_name, report_period_end, metric_value,
  case when filing_version % 71 = 6 then report_period_end + interval 15 hours else available_at end as available_at,
  case when filing_version % 73 = 6 then available_at + interval 1 hour else available_at - interval 300 days end as announcement_at,
  filing_version % 4 as filing_version, case when security_id like '3%' and filing_version % 500 < 3 then 'HKD' else 'CNY' end as currency from releases""",
        ),
    ),
)
def _d3_violations(t):
    n = F.col("filing_version")
    rows = t.releases.select(
        "security_id",
        F.when(n % 101 != 4, F.col("metric_name")).alias("metric_name"),
        "report_period_end",
        "metric_value",
        F.when(n % 71 == 6, market_close_ts("report_period_end")).otherwise(F.col("available_at")).alias("available_at"),
        F.when(n % 73 == 6, F.col("available_at") + F.expr("interval 1 hour")).otherwise(F.col("available_at") - F.expr("interval 300 days")).alias("announcement_at"),
        (n % 4).alias("filing_version"),
        F.when(F.col("security_id").startswith("3") & (n % 500 < 3), "HKD").otherwise("CNY").alias("currency"),
    )
    return releases.release_violations(rows)


# -- incremental build -------------------------------------------------------------

INCREMENTAL_ASOF = "2030-01-01 15:00:00"
INCREMENTAL_SPLIT = "2020-06-30"
BUCKETS = 4


def _store(t):
    return t.shared("incremental-store", lambda: _build_store(t))


def _build_store(t):
    """Bars in three appends: the first half with wrong closes in its last year, the second half, and the corrections."""
    store = incremental.Store(f"{checkpoint_root(t.spark)}/store-{uuid.uuid4().hex}", BUCKETS)
    bars = t.sparse.select("security_id", "trade_date", "close")
    wrong = F.when(F.col("trade_date") >= F.lit("2019-09-30").cast("date"), F.col("close") + 1).otherwise(F.col("close")).cast("decimal(18,6)")
    split = F.lit(INCREMENTAL_SPLIT).cast("date")
    parts = (bars.where(F.col("trade_date") <= split).withColumn("close", wrong), bars.where(F.col("trade_date") > split), bars.where(F.col("trade_date") <= split))
    for rows in parts:
        changed = incremental.append_bars(t.spark, store, rows)
        incremental.extend_growth(t.spark, store, t.actions, t.cal, INCREMENTAL_ASOF, changed)
    return store


GROWTH_STEPS = (
    ("ca", "select * from (select *, row_number() over (partition by security_id, ex_date, action_type order by available_at desc) as rn from actions) x where rn = 1"),
    (
        "inputs",
        """select security_id, ex_date, sum(case when action_type <> 'RIGHTS_ISSUE' then cast(cash_dividend_per_share as double) else 0 end) as cash, sum(case when action_type <> 'RIGHTS_ISSUE' then cast(share_ratio as double) else 0 end) as split,
  sum(case when action_type = 'RIGHTS_ISSUE' then cast(share_ratio as double) else 0 end) as rr, sum(case when action_type = 'RIGHTS_ISSUE' then cast(share_ratio as double) * coalesce(cast(rights_price_per_share as double), 0) else 0 end) as paid,
  max(case when action_type = 'SPIN_OFF' or (action_type = 'RIGHTS_ISSUE' and rights_price_per_share is null) then 1 else 0 end) as bad from ca group by 1, 2""",
    ),
    ("seq", "select security_id, trade_date, session_idx, close, lag(close) over w as prev, session_idx - lag(session_idx) over w as gap from sparse window w as (partition by security_id order by trade_date)"),
    (
        "growing",
        """select s.security_id, s.trade_date, case when close is null or prev is null then 'NO_DATA' when gap <> 1 or bad = 1 then 'BLOCKED' else 'OK' end as status,
  case when close is null or prev is null or gap <> 1 or bad = 1 then 1.0 else cast(close as double) * (1 + coalesce(split, 0) + coalesce(rr, 0)) / (cast(prev as double) - coalesce(cash, 0) + coalesce(paid, 0)) end as g
from seq s left join inputs i on i.security_id = s.security_id and i.ex_date = s.trade_date""",
    ),
)


@case(
    "d5_incremental_growth",
    "security_id:s trade_date:d status:s cum_growth:f6",
    "select security_id, trade_date, status, product(g) over (partition by security_id order by trade_date rows unbounded preceding) as cum_growth from growing",
    ("sparse", "actions", "cal", "bars_src"),
    GROWTH_STEPS,
)
def _d5(t):
    return incremental.read(t.spark, _store(t), incremental.GROWTH)


@case(
    "d5_incremental_equals_full",
    "year:i bucket:i rows:i same_bars:b same_growth:b",
    f"select year(trade_date) as year, cast(('0x' || substr(md5(security_id), 1, 8)) as bigint) % {BUCKETS} as bucket, count(*) as rows, true as same_bars, true as same_growth from sparse group by 1, 2",
    ("sparse", "bars", "bars_src"),
)
def _d5_equal(t):
    """Digests of the store of three appends, after a rerun of the last one, beside those of a store built at once."""
    store = _store(t)
    full = incremental.Store(f"{checkpoint_root(t.spark)}/store-{uuid.uuid4().hex}", BUCKETS)
    bars = t.sparse.select("security_id", "trade_date", "close")
    incremental.extend_growth(t.spark, full, t.actions, t.cal, INCREMENTAL_ASOF, incremental.append_bars(t.spark, full, bars))
    again = incremental.append_bars(t.spark, store, bars.where(F.col("trade_date") <= F.lit(INCREMENTAL_SPLIT).cast("date")))
    incremental.extend_growth(t.spark, store, t.actions, t.cal, INCREMENTAL_ASOF, again)
    both = None
    for name in (incremental.BARS, incremental.GROWTH):
        own, other = (incremental.digests(t.spark, s, name).select("year", "bucket", "rows", F.col("fingerprint").alias(f)) for s, f in ((store, "_own"), (full, "_other")))
        same = own.join(other, ["year", "bucket", "rows"], "full_outer").select("year", "bucket", "rows", F.col("_own").eqNullSafe(F.col("_other")).alias(f"same_{name}"))
        both = same if both is None else both.join(same, ["year", "bucket", "rows"], "full_outer")
    return both
