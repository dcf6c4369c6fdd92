"""Signals, labels and evaluation queries (every session that has enough history)."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tidemark.functions.scalars import market_close_ts
from tidemark.operators import evaluation as ev
from tidemark.operators import labels as lab
from tidemark.operators import lineage, pit, returns, signals
from workload.cases import case

LOOKBACK, SKIP, HOLDING = 26, 4, 5
FIRST = 30
SPEC = lab.LabelSpec(name="forward_5_sessions", holding=HOLDING)
EVALUATION = "2022-12-30 15:00:00"


def _signal_dates(t):
    return t.dates(FIRST, None)


def _label_dates(t):
    return t.dates(FIRST, t.cal.size - SPEC.exit_lag)


def _signal(t):
    """Signal points, staged once: later steps only read them."""
    return t.landed("signal_points", lambda: _build_signal(t))


def _build_signal(t):
    return signals.momentum_signal(t.bars, t.actions, t.cal, t.ids, _signal_dates(t), LOOKBACK, SKIP, line=t.timeline)


def _labels(t):
    return t.landed("future_return_labels", lambda: _build_labels(t))


def _build_labels(t, manifest=False):
    return lab.future_return_labels(t.bars, t.actions, t.cal, t.ids, _label_dates(t), SPEC, manifest=manifest, line=t.timeline)


def _replay_steps(bars: str, prefix: str, windows: str) -> tuple[tuple[str, str], ...]:
    """Brute-force window results: every (window, bar) priced with what its own as-of knew.

    ``windows`` yields ``security_id, wid, cutoff, lo, hi`` (bar dates, both included).
    """
    return (
        (f"{prefix}w", windows),
        (
            f"{prefix}ca",
            f"""select * from (select w.security_id, w.wid, a.ex_date, a.action_type, a.cash_dividend_per_share, a.share_ratio, a.rights_price_per_share,
                 row_number() over (partition by w.security_id, w.wid, a.ex_date, a.action_type order by a.available_at desc) as rn
               from {prefix}w w join actions a on a.security_id = w.security_id and a.ex_date between w.lo and w.hi and a.available_at <= w.cutoff) where rn = 1""",
        ),
        (
            f"{prefix}in",
            f"""select security_id, wid, ex_date,
                 sum(case when action_type <> 'RIGHTS_ISSUE' then cast(cash_dividend_per_share as double) else 0 end) as cash,
                 sum(case when action_type <> 'RIGHTS_ISSUE' then cast(share_ratio as double) else 0 end) as split,
                 sum(case when action_type = 'RIGHTS_ISSUE' then cast(share_ratio as double) else 0 end) as rr,
                 sum(case when action_type = 'RIGHTS_ISSUE' then cast(share_ratio as double) * coalesce(cast(rights_price_per_share as double), 0) else 0 end) as paid,
                 coalesce(min(case when action_type = 'SPIN_OFF' then 'UNSUPPORTED_CA_TYPE:SPIN_OFF' end), max(case when action_type = 'RIGHTS_ISSUE' and rights_price_per_share is null
                   then 'RIGHTS_ISSUE missing rights_price/rights_price_per_share; cannot construct PIT factor' end)) as input_reason
               from {prefix}ca group by 1, 2, 3""",
        ),
        (
            f"{prefix}b",
            f"""select b.security_id, b.trade_date, b.session_idx, b.open, b.close, b.trade_status, row_number() over v as bar_no, lag(b.close) over v as previous_close,
                 b.session_idx - lag(b.session_idx) over v as gap from {bars} b window v as (partition by b.security_id order by b.trade_date)""",
        ),
        (
            f"{prefix}p",
            f"""select w.security_id, w.wid, b.trade_date, b.bar_no,
                 case when b.close is null or b.previous_close is null then 'NO_DATA' when b.gap <> 1 or i.input_reason is not null then 'BLOCKED' else 'OK' end as status,
                 case when b.close is null or b.previous_close is null then 'MISSING_CLOSE_OR_PREVIOUS_CLOSE' when b.gap <> 1 then 'PREVIOUS_CLOSE_NOT_ADJACENT_TRADING_DAY' else i.input_reason end as reason,
                 cast(b.close as double) as close, cast(b.previous_close as double) as prev,
                 (cast(b.previous_close as double) - coalesce(i.cash, 0) + coalesce(i.paid, 0)) / (1 + coalesce(i.split, 0) + coalesce(i.rr, 0)) as ref
               from {prefix}w w join {prefix}b b on b.security_id = w.security_id and b.trade_date between w.lo and w.hi
               left join {prefix}in i on i.security_id = w.security_id and i.wid = w.wid and i.ex_date = b.trade_date""",
        ),
        (
            f"{prefix}h",
            f"""select e.security_id, e.wid, count(*) as holes from (select security_id, wid, min(trade_date) as lo, max(trade_date) as hi from {prefix}p group by 1, 2) e
               join {prefix}ca c on c.security_id = e.security_id and c.wid = e.wid and c.ex_date between e.lo and e.hi
               where not exists (select 1 from {prefix}b b where b.security_id = c.security_id and b.trade_date = c.ex_date) group by 1, 2""",
        ),
        (
            f"{prefix}r",
            f"""select p.security_id, p.wid, max(h.holes) as holes, min(case when status = 'BLOCKED' then bar_no end) as nb, arg_min(reason, bar_no) filter (status = 'BLOCKED') as rb,
                 min(case when status = 'NO_DATA' then bar_no end) as nn, arg_min(reason, bar_no) filter (status = 'NO_DATA') as rn,
                 product(case when status = 'OK' then close/ref else 1.0 end) as growth, product(case when status = 'OK' then ref/prev else 1.0 end) as adjust
               from {prefix}p p left join {prefix}h h on h.security_id = p.security_id and h.wid = p.wid group by 1, 2""",
        ),
    )


def _signal_steps(bars: str = "bars", cutoff: str = "T + interval 15 hours") -> tuple[tuple[str, str], ...]:
    windows = f"""
select security_id, T as wid, {cutoff} as cutoff, min(trade_date) as lo, max(trade_date) as hi from (
  select b.security_id, s.signal_date as T, b.trade_date, row_number() over (partition by b.security_id, s.signal_date order by b.trade_date desc) as back
  from scores s join {bars} b on b.trade_date <= s.score_date) where back <= {LOOKBACK} group by 1, 2"""
    score = f"""
select c.trade_date as signal_date, (select d from dates x where x.rn = (select count(*) from dates y where y.d <= c.trade_date) - {SKIP}) as score_date
from cal c where c.session_idx >= {FIRST}"""
    final = """
select g.security_id, g.signal_date, g.score_date,
  case when r.wid is null then 'NO_DATA' when r.holes > 0 or r.nb is not null then 'BLOCKED' when r.nn is not null then 'NO_DATA' else 'OK' end as status,
  case when r.wid is null then 'NO_VISIBLE_DAILY_BARS' when r.holes > 0 then 'CA_EX_DATE_ON_MISSING_BAR_DATE' when r.nb is not null then r.rb when r.nn is not null then r.rn end as reason,
  case when r.wid is not null and r.holes is null and r.nb is null and r.nn is null then r.growth - 1 end as momentum_score
from (select i.security_id, s.signal_date, s.score_date from (select distinct security_id from bars_src) i cross join scores s) g
left join sr r on r.security_id = g.security_id and r.wid = g.signal_date"""
    ranked = """
select *, case when status = 'OK' then row_number() over (partition by signal_date order by (case when status = 'OK' then 0 else 1 end), round(momentum_score, 12) desc, security_id) end as cross_sectional_rank,
  count(*) filter (status = 'OK') over (partition by signal_date) as universe_size from points0"""
    dates = f"select d, row_number() over (order by d) as rn from (select distinct trade_date as d from {bars})"
    return (("dates", dates), ("scores", score), *_replay_steps(bars, "s", windows), ("points0", final), ("points", ranked))


def _label_steps() -> tuple[tuple[str, str], ...]:
    pairs = f"""
select i.security_id, c.trade_date as signal_date, e.trade_date as entry_date, x.trade_date as exit_date
from (select distinct security_id from bars_src) i cross join cal c join cal e on e.session_idx = c.session_idx + 1 join cal x on x.session_idx = c.session_idx + {SPEC.exit_lag}
where c.session_idx >= {FIRST}"""
    windows = """
select p.security_id, p.signal_date as wid, p.exit_date + interval 15 hours as cutoff, cast(p.entry_date + to_days(1) as date) as lo, p.exit_date as hi from pairs p"""
    final = """
select p.security_id, p.signal_date, p.entry_date, p.exit_date,
  case when a.open is null then 'NOT_TRADABLE_ENTRY' when b.open is null then 'NOT_TRADABLE_EXIT' when r.holes > 0 or r.nb is not null then 'BLOCKED' when r.nn is not null then 'NO_DATA' else 'OK' end as status,
  case when a.open is null then 'MISSING_ENTRY_OPEN' when b.open is null then 'MISSING_EXIT_OPEN' when r.holes > 0 then 'CA_EX_DATE_ON_MISSING_BAR_DATE' when r.nb is not null then r.rb when r.nn is not null then r.rn end as reason,
  case when a.open is not null and b.open is not null and r.holes is null and r.nb is null and r.nn is null then cast(b.open as double) / (cast(a.open as double) * r.adjust) - 1 end as future_return
from pairs p left join lr r on r.security_id = p.security_id and r.wid = p.signal_date
left join (select * from bars where trade_status = '正常') a on a.security_id = p.security_id and a.trade_date = p.entry_date
left join (select * from bars where trade_status = '正常') b on b.security_id = p.security_id and b.trade_date = p.exit_date"""
    return (("pairs", pairs), *_replay_steps("bars", "l", windows), ("labels", final))


BASE = ("bars", "actions", "cal", "bars_src")
SIGNAL_STEPS = _signal_steps()
LABEL_STEPS = _label_steps()
USABLE = f"""
select p.signal_date, p.security_id, p.momentum_score, l.future_return, l.future_return is null as is_missing,
  l.future_return is not null and not (l.exit_date + interval 15 hours <= timestamp '{EVALUATION}') as is_immature,
  l.future_return is not null and l.exit_date + interval 15 hours <= timestamp '{EVALUATION}' as is_usable
from points p left join labels l on l.signal_date = p.signal_date and l.security_id = p.security_id where p.status = 'OK'"""
IC = """
select p.signal_date, r.rank_ic, coalesce(u.n, 0) as sample_size, p.universe_size, coalesce(u.immature, 0) as immature_label_count, coalesce(u.missing, 0) as missing_label_count
from (select signal_date, max(universe_size) as universe_size from points group by 1) p
left join (select signal_date, count(*) filter (is_usable) as n, count(*) filter (is_immature) as immature, count(*) filter (is_missing) as missing from usable group by 1) u using (signal_date)
left join (select signal_date, 1.0 - cast(6 * sum((rs - rr) * (rs - rr)) as double) / cast(count(*) * (count(*) * count(*) - 1) as double) as rank_ic from
  (select signal_date, row_number() over (partition by signal_date order by round(momentum_score, 12) desc, security_id) as rs, row_number() over (partition by signal_date order by round(future_return, 12) desc, security_id) as rr
   from usable where is_usable) group by 1 having count(*) >= 2) r using (signal_date)"""
FULL_STEPS = (*SIGNAL_STEPS, *LABEL_STEPS, ("usable", USABLE), ("ic", IC))


@case(
    "a8_open_to_open_return",
    "security_id:s entry_date:d exit_date:d status:s block_reason:s adjusted_return:f8",
    """select p.security_id, p.entry_date, p.exit_date,
  case when not em or not xm then 'BLOCKED' when a.open is null or b.open is null then 'NO_DATA' when r.holes > 0 or r.nb is not null then 'BLOCKED' when r.nn is not null then 'NO_DATA' else 'OK' end as status,
  case when not em then 'ENTRY_OPEN_DATE_NOT_TRADING_DAY' when not xm then 'EXIT_OPEN_DATE_NOT_TRADING_DAY' when a.open is null then 'MISSING_ENTRY_OPEN' when b.open is null then 'MISSING_EXIT_OPEN'
    when r.holes > 0 then 'CA_EX_DATE_ON_MISSING_BAR_DATE' when r.nb is not null then r.rb when r.nn is not null then r.rn end as block_reason,
  case when em and xm and a.open is not null and b.open is not null and r.holes is null and r.nb is null and r.nn is null then cast(b.open as double) / (cast(a.open as double) * r.adjust) - 1 end as adjusted_return
from (select q.*, exists (select 1 from cal c where c.trade_date = q.entry_date) as em, exists (select 1 from cal c where c.trade_date = q.exit_date) as xm from zpairs q) p
left join zr r on r.security_id = p.security_id and r.wid = p.entry_date
left join (select * from sparse where trade_status = '正常') a on a.security_id = p.security_id and a.trade_date = p.entry_date
left join (select * from sparse where trade_status = '正常') b on b.security_id = p.security_id and b.trade_date = p.exit_date""",
    ("sparse", "bars", "actions", "cal", "bars_src"),
    (
        (
            "zpairs",
            """select security_id, cast(ex_date + to_days(cast(case when n % 17 = 0 then 1 else -14 end as integer)) as date) as entry_date, cast(ex_date + to_days(70) as date) as exit_date from actions_src""",
        ),
        *_replay_steps("sparse", "z", "select security_id, entry_date as wid, exit_date + interval 15 hours as cutoff, cast(entry_date + to_days(1) as date) as lo, exit_date as hi from zpairs"),
    ),
)
def _(t):
    src = t.source("actions_src")
    pairs = src.select(
        "security_id",
        F.date_add("ex_date", F.when(F.col("n") % 17 == 0, 1).otherwise(-14)).alias("entry_date"),
        F.date_add("ex_date", 70).alias("exit_date"),
    ).withColumn("asof_ts", market_close_ts("exit_date"))
    line = returns.prepare_timeline(t.sparse, t.actions, t.cal)
    return returns.open_to_open_return(pairs, line, t.cal)


@case("a9_score_date", "signal_date:d score_date:d", "select * from scores", BASE, SIGNAL_STEPS[:2])
def _(t):
    return signals.score_dates(t.bars, t.cal, _signal_dates(t), SKIP)


SIGNAL_COLUMNS = "signal_date:d security_id:s score_date:d status:s reason:s momentum_score:f8 cross_sectional_rank:f0 universe_size:i"


@case("a10_momentum_signal", SIGNAL_COLUMNS, "select * from points", BASE, SIGNAL_STEPS)
def _(t):
    return _build_signal(t)


@case("a10_momentum_signal_sparse", SIGNAL_COLUMNS, "select * from points", ("sparse", *BASE), _signal_steps("sparse"))
def _(t):
    return signals.momentum_signal(t.sparse, t.actions, t.cal, t.ids, _signal_dates(t), LOOKBACK, SKIP)


DERIVATION = "2030-01-01 15:00:00"


@case("a10_derivation_asof", SIGNAL_COLUMNS, "select * from points", BASE, _signal_steps("bars", f"timestamp '{DERIVATION}'"))
def _(t):
    """Every signal date with returns as known at one later stamp."""
    return signals.momentum_signal(t.bars, t.actions, t.cal, t.ids, _signal_dates(t), LOOKBACK, SKIP, derivation_asof=DERIVATION)


@case(
    "a11_exclusion_counts",
    "signal_date:d status:s excluded:i",
    "select signal_date, status, count(*) as excluded from points where status <> 'OK' group by 1, 2",
    BASE,
    SIGNAL_STEPS,
)
def _(t):
    return signals.exclusion_counts(_signal(t))


@case(
    "a12_join_snapshot_ids",
    "trade_date:d input_snapshot_id:s",
    """select trade_date, string_agg(id, ';' order by id) as input_snapshot_id from (
         select distinct trade_date, concat('snap_', cast(k % 7 as varchar)) as id from bars_src union select distinct trade_date, 'base' from bars_src) group by 1""",
    ("bars_src",),
)
def _(t):
    listed = F.concat(F.lit("base;snap_"), (F.col("k") % 7).cast("string"))
    return lineage.join_snapshot_ids(t.bars_src.withColumn("snapshot_id", listed), ["trade_date"])


def _fingerprint_sql(table: str, by: str, columns: tuple[str, ...], buckets: int, head: str = "") -> str:
    row = ", ".join(f"'{c}': cast({c} as varchar)" for c in sorted(columns))
    lanes = [f"cast(sum(cast(cast(concat('0x', substr(h, {1 + 15 * k}, 15)) as bigint) as hugeint)) as varchar)" for k in range(4)]
    group = f"{by}, " if by else ""
    return f"""select {group}sha256(concat('{head}', string_agg(line, '|' order by line))) as fingerprint, cast(sum(n) as bigint) as rows from (
      select {group}count(*) as n, concat_ws(':', cast(b as varchar), cast(count(*) as varchar), {', '.join(lanes)}) as line
      from (select {group}h, cast(concat('0x', substr(h, 61, 4)) as bigint) % {buckets} as b from (select {group}sha256(to_json({{{row}}})) as h from {table})) group by {group}b) {f'group by {by}' if by else ''}"""


def _signal_hash_sql() -> str:
    points = "(select signal_date, security_id, cast(round(momentum_score, 10) as decimal(28,10)) as momentum_score, cast(cross_sectional_rank as bigint) as cross_sectional_rank, status, reason, score_date, universe_size from points)"
    columns = ("security_id", "momentum_score", "cross_sectional_rank", "status", "reason", "score_date", "universe_size")
    head = '{"input_snapshot_id": "derived", "lookback": "%d", "ranking_method": "ordinal_descending_rank", "skip": "%d"}|' % (LOOKBACK, SKIP)
    return _fingerprint_sql(points, "signal_date", columns, 256, head).replace("as fingerprint", "as signal_manifest_hash")


@case("a13_signal_fingerprint", "signal_date:d signal_manifest_hash:s rows:i", _signal_hash_sql(), BASE, SIGNAL_STEPS)
def _(t):
    return lineage.signal_fingerprint(_signal(t), {"lookback": LOOKBACK, "skip": SKIP, "input_snapshot_id": "derived"})


PRINTED = ("security_id", "trade_date", "open", "high", "low", "close", "volume", "trade_status", "available_at")


@case("a13_table_fingerprint", "fingerprint:s rows:i", _fingerprint_sql("bars", "", PRINTED, 4096), ("bars",))
def _(t):
    return lineage.table_fingerprint(t.bars, PRINTED)


@case("a13_group_fingerprint", "security_id:s fingerprint:s rows:i", _fingerprint_sql("bars", "security_id", PRINTED, 256), ("bars",))
def _(t):
    return lineage.fingerprint(t.bars, ["security_id"], PRINTED)


LABEL_COLUMNS = "signal_date:d security_id:s entry_ts:t exit_ts:t status:s reason:s future_return:f7 label_observed_at:t"


@case(
    "a14_future_return_labels",
    LABEL_COLUMNS,
    "select signal_date, security_id, entry_date + interval 570 minutes as entry_ts, exit_date + interval 570 minutes as exit_ts, status, reason, future_return, exit_date + interval 15 hours as label_observed_at from labels",
    BASE,
    LABEL_STEPS,
)
def _(t):
    return _build_labels(t)


@case(
    "a14_label_manifest",
    "signal_date:d security_id:s corporate_action_manifest:s",
    """with e as (select *, lead(available_at) over (partition by security_id, ex_date, action_type order by available_at) as superseded_at from actions)
select l.signal_date, l.security_id, coalesce(string_agg(case when e.security_id is not null then concat(e.security_id, ':', cast(e.ex_date as varchar), ':', e.action_type, ':', e.source_id) end, ';' order by e.ex_date, e.action_type), 'no_visible_ca_events') as corporate_action_manifest
from labels l left join e on e.security_id = l.security_id and e.action_type <> 'SPIN_OFF' and e.ex_date <= l.exit_date and e.available_at <= l.exit_date + interval 15 hours
  and (e.superseded_at is null or e.superseded_at > l.exit_date + interval 15 hours) and (l.reason is null or l.reason not in ('MISSING_ENTRY_OPEN', 'MISSING_EXIT_OPEN'))
group by 1, 2""",
    BASE,
    LABEL_STEPS,
)
def _(t):
    return _build_labels(t, manifest=True)


@case(
    "a15_is_mature",
    "signal_date:d security_id:s mature:b",
    f"select signal_date, security_id, exit_date + interval 15 hours <= timestamp '{EVALUATION}' as mature from labels",
    BASE,
    LABEL_STEPS,
)
def _(t):
    return _labels(t).withColumn("mature", lab.is_mature(EVALUATION))


IC_COLUMNS = "signal_date:d rank_ic:f8 sample_size:i universe_size:i immature_label_count:i missing_label_count:i"


def _ic(t):
    return ev.rank_ic(_signal(t), _labels(t), EVALUATION)


@case("a16_rank_ic", IC_COLUMNS, "select * from ic", BASE, FULL_STEPS)
def _(t):
    return _ic(t)


@case(
    "a17_coverage",
    "signal_date:d sample_size:i universe_size:i coverage:f8",
    "select signal_date, sample_size, universe_size, case when universe_size > 0 then sample_size / universe_size else 0 end as coverage from ic",
    BASE,
    FULL_STEPS,
)
def _(t):
    return ev.coverage(_ic(t))


@case(
    "a17_coverage_summary",
    "mean_coverage:f8 min_coverage:f8 max_coverage:f8 zero_days:i",
    """with c as (select case when universe_size > 0 then sample_size / universe_size else 0 end as c from ic)
select avg(c) as mean_coverage, min(c) as min_coverage, max(c) as max_coverage, count(*) filter (c = 0) as zero_days from c""",
    BASE,
    FULL_STEPS,
)
def _(t):
    return ev.coverage_summary(_ic(t))


@case(
    "a18_ic_summary",
    "ic_dates:i rank_ic_mean:f8 icir:f8 immature_label_count:i missing_label_count:i",
    """select count(rank_ic) as ic_dates, avg(rank_ic) as rank_ic_mean, avg(rank_ic)/stddev_samp(rank_ic) as icir, sum(immature_label_count) as immature_label_count, sum(missing_label_count) as missing_label_count from ic""",
    BASE,
    FULL_STEPS,
)
def _(t):
    return ev.ic_summary(_ic(t))


QUANTILES = """
select b.quantile, q.mean_future_return, coalesce(q.sample_count, 0) as sample_count from (values (1), (2), (3), (4), (5)) b(quantile) left join (
  select least(5, cast(floor((rn - 1) * 5 / n) as integer) + 1) as quantile, avg(future_return) as mean_future_return, count(*) as sample_count from (
    select *, row_number() over (partition by signal_date order by round(momentum_score, 12) desc, security_id) as rn, count(*) over (partition by signal_date) as n from usable where is_usable) where n >= 2 group by 1) q using (quantile)"""


@case("a19_quantile_returns", "quantile:i mean_future_return:f8 sample_count:i", QUANTILES, BASE, FULL_STEPS)
def _(t):
    return ev.quantile_returns(ev.usable_pairs(_signal(t), _labels(t), EVALUATION))


@case(
    "a20_monotonicity",
    "quantile_monotonicity:s",
    f"""with q as ({QUANTILES}), s as (select mean_future_return as m, lag(mean_future_return) over (order by quantile) as p from q where mean_future_return is not null)
select case when count(*) < 2 then 'INSUFFICIENT' when bool_and(p is null or p <= m) then 'INCREASING' when bool_and(p is null or p >= m) then 'DECREASING' else 'NOT_MONOTONIC' end as quantile_monotonicity from s""",
    BASE,
    FULL_STEPS,
)
def _(t):
    return ev.monotonicity(ev.quantile_returns(ev.usable_pairs(_signal(t), _labels(t), EVALUATION)))


#: Dates with an IC at the scale the oracles run at; the block starts follow from their number.
IC_DATES = 277


def _bootstrap_sql() -> str:
    """The seeded starts as values: start of each block, by iteration and place."""
    generator = random.Random(0)
    per, choices = math.ceil(IC_DATES / ev.BLOCK_LENGTH), range(IC_DATES - ev.BLOCK_LENGTH + 1)
    drawn = ", ".join(f"({i},{k},{generator.choice(choices)})" for i in range(ev.ITERATIONS) for k in range(per))
    low, high = (25 * (ev.ITERATIONS - 1)) // 1000, (975 * (ev.ITERATIONS - 1)) // 1000
    return f"""with series as (select rank_ic, row_number() over (order by signal_date) - 1 as i, count(*) over () as n from ic where rank_ic is not null),
starts(iteration, slot, start) as (values {drawn}),
means as (select iteration, avg(rank_ic) as m from starts, range({ev.BLOCK_LENGTH}) r(k) join series on i = start + k where slot * {ev.BLOCK_LENGTH} + k < {IC_DATES} and n = {IC_DATES} group by 1)
select max(m) filter (pos = {low}) as ci_low, max(m) filter (pos = {high}) as ci_high, 'moving_block_bootstrap_non_iid(block_length={ev.BLOCK_LENGTH},iterations={ev.ITERATIONS})' as ci_method
from (select m, row_number() over (order by m) - 1 as pos from means)"""


@case("a21_block_bootstrap_ci", "ci_low:f8 ci_high:f8 ci_method:s", _bootstrap_sql(), BASE, FULL_STEPS)
def _(t):
    return ev.block_bootstrap_ci(_ic(t))


@case("a23_label_status_counts", "status:s labels:i", "select status, count(*) as labels from labels group by 1", BASE, LABEL_STEPS)
def _(t):
    return ev.label_status_counts(_labels(t))


@case(
    "a23_signal_size_stats",
    "signal_dates:i avg_scorable:f8 min_scorable:i max_scorable:i",
    "select count(*) as signal_dates, avg(n) as avg_scorable, min(n) as min_scorable, max(n) as max_scorable from (select signal_date, count(*) filter (status = 'OK') as n from points group by 1)",
    BASE,
    SIGNAL_STEPS,
)
def _(t):
    return ev.signal_size_stats(_signal(t))


@case(
    "w1_ordinal_rank",
    "o_orderkey:i o_orderdate:d rank:i",
    "select o_orderkey, o_orderdate, row_number() over (partition by o_orderdate order by o_totalprice desc, o_orderkey) as rank from orders",
)
def _(t):
    return t.base("orders").withColumn("rank", signals.ordinal_rank(F.col("o_totalprice"), ["o_orderdate"], "o_orderkey"))


@case(
    "f13_query_labels",
    "security_id:s signal_date:d future_return:f8 status:s",
    """select security_id, signal_date, future_return, status from labels where exit_date = (select trade_date from cal where session_idx = 106)""",
    BASE,
    LABEL_STEPS,
)
def _(t):
    table = _build_labels(t, manifest=True).withColumn("snapshot_id", F.lit("s1")).withColumn("label_spec", F.lit(lab.LABEL_SPEC))
    return lab.query_labels(table, t.master, f"{t.cal.dates[101]} 09:30:00", f"{t.cal.dates[106]} 09:30:00")


def _predictions(t):
    return ev.prediction_frame(_signal(t), _labels(t), _ic(t))


@case(
    "f15_project_signal",
    "signal_asof_ts:t score_asof_ts:t security_id:s signal_status:s momentum_score:f8 cross_sectional_rank:f0",
    "select signal_date + interval 15 hours as signal_asof_ts, score_date + interval 15 hours as score_asof_ts, security_id, status as signal_status, momentum_score, cross_sectional_rank from points",
    BASE,
    SIGNAL_STEPS,
)
def _(t):
    return signals.refuse_future_columns(signals.project_signal(_predictions(t)))


@case(
    "f16_filter_signal_to_tradable",
    "signal_date:d security_id:s status:s universe_size:i",
    """select p.signal_date, p.security_id, p.status, count(*) filter (p.status = 'OK') over (partition by p.signal_date) as universe_size
       from points p join bars b on b.security_id = p.security_id and b.trade_date = p.signal_date where b.trade_status = '正常'""",
    BASE,
    SIGNAL_STEPS,
)
def _(t):
    return signals.tradable_signal(_signal(t), pit.tradable_universe(t.bars))


@case(
    "j8_prediction_frame",
    "signal_asof_ts:t security_id:s signal_status:s signal_exclusion_reason:s momentum_score:f8 label_status:s future_return:f7 label_end_ts:t rank_ic:f8",
    """select p.signal_date + interval 15 hours as signal_asof_ts, p.security_id, p.status as signal_status, p.reason as signal_exclusion_reason, p.momentum_score,
       l.status as label_status, l.future_return, l.exit_date + interval 570 minutes as label_end_ts, i.rank_ic
       from points p left join labels l on l.signal_date = p.signal_date and l.security_id = p.security_id left join ic i on i.signal_date = p.signal_date""",
    BASE,
    FULL_STEPS,
)
def _(t):
    return _predictions(t)


@case(
    "j9_match_labels",
    "signal_date:d security_id:s future_return:f8",
    "select p.signal_date, p.security_id, l.future_return + 1 as future_return from points p left join labels l on l.signal_date = p.signal_date and l.security_id = p.security_id",
    BASE,
    (*SIGNAL_STEPS, *LABEL_STEPS),
)
def _(t):
    labels = _labels(t)
    twice = labels.withColumn("ingest_seq", F.lit(0)).unionByName(labels.withColumn("future_return", F.col("future_return") + 1).withColumn("ingest_seq", F.lit(1)))
    return ev.match_labels(_signal(t), twice).select("*", "label.future_return")


@case(
    "j18_bind_hashes_by_order",
    "signal_date:d security_id:s signal_manifest_hash:s",
    f"select p.signal_date, p.security_id, concat('h', cast(c.session_idx - {FIRST} as varchar)) as signal_manifest_hash from points p join cal c on c.trade_date = p.signal_date",
    BASE,
    SIGNAL_STEPS,
)
def _(t):
    dates = _signal_dates(t)
    points = _signal(t).withColumn("signal_asof_ts", market_close_ts("signal_date"))
    return signals.bind_hashes_by_order(points.drop("signal_date"), t.cal, dates[0], dates[-1], [f"h{i}" for i in range(len(dates))], t.ids)


@case(
    "q20_future_mutation_invariance",
    "security_id:s trade_date:d only_in:s",
    "select security_id, trade_date, '' as only_in from bars where trade_date < date '1990-01-01'",
    ("bars",),
)
def _(t):
    """Changing only rows available after the as-of leaves every earlier answer alone."""
    asof = "2020-06-30 15:00:00"
    later = F.col("available_at") > F.lit(asof).cast("timestamp_ntz")
    bars = t.bars.withColumn("close", F.when(later, F.col("close") * 3).otherwise(F.col("close")).cast("decimal(18,6)"))
    actions = t.actions.withColumn("share_ratio", F.when(later, F.col("share_ratio") + 1).otherwise(F.col("share_ratio")).cast("decimal(18,6)"))
    columns = ["security_id", "trade_date", "status", "block_reason", "adjusted_return"]
    before = returns.daily_adjusted_returns(t.bars, t.actions, t.cal, asof).select(*columns)
    after = returns.daily_adjusted_returns(bars, actions, t.cal, asof).select(*columns)
    return lineage.first_difference(before, after, ["security_id", "trade_date"])


@case(
    "q20_equivalent_paths",
    "status:s compared:i different:i",
    "select status, count(*) as compared, 0 as different from points group by 1",
    BASE,
    SIGNAL_STEPS,
)
def _(t):
    """The many-as-of plan beside every window replayed bar by bar at its own as-of, for all points of all sessions."""
    line = t.timeline
    own = F.col("session_idx") == F.col("score_idx")
    scores = signals.score_dates(line.rows, t.cal, _signal_dates(t), SKIP).where("score_date is not null")
    ends = line.rows.select("security_id", "session_idx", "bar_no").join(F.broadcast(scores), own).select("security_id", "signal_date", F.greatest(F.col("bar_no") - LOOKBACK + 1, F.lit(1)).alias("start_no"), F.col("bar_no").alias("end_no"), market_close_ts("signal_date").alias("asof_ts"))
    replayed = returns.replayed_windows(ends, t.bars, t.actions, t.cal).select("security_id", "signal_date", F.col("status").alias("_s"), F.col("block_reason").alias("_r"), (F.col("value") - 1.0).alias("_v"))
    both = _signal(t).join(replayed, ["security_id", "signal_date"], "full_outer")
    same = F.col("status").eqNullSafe(F.coalesce("_s", F.lit("NO_DATA"))) & (F.col("reason").eqNullSafe(F.col("_r")) | F.col("_s").isNull()) & F.round("momentum_score", 10).eqNullSafe(F.round("_v", 10))
    return both.groupBy("status").agg(F.count("*").alias("compared"), F.sum(F.when(same, 0).otherwise(1)).alias("different"))


@case(
    "q20_first_difference",
    "security_id:s trade_date:d close:f6 only_in:s",
    """select security_id, trade_date, close, 'a' as only_in from bars where close is not null and trade_date >= date '2020-01-01' order by security_id, trade_date limit 1""",
    ("bars",),
)
def _(t):
    """Two tables that differ from a date on: the first differing row by key, as the first table has it."""
    changed = F.when(F.col("trade_date") >= F.lit("2020-01-01").cast("date"), F.col("close") + 1).otherwise(F.col("close")).cast("decimal(18,6)")
    columns = ["security_id", "trade_date", "close"]
    return lineage.first_difference(t.bars.select(*columns), t.bars.withColumn("close", changed).select(*columns), ["security_id", "trade_date"])
