"""Data-quality reports and build statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import LEDGER_ACTION_TYPES, STATUS_MISSING, union_all, violation
from tidemark.functions.scalars import clock
from tidemark.operators.calendar import SessionCalendar, next_session, prev_session
from tidemark.operators.pit import materialize_available_at, resolve_available_at

# Red flags, their report names and severity weights.
FLAGS = {
    "close_not_positive": ("收盘价<=0天数", 1000),
    "zero_volume": ("成交量=0天数", 1),
    "pct_over_limit": ("单日涨跌幅绝对值>21%天数", 50),
    "close_jumps": ("收盘价较前日变动>50%天数", 100),
    "duplicate_dates": ("重复日期条数", 500),
    "null_key_fields": ("关键字段NaN条数", 1000),
}
TOP_ORDER = ("score", "null_key_fields", "close_not_positive", "duplicate_dates", "close_jumps", "pct_over_limit", "zero_volume")
KEY_FIELDS = ("open", "high", "low", "close", "volume")


def _jump(limit: float) -> Column:
    previous = F.lag("close").over(Window.partitionBy("security_id").orderBy("trade_date"))
    return F.coalesce(F.abs(F.try_divide(F.col("close").cast("double"), previous.cast("double")) - 1) > limit, F.lit(False))


def close_jumps(bars: DataFrame, limit: float = 0.5) -> DataFrame:
    """Per security the rows whose close moved more than a limit from the previous row."""
    return bars.select("security_id", _jump(limit).alias("_j")).groupBy("security_id").agg(F.count_if("_j").alias("jumps"))


def quality_detail(bars: DataFrame, pct: str = "pct_change", pct_limit: float = 21.0, jump_limit: float = 0.5) -> DataFrame:
    """Coverage, six red-flag counts, the flag list and a weighted score per security."""
    empty = F.lit(False)
    for name in KEY_FIELDS:
        empty = empty | F.col(name).isNull()
    rows = bars.withColumn("_jump", _jump(jump_limit)).withColumn("_empty", empty)
    per_date = rows.groupBy("security_id", "trade_date").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("close") <= 0).alias("_c"),
        F.count_if(F.col("volume") == 0).alias("_v"),
        F.count_if(F.abs(F.col(pct)) > pct_limit).alias("_p"),
        F.count_if("_jump").alias("_j"),
        F.count_if("_empty").alias("_e"),
    )
    detail = per_date.groupBy("security_id").agg(
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
        F.sum("_n").alias("rows"),
        F.sum("_c").alias("close_not_positive"),
        F.sum("_v").alias("zero_volume"),
        F.sum("_p").alias("pct_over_limit"),
        F.sum("_j").alias("close_jumps"),
        F.sum(F.when((F.col("_n") > 1) & F.col("trade_date").isNotNull(), F.col("_n")).otherwise(0)).alias("duplicate_dates"),
        F.sum("_e").alias("null_key_fields"),
    )
    names = F.array_compact(F.array(*[F.when(F.col(key) > 0, F.lit(label)) for key, (label, _) in FLAGS.items()]))
    score = sum((F.col(key) * weight for key, (_, weight) in FLAGS.items()), F.lit(0))
    return detail.withColumns(
        {
            "years": F.round(F.datediff("last_date", "first_date") / 365, 2),
            "any_flag": F.size(names) > 0,
            "flags": F.array_join(names, "; "),
            "score": score,
        }
    )


def quality_summary(detail: DataFrame) -> DataFrame:
    return detail.agg(
        F.count(F.lit(1)).alias("securities"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count_if(F.col("years") >= 10).alias("full_history"),
        F.count_if((F.col("years") >= 5) & (F.col("years") < 10)).alias("five_to_ten_years"),
        F.count_if(F.col("years") < 5).alias("under_five_years"),
        F.count_if(F.col("years") < 2).alias("under_two_years"),
        F.count_if("any_flag").alias("flagged"),
    )


def top_problems(detail: DataFrame, k: int = 15) -> DataFrame:
    """The k highest scores; ties beyond the seven sort keys resolve by id."""
    return detail.where(F.col("score") > 0).orderBy(*[F.col(name).desc() for name in TOP_ORDER], "security_id").limit(k)


def availability_diagnostics(actions: DataFrame) -> DataFrame:
    """How announcement dates relate to ex-dates, as one row; ``zero_lag_ids`` lists the ids."""
    lag = F.datediff(F.col("ex_date"), F.col("announcement_date"))
    marked = actions.withColumn("_lag", lag)
    return marked.agg(
        F.count("announcement_date").alias("announced"),
        F.coalesce(F.avg(F.col("announcement_date").isNotNull().cast("double")), F.lit(0.0)).alias("announced_ratio"),
        F.count_if(F.col("announcement_date").isNull()).alias("fallback_to_ex_date"),
        F.min("_lag").alias("min_lag_days"),
        F.max("_lag").alias("max_lag_days"),
        F.count_if(F.col("_lag") == 0).alias("zero_lag"),
    )


def zero_lag_ids(actions: DataFrame) -> DataFrame:
    """Securities announced on an ex-date, with how often: one row each."""
    return actions.where(F.col("ex_date") == F.col("announcement_date")).groupBy("security_id").agg(F.count(F.lit(1)).alias("zero_lag"))


def _counts(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("item")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(kind).alias("stat"), "item", "value")


def _single(df: DataFrame, stat: str, value: Column) -> DataFrame:
    return df.agg(value.cast("bigint").alias("value")).select(F.lit(stat).alias("stat"), F.lit("").alias("item"), "value")


def action_build_stats(actions: DataFrame, universe: DataFrame) -> DataFrame:
    """Long-format statistics ``(stat, item, value)`` of an action build."""
    without = universe.select("security_id").distinct().join(actions, "security_id", "left_anti")
    return union_all(
        [
            _single(actions, "rows", F.count(F.lit(1))),
            _single(actions, "securities_with_actions", F.count_distinct("security_id")),
            _single(without, "securities_without_actions", F.count(F.lit(1))),
            _counts(actions, "action_type", "action_type"),
            _counts(actions, "source_id", "source_id"),
        ]
    )


def bar_build_stats(bars: DataFrame) -> DataFrame:
    return union_all(
        [
            _single(bars, "rows", F.count(F.lit(1))),
            _single(bars, "securities", F.count_distinct("security_id")),
            _single(bars, "sessions", F.count_distinct("trade_date")),
            _counts(bars, "trade_status", "trade_status"),
            _counts(bars, "source_id", "source_id"),
        ]
    )


def master_build_stats(master: DataFrame) -> DataFrame:
    return union_all(
        [
            _single(master, "securities", F.count(F.lit(1))),
            _counts(master, "board", "board"),
            _single(master, "st", F.count_if(F.col("is_st").cast("string") == "true")),
            _single(master, "missing_list_date", F.count_if(F.col("list_date").isNull())),
        ]
    )


def cash_split_diagnostics(actions: DataFrame) -> DataFrame:
    """Rows whose payout and ex-right deduction differ, and the largest difference."""
    both = actions.where(F.col("ex_right_cash_deduction_per_share").isNotNull())
    gap = F.abs(F.col("cash_dividend_per_share") - F.col("ex_right_cash_deduction_per_share"))
    marked = both.withColumn("_gap", gap)
    # Equal gaps resolve to the smallest key, so one row is well defined.
    order = F.struct(F.col("_gap").alias("g"), (-F.unix_date("ex_date")).alias("d"), F.col("security_id").alias("s"))
    return marked.agg(
        F.count_if(F.col("_gap") > 0).alias("different"),
        F.count_if(F.col("_gap") == 0).alias("same"),
        F.max(order).alias("_m"),
    ).select("different", "same", F.col("_m.s").alias("security_id"), F.date_from_unix_date(-F.col("_m.d")).alias("ex_date"), F.col("_m.g").alias("largest_difference"))


def verification_slots(actions: DataFrame, ids: DataFrame, start: object, end: object, many: int = 12) -> DataFrame:
    """Checklist rows with the security's action count and why a person should look."""
    picked = actions.join(ids.select("security_id").distinct(), "security_id", "left_semi").where(F.col("ex_date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    counts = picked.groupBy("security_id").agg(F.count(F.lit(1)).alias("claimed_count"))
    kind = F.col("action_type")
    focus = F.concat_ws(
        ";",
        F.when(F.col("claimed_count") > many, F.lit("CA_COUNT_GT_3_PER_YEAR")),
        F.when(~kind.isin(*LEDGER_ACTION_TYPES), F.concat(F.lit("COMPLEX_ACTION:"), kind)),
    )
    return picked.join(counts, "security_id").withColumn("manual_focus", focus)


def dependency_coverage(cal: SessionCalendar, start: object, end: object, actions: DataFrame | None = None, back: int = 252, ahead: int = 22) -> DataFrame:
    """First and last signal session, the sessions they depend on, and the ex-date range."""
    inside = cal.sessions.where(F.col("trade_date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    edges = inside.agg(F.min("trade_date").alias("first_signal"), F.max("trade_date").alias("last_signal"))
    bounds = next_session(prev_session(edges, cal, "first_signal", back, "dependency_start"), cal, "last_signal", ahead, "dependency_end")
    if actions is None:
        return bounds
    low = actions.agg(F.min("ex_date")).scalar()
    high = actions.agg(F.max("ex_date")).scalar()
    return bounds.withColumns({"first_ex_date": low, "last_ex_date": high})


def unit_ratio(bars: DataFrame, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """Rows whose amount does not match price times shares: wrong currency or lot units."""
    traded = bars.where((F.col("volume") > 0) & F.col("open").isNotNull() & F.col("close").isNotNull() & F.col("amount").isNotNull())
    ratio = F.col("amount").cast("double") / ((F.col("open") + F.col("close")).cast("double") / 2 * F.col("volume").cast("double"))
    return traded.withColumn("ratio", ratio).where(~((F.col("ratio") > low) & (F.col("ratio") < high)))


def unit_ratio_by_source(bars: DataFrame) -> DataFrame:
    bad = unit_ratio(bars).groupBy("source_id").agg(F.count(F.lit(1)).alias("out_of_range"))
    return bars.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows")).join(bad, "source_id", "left").select("source_id", "rows", F.coalesce("out_of_range", F.lit(0).cast("bigint")).alias("out_of_range"))


def coverage_vs_reference(bars: DataFrame, other: DataFrame) -> DataFrame:
    """Per common security the gaps of first and last date, the row ratio and a verdict."""

    def stats(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("security_id").agg(F.min("trade_date").alias(f"{tag}_lo"), F.max("trade_date").alias(f"{tag}_hi"), F.count(F.lit(1)).alias(f"{tag}_n"))

    active = bars.where(F.col("trade_status") != STATUS_MISSING) if "trade_status" in bars.columns else bars
    joined = stats(active, "a").join(stats(other, "b"), "security_id")
    ratio = F.col("a_n") / F.col("b_n")
    start_gap, end_gap = F.abs(F.datediff("a_lo", "b_lo")), F.abs(F.datediff("a_hi", "b_hi"))
    return joined.select(
        "security_id",
        start_gap.alias("start_gap_days"),
        end_gap.alias("end_gap_days"),
        ratio.alias("row_ratio"),
        ((start_gap <= 180) & (end_gap <= 5) & (ratio > 0.8) & (ratio < 1.3)).alias("consistent"),
    )


def availability_check(actions: DataFrame, cal: SessionCalendar) -> DataFrame:
    """Date-only disclosures must resolve to the next session 09:30 on both paths."""
    date_only = actions.where(F.col("disclosure_time_known").eqNullSafe(False))
    direct = next_session(resolve_available_at(date_only, cal), cal, "disclosure_date", out="_next").withColumn("_want", clock("_next", 9, 30))
    key = ["security_id", "ex_date", "action_type", "revision_id"]
    stored = materialize_available_at(date_only, cal).select(*key, F.col("available_at").alias("_stored"))
    both = direct.join(stored, key, "left")
    return union_all(
        [
            violation(direct, F.col("availability_reason").isNotNull(), "NOT_RESOLVED", key, F.col("availability_reason")),
            violation(direct, F.col("resolved_available_at") != F.col("_want"), "NOT_NEXT_SESSION_0930", key, F.col("resolved_available_at")),
            violation(both, ~F.col("resolved_available_at").eqNullSafe(F.col("_stored")), "PATHS_DISAGREE", key),
        ]
    )


def combined_event_check(returns: DataFrame, inputs: DataFrame) -> DataFrame:
    """Cash-and-stock events: the reference price must use both legs at once."""
    both = inputs.where((F.col("cash") > 0) & (F.col("split_ratio") > 0) & (F.col("rights_ratio") == 0))
    rows = both.withColumnRenamed("ex_date", "trade_date").join(returns.select("security_id", "trade_date", "status", "previous_close", "reference_price"), ["security_id", "trade_date"])
    ok = rows.where("status = 'OK'")
    previous, cash, split = F.col("previous_close").cast("double"), F.col("cash").cast("double"), F.col("split_ratio").cast("double")
    hand = (previous - cash) / (1 + split)
    actual = F.col("reference_price").cast("double")
    return ok.select(
        "security_id",
        F.col("trade_date").alias("ex_date"),
        hand.alias("hand_price"),
        actual.alias("reference_price"),
        ((F.abs(actual - hand) < 1e-9) & (F.abs(actual - (previous - cash)) > 1e-9) & (F.abs(actual - previous / (1 + split)) > 1e-9)).alias("uses_both_legs"),
    )


def diff_sources(a: DataFrame, b: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Rows whose key only one source has, with that source's payload."""
    only_a = a.join(b.select(*keys).distinct(), list(keys), "left_anti").select(F.lit("a").alias("only_in"), *keys, *payload)
    only_b = b.join(a.select(*keys).distinct(), list(keys), "left_anti").select(F.lit("b").alias("only_in"), *keys, *payload)
    return only_a.unionByName(only_b)
