"""Corporate actions: rights terms, pricing inputs, versions and applied events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import FACTOR_ACTION_TYPES, LEDGER_ACTION_TYPES, RIGHTS_ISSUE, ContractViolation
from tidemark.functions.scalars import decimal_or_zero, market_close_ts, money, timestamp_literal
from tidemark.operators.pit import latest_revision

MISSING_RATIO = "RIGHTS_ISSUE missing rights_ratio/share_ratio; cannot construct PIT factor"
MISSING_PRICE = "RIGHTS_ISSUE missing rights_price/rights_price_per_share; cannot construct PIT factor"


def _present(df: DataFrame, names: Sequence[str]) -> Column:
    found = [F.col(name).cast("decimal(18,6)") for name in names if name in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("decimal(18,6)")


def with_rights_terms(actions: DataFrame) -> DataFrame:
    """Add ``rights_terms_ratio``, ``rights_terms_price`` and ``rights_reason`` for rights issues."""
    rights = F.col("action_type") == RIGHTS_ISSUE
    ratio = F.when(rights, _present(actions, ("rights_ratio", "share_ratio")))
    price = F.when(rights, _present(actions, ("rights_price", "rights_price_per_share")))
    reason = F.when(rights & ratio.isNull(), MISSING_RATIO).when(rights & (ratio > 0) & price.isNull(), MISSING_PRICE)
    return actions.withColumns({"rights_terms_ratio": ratio, "rights_terms_price": price, "rights_reason": reason})


def pricing_inputs(
    actions: DataFrame,
    cash_basis: str = "dividend",
    key: Sequence[str] = ("security_id", "ex_date"),
    supported: Sequence[str] = FACTOR_ACTION_TYPES,
) -> DataFrame:
    """One row per (security, ex-date) from the latest revision of each action type.

    ``cash_basis='dividend'`` prices with the cash column and blocks on an
    unsupported type. ``cash_basis='deduction'`` prefers the ex-right deduction per
    row, ignores other types, and rounds the cash to cents when no row used one.
    """
    if cash_basis not in ("dividend", "deduction"):
        raise ContractViolation(f"unknown cash basis: {cash_basis}")
    rows = with_rights_terms(actions)
    kind = F.col("action_type")
    rights = kind == RIGHTS_ISSUE
    priced = kind.isin(*LEDGER_ACTION_TYPES) if cash_basis == "deduction" else ~rights
    deduction = F.lit(None).cast("decimal(18,6)")
    if cash_basis == "deduction" and "ex_right_cash_deduction_per_share" in actions.columns:
        deduction = F.col("ex_right_cash_deduction_per_share").cast("decimal(18,6)")
    cash = F.coalesce(deduction, decimal_or_zero("cash_dividend_per_share"))
    zero = F.lit(0).cast("decimal(18,6)")
    unsupported = F.when(~kind.isin(*supported), F.struct(kind.alias("t"), F.concat(F.lit("UNSUPPORTED_CA_TYPE:"), kind).alias("r")))
    failed = F.when(F.col("rights_reason").isNotNull(), F.struct(kind.alias("t"), F.col("rights_reason").alias("r")))
    grouped = rows.groupBy(*key).agg(
        F.sum(F.when(priced, cash).otherwise(zero)).alias("_cash"),
        F.max(priced & deduction.isNotNull()).alias("_deducted"),
        F.sum(F.when(priced, decimal_or_zero("share_ratio")).otherwise(zero)).alias("split_ratio"),
        F.sum(F.when(rights, F.coalesce(F.col("rights_terms_ratio"), zero)).otherwise(zero)).alias("rights_ratio"),
        F.sum(F.when(rights, F.coalesce(F.col("rights_terms_ratio") * F.coalesce(F.col("rights_terms_price"), zero), F.lit(0))).otherwise(F.lit(0))).alias("rights_consideration"),
        F.sort_array(F.collect_set("action_type")).alias("action_types"),
        F.min(unsupported).alias("_unsupported"),
        F.min(failed).alias("_failed"),
    )
    cash_total = F.when(F.col("_deducted"), F.col("_cash")).otherwise(money("_cash")) if cash_basis == "deduction" else F.col("_cash")
    reason = F.col("_failed.r") if cash_basis == "deduction" else F.coalesce(F.col("_unsupported.r"), F.col("_failed.r"))
    weighted = F.when(F.col("rights_ratio") > 0, F.col("rights_consideration").cast("decimal(24,12)") / F.col("rights_ratio").cast("decimal(8,6)")).otherwise(F.lit(0))
    return grouped.select(
        *key,
        cash_total.cast("decimal(18,6)").alias("cash"),
        F.col("split_ratio").cast("decimal(18,6)").alias("split_ratio"),
        F.col("rights_ratio").cast("decimal(18,6)").alias("rights_ratio"),
        F.col("rights_consideration").cast("decimal(24,12)").alias("rights_consideration"),
        weighted.cast("decimal(18,6)").alias("rights_price"),
        "action_types",
        reason.alias("input_reason"),
    )


def visible_inputs(actions: DataFrame, asof_ts: object, cash_basis: str = "dividend") -> DataFrame:
    return pricing_inputs(latest_revision(actions.where(F.col("available_at") <= timestamp_literal(asof_ts))), cash_basis)


def versioned_inputs(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pricing inputs as known at the ex-date's own close, and every later version.

    A later version exists only when a revision lands after the ex-date's close; it
    is valid from that stamp. The second frame is empty in the normal case.
    """
    on_time = actions.where(F.col("available_at") <= market_close_ts("ex_date"))
    base = pricing_inputs(latest_revision(on_time))
    cuts = actions.where(F.col("available_at") > market_close_ts("ex_date")).select("security_id", "ex_date", F.col("available_at").alias("valid_from")).distinct()
    known = cuts.join(actions, ["security_id", "ex_date"]).where(F.col("available_at") <= F.col("valid_from"))
    newest = latest_revision(known, ("security_id", "ex_date", "action_type", "valid_from"))
    return base, pricing_inputs(newest, key=("security_id", "ex_date", "valid_from"))


def actions_on_ex_date(bars: DataFrame, actions: DataFrame, asof_ts: object, cash_basis: str = "dividend") -> DataFrame:
    """Bars left-joined to the collapsed actions of their own date."""
    inputs = visible_inputs(actions, asof_ts, cash_basis).withColumnRenamed("ex_date", "trade_date")
    return bars.join(inputs, ["security_id", "trade_date"], "left")


def orphan_ex_dates(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Ex-dates without a bar row, with the stamp from which they are known."""
    known = actions.groupBy("security_id", F.col("ex_date").alias("trade_date")).agg(F.min("available_at").alias("known_from"))
    return known.join(bars.select("security_id", "trade_date"), ["security_id", "trade_date"], "left_anti").withColumnRenamed("trade_date", "ex_date")


def windows_with_missing_ex_date(actions: DataFrame, bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows ``(security_id, start_date, end_date)`` holding an orphan ex-date between their first and last bar.

    A window's first and last bar come from an aggregate; only the few orphan dates
    (anti join first) meet the windows, on the security.
    """
    inside = windows.join(bars.select("security_id", "trade_date"), "security_id").where(F.col("trade_date").between(F.col("start_date"), F.col("end_date")))
    extents = inside.groupBy("security_id", "start_date", "end_date").agg(F.min("trade_date").alias("_first"), F.max("trade_date").alias("_last"))
    hits = extents.join(orphan_ex_dates(actions, bars), "security_id").where((F.col("ex_date") >= F.col("_first")) & (F.col("ex_date") <= F.col("_last")))
    return hits.groupBy("security_id", "start_date", "end_date").agg(F.min("ex_date").alias("first_missing_ex_date"))


def applied_events(actions: DataFrame, asof_ts: object, supported: Sequence[str] = FACTOR_ACTION_TYPES) -> DataFrame:
    """Per security the visible applicable actions with ex-date up to the as-of, in order."""
    asof = timestamp_literal(asof_ts)
    newest = latest_revision(actions.where(F.col("available_at") <= asof))
    usable = newest.where(F.col("action_type").isin(*supported) & (F.col("ex_date") <= F.to_date(asof)))
    event = F.struct("ex_date", "action_type", "available_at", "source_id", "snapshot_id")
    return usable.groupBy("security_id").agg(F.sort_array(F.collect_list(event)).alias("events"))


def event_intervals(actions: DataFrame, supported: Sequence[str] = FACTOR_ACTION_TYPES) -> DataFrame:
    """Per security the revisions with the interval in which each is the latest one.

    The array holds one security's corporate actions (dozens), never bars or orders.
    """
    distinct = actions.groupBy("security_id", "ex_date", "action_type", "available_at").agg(F.max("source_id").alias("source_id"))
    by_key = Window.partitionBy("security_id", "ex_date", "action_type").orderBy("available_at")
    spans = distinct.withColumn("superseded_at", F.lead("available_at").over(by_key)).where(F.col("action_type").isin(*supported))
    return spans.groupBy("security_id").agg(F.sort_array(F.collect_list(F.struct("ex_date", "action_type", "available_at", "superseded_at", "source_id"))).alias("_events"))


def manifest_text(security_id: Column, events: Column, asof: Column) -> Column:
    """``id:ex_date:type:source`` of the events visible at an as-of, joined by ``;``."""
    live = F.filter(
        events,
        lambda e: (e["available_at"] <= asof) & (e["superseded_at"].isNull() | (e["superseded_at"] > asof)) & (e["ex_date"] <= F.to_date(asof)),
    )
    text = F.array_join(F.transform(live, lambda e: F.concat_ws(":", security_id, e["ex_date"].cast("string"), e["action_type"], e["source_id"])), ";")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("no_visible_ca_events"))
