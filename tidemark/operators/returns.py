"""Corporate-action-adjusted returns for all securities at once.

``timeline`` is the shared physical table: one row per bar with its adjusted
return and *running* values (growth, adjustment, orphan count, next problem row).
Any window (lookback or open-to-open) is then answered from its two end rows, so
cost does not depend on the window length. Running windows partition by security
and are as long as the trading calendar.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import BLOCKED, NO_DATA, OK, STATUS_NORMAL, enforce, violation
from tidemark.functions.pricing import reference_terms
from tidemark.functions.scalars import market_close_ts, timestamp_literal
from tidemark.operators.actions import orphan_ex_dates, pricing_inputs, versioned_inputs, visible_inputs
from tidemark.operators.calendar import SessionCalendar, with_session_idx
from tidemark.operators.pit import latest_revision, pit_query
from tidemark.staging import stage

NO_CLOSE = "MISSING_CLOSE_OR_PREVIOUS_CLOSE"
NOT_ADJACENT = "PREVIOUS_CLOSE_NOT_ADJACENT_TRADING_DAY"
ORPHAN = "CA_EX_DATE_ON_MISSING_BAR_DATE"
NO_BARS = "NO_VISIBLE_DAILY_BARS"


def with_previous_bar(bars: DataFrame) -> DataFrame:
    """Add the previous row's date and close per security; a null close stays null."""
    order = Window.partitionBy("security_id").orderBy("trade_date")
    previous = F.lag(F.struct("trade_date", "close")).over(order)
    return bars.withColumn("_p", previous).withColumns({"previous_date": F.col("_p.trade_date"), "previous_close": F.col("_p.close")}).drop("_p")


def adjacent_session(bars: DataFrame, cal: SessionCalendar) -> DataFrame:
    """Flag rows whose previous row is the previous session."""
    order = Window.partitionBy("security_id").orderBy("trade_date")
    indexed = with_session_idx(bars, cal, "trade_date")
    gap = F.col("session_idx") - F.lag("session_idx").over(order)
    return indexed.withColumn("is_adjacent", F.coalesce(gap == 1, F.lit(False)))


def _priced(rows: DataFrame) -> DataFrame:
    """Status, reference price and growth from previous close, adjacency and inputs."""
    has_action = F.col("action_types").isNotNull()
    zero = F.lit(0).cast("decimal(18,6)")
    terms = reference_terms(
        F.when(has_action, F.col("trade_date")),
        F.col("previous_close"),
        F.coalesce(F.col("cash"), zero),
        F.coalesce(F.col("split_ratio"), zero),
        F.coalesce(F.col("rights_ratio"), zero),
        F.coalesce(F.col("rights_consideration"), zero),
    )
    missing = F.col("close").isNull() | F.col("previous_close").isNull()
    status = F.when(missing, NO_DATA).when(~F.col("is_adjacent"), BLOCKED).when(F.col("input_reason").isNotNull(), BLOCKED).otherwise(OK)
    reason = F.when(missing, F.lit(NO_CLOSE)).when(~F.col("is_adjacent"), F.lit(NOT_ADJACENT)).otherwise(F.col("input_reason"))
    ok = F.col("status") == OK
    priced = rows.withColumn("status", status).withColumn("block_reason", F.when(~ok, reason))
    return priced.withColumns(
        {
            "reference_price": F.when(ok, terms.price.cast("decimal(38,20)")),
            "adjusted_return": F.when(ok, (terms.ratio_of(F.col("close")) - 1).cast("decimal(38,20)")),
            "adjustment": F.when(ok, terms.price.cast("double") / F.col("previous_close").cast("double")),
        }
    )


def _bar_rows(bars: DataFrame, cal: SessionCalendar) -> DataFrame:
    keep = ["security_id", "trade_date", *[c for c in ("open", "close", "trade_status", "snapshot_id") if c in bars.columns]]
    rows = with_session_idx(bars.select(*keep), cal, "trade_date")
    order = Window.partitionBy("security_id").orderBy("trade_date")
    previous = F.lag(F.struct("trade_date", "close", "session_idx")).over(order)
    rows = rows.withColumn("_p", previous).withColumn("bar_no", F.row_number().over(order))
    adjacent = F.coalesce(F.col("session_idx") - F.col("_p.session_idx") == 1, F.lit(False))
    return rows.withColumns({"previous_date": F.col("_p.trade_date"), "previous_close": F.col("_p.close"), "is_adjacent": adjacent}).drop("_p")


def return_points(bars: DataFrame, inputs: DataFrame, cal: SessionCalendar) -> DataFrame:
    """Adjusted return per bar for already visible bars and collapsed actions."""
    rows = _bar_rows(bars, cal)
    return _priced(rows.join(inputs.withColumnRenamed("ex_date", "trade_date"), ["security_id", "trade_date"], "left"))


def daily_adjusted_returns(
    bars: DataFrame,
    actions: DataFrame,
    cal: SessionCalendar,
    asof_ts: object,
    start: object | None = None,
    end: object | None = None,
) -> DataFrame:
    """Per bar: NO_DATA, BLOCKED or OK with ``close / reference - 1``.

    A security whose range holds an ex-date without a bar is BLOCKED over the range.
    """
    visible = pit_query(bars, "daily_bar_raw", asof_ts)
    known = actions.where(F.col("available_at") <= timestamp_literal(asof_ts))
    points = return_points(visible, visible_inputs(actions, asof_ts), cal)
    if start is not None:
        points = points.where(F.col("trade_date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        points = points.where(F.col("trade_date") <= F.lit(str(end)).cast("date"))
    extent = visible
    if start is not None:
        extent = extent.where(F.col("trade_date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        extent = extent.where(F.col("trade_date") <= F.lit(str(end)).cast("date"))
    extent = extent.groupBy("security_id").agg(F.min("trade_date").alias("_lo"), F.max("trade_date").alias("_hi"))
    holes = (
        orphan_ex_dates(known, visible)
        .join(extent, "security_id")
        .where(F.col("ex_date").between(F.col("_lo"), F.col("_hi")))
        .select("security_id", F.lit(True).alias("_hole"))
        .distinct()
    )
    hole = F.col("_hole").isNotNull()
    return (
        points.join(holes, "security_id", "left")
        .withColumns(
            {
                "status": F.when(hole, BLOCKED).otherwise(F.col("status")),
                "block_reason": F.when(hole, ORPHAN).otherwise(F.col("block_reason")),
                "reference_price": F.when(~hole, F.col("reference_price")),
                "adjusted_return": F.when(~hole, F.col("adjusted_return")),
                "adjustment": F.when(~hole, F.col("adjustment")),
                "action_types": F.when(~hole, F.col("action_types")),
            }
        )
        .drop("_hole")
    )


def adjustment_factor(returns: DataFrame, break_on_gap: bool = False) -> DataFrame:
    """Running product of ``1 + r`` over OK rows; other rows carry no factor.

    By default a gap does not restart the product; ``break_on_gap`` starts a new
    segment after each non-OK row.
    """
    order = Window.partitionBy("security_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("status") == OK
    rows = returns.withColumn("_g", F.when(ok, F.col("adjusted_return").cast("double") + 1.0))
    if break_on_gap:
        rows = rows.withColumn("_segment", F.sum(F.when(ok, 0).otherwise(1)).over(order))
        order = Window.partitionBy("security_id", "_segment").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("factor", F.when(ok, F.product("_g").over(order))).drop("_g", "_segment")


# -- timeline ----------------------------------------------------------------------


def timeline(points: DataFrame, orphans: DataFrame) -> DataFrame:
    """Running values per bar; ``orphans`` are ex-dates without a bar row."""
    marked = points.join(_next_bars(points, orphans), ["security_id", "trade_date"], "left")
    security = Window.partitionBy("security_id")
    forward = security.orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    backward = security.orderBy(F.col("bar_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("status") == OK
    growth = F.when(ok, F.col("adjusted_return").cast("double") + 1.0).otherwise(1.0)
    adjust = F.when(ok, F.col("adjustment")).otherwise(1.0)
    here = F.struct(F.col("bar_no").alias("bar_no"), F.col("block_reason").alias("reason"))
    rows = marked.withColumns({"_g": growth, "_a": adjust})
    rows = rows.withColumns(
        {
            "cum_growth": F.product(F.when(F.col("_g") != 0, F.col("_g")).otherwise(1.0)).over(forward),
            "cum_zero": F.sum(F.when(F.col("_g") == 0, 1).otherwise(0)).over(forward),
            "cum_adjust": F.product(F.when(F.col("_a") != 0, F.col("_a")).otherwise(1.0)).over(forward),
            "cum_adjust_zero": F.sum(F.when(F.col("_a") == 0, 1).otherwise(0)).over(forward),
            "cum_orphan": F.sum(F.when(F.col("_orphan"), 1).otherwise(0)).over(forward),
        }
    )
    rows = rows.withColumns(
        {
            "next_block": F.last(F.when(F.col("status") == BLOCKED, here), ignorenulls=True).over(backward),
            "next_nodata": F.last(F.when(F.col("status") == NO_DATA, here), ignorenulls=True).over(backward),
        }
    )
    return rows.drop("_g", "_a", "_orphan")


def _next_bars(points: DataFrame, orphans: DataFrame) -> DataFrame:
    """Bars that directly follow an orphan ex-date (and have a bar before it)."""
    touched = points.join(orphans.select("security_id").distinct(), "security_id", "left_semi")
    rows = touched.select("security_id", F.col("trade_date").alias("d"), F.col("trade_date").alias("bar")).unionByName(
        orphans.select("security_id", F.col("ex_date").alias("d"), F.lit(None).cast("date").alias("bar"))
    )
    later = Window.partitionBy("security_id").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("security_id").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_next", F.last("bar", ignorenulls=True).over(later)).withColumn("_prev", F.last("bar", ignorenulls=True).over(earlier))
    return (
        found.where(F.col("bar").isNull() & F.col("_next").isNotNull() & F.col("_prev").isNotNull())
        .select("security_id", F.col("_next").alias("trade_date"), F.lit(True).alias("_orphan"))
        .distinct()
    )


def asof_timeline(bars: DataFrame, actions: DataFrame, cal: SessionCalendar, asof_ts: object) -> DataFrame:
    """Timeline as seen at one as-of."""
    visible = pit_query(bars, "daily_bar_raw", asof_ts)
    known = actions.where(F.col("available_at") <= timestamp_literal(asof_ts))
    return timeline(return_points(visible, visible_inputs(actions, asof_ts), cal), orphan_ex_dates(known, visible))


@dataclass(frozen=True)
class Timeline:
    """A staged timeline and, per security, its later versions, shared by signals and labels."""

    rows: DataFrame
    late: DataFrame | None


def prepare_timeline(bars: DataFrame, actions: DataFrame, cal: SessionCalendar, ids: DataFrame | None = None, check: bool = True) -> Timeline:
    """Build and stage the timeline of bars that are visible at their own close."""
    if check:
        enforce(late_bar_violations(bars))
    universe = bars if ids is None else bars.join(ids.select("security_id").distinct(), "security_id", "left_semi")
    base, later = versioned_timeline(universe, actions, cal)
    rows = stage(base, "timeline")
    late = stage(late_versions(rows, later), "late-versions")
    return Timeline(rows, None if late.isEmpty() else late)


def late_versions(rows: DataFrame, later: DataFrame) -> DataFrame:
    """Per security an array of its later versions, each as a change against the timeline.

    A version says from when to when it holds, what it multiplies the growth and the adjustment of any
    window over its bar by (zeros are counted apart), how its bar reads then, and the next BLOCKED and
    NO_DATA rows after it. The array holds one security's late actions, which are few, never bars.
    """
    spans = Window.partitionBy("security_id", "bar_no", F.col("status").isNull()).orderBy("valid_from")
    timed = later.withColumn("valid_to", F.when(F.col("status").isNotNull(), F.lead("valid_from").over(spans)))
    here = rows.select("security_id", "bar_no", F.struct("status", "adjusted_return", "adjustment").alias("_base"))
    after = rows.select("security_id", (F.col("bar_no") - 1).alias("bar_no"), F.struct(F.col("next_block").alias("block"), F.col("next_nodata").alias("nodata")).alias("_after"))
    # Merged: a table of all bars is a few megabytes on disk, and forty times that as a map on the driver.
    known = timed.join(here.hint("merge"), ["security_id", "bar_no"], "left").join(after.hint("merge"), ["security_id", "bar_no"], "left")

    def factor(status: Column, value: Column) -> Column:
        return F.when(status == OK, value).otherwise(1.0)

    def change(name: str, late: Column, base: Column) -> list[Column]:
        whole = lambda x: F.when(x != 0, x).otherwise(1.0)
        zero = lambda x: F.when(x == 0, 1).otherwise(0)
        return [(whole(late) / whole(base)).alias(name), (zero(late) - zero(base)).alias(f"{name}_zero")]

    growth = [factor(F.col(f"{p}status"), F.col(f"{p}adjusted_return").cast("double") + 1.0) for p in ("", "_base.")]
    adjust = [factor(F.col(f"{p}status"), F.col(f"{p}adjustment")) for p in ("", "_base.")]
    version = F.struct(
        "bar_no", "valid_from", "valid_to", "status", F.col("block_reason").alias("reason"), *change("growth", *growth), *change("adjust", *adjust), F.col("_after.block").alias("after_block"), F.col("_after.nodata").alias("after_nodata")
    )
    return known.groupBy("security_id").agg(F.collect_list(version).alias("_versions"))


def corrected_windows(windows: DataFrame, line: Timeline, factor: str) -> DataFrame:
    """Windows with ``status``, ``block_reason`` and ``value`` as known at their own as-of.

    ``windows`` carries security_id, start_no, end_no, asof_ts and a struct ``_w`` of the timeline's own answer:
    holes, block and nodata from the start on, product and zeros of ``factor`` (growth or adjust). The late versions
    that hold at the as-of inside the window change that answer: the product by their quotients, and the first
    BLOCKED or NO_DATA row to the least of theirs and of those timeline rows that follow the start or one of them
    and that none of them replaces. The cost is the late versions, however long a window is.
    """
    w = {name: F.col(f"_w.{name}") for name in ("holes", "block", "nodata", "product", "zeros")}
    if line.late is None:
        value = F.when(w["zeros"] > 0, F.lit(0.0)).otherwise(w["product"])
        parts = _outcome(w["holes"], w["block"], w["nodata"], F.col("end_no"), value)
        return windows.select(*[c for c in windows.columns if c != "_w"], *parts)
    inside = F.filter("_versions", lambda v: v["bar_no"].between(F.col("start_no"), F.col("end_no")) & (v["valid_from"] <= F.col("asof_ts")) & (v["valid_to"].isNull() | (v["valid_to"] > F.col("asof_ts"))))
    found = windows.join(line.late, "security_id", "left").withColumn("_hits", F.coalesce(inside, F.array().cast(line.late.schema["_versions"].dataType))).drop("_versions")
    held = found.withColumn("_held", F.filter("_hits", lambda v: v["status"].isNotNull()))
    bars = F.transform("_held", lambda v: v["bar_no"])

    def first(name: str, status: str) -> Column:
        still = F.filter(F.concat(F.array(w[name]), F.transform("_held", lambda v: v[f"after_{name}"])), lambda x: x.isNotNull() & ~F.array_contains("_bars", x["bar_no"]))
        theirs = F.transform(F.filter("_held", lambda v: v["status"] == status), lambda v: F.struct(v["bar_no"].alias("bar_no"), v["reason"].alias("reason")))
        return F.array_min(F.concat(still, theirs))

    merged = held.withColumn("_bars", bars).withColumns(
        {
            "_holes": w["holes"] + F.size(F.filter("_hits", lambda v: v["status"].isNull() & (v["bar_no"] > F.col("start_no")))),
            "_block": first("block", BLOCKED),
            "_nodata": first("nodata", NO_DATA),
            "_product": F.aggregate("_held", w["product"], lambda t, v: t * v[factor]),
            "_zeros": F.aggregate("_held", w["zeros"].cast("long"), lambda t, v: t + v[f"{factor}_zero"]),
        }
    )
    value = F.when(F.col("_zeros") > 0, F.lit(0.0)).otherwise(F.col("_product"))
    parts = _outcome(F.col("_holes"), F.col("_block"), F.col("_nodata"), F.col("end_no"), value)
    return merged.select(*[c for c in windows.columns if c != "_w"], *parts)


def versioned_timeline(bars: DataFrame, actions: DataFrame, cal: SessionCalendar) -> tuple[DataFrame, DataFrame]:
    """Timeline with every value as known at its own close, and the later versions.

    The second frame lists ``(security_id, trade_date, valid_from, ...)`` for bars whose
    return changes when a late action lands, and for late orphan ex-dates. Bars must be
    visible at their own close (enforce ``late_bar_violations`` first).
    """
    base_inputs, late_inputs = versioned_inputs(actions)
    rows = _bar_rows(bars, cal)
    keyed = base_inputs.withColumnRenamed("ex_date", "trade_date")
    points = _priced(rows.join(keyed, ["security_id", "trade_date"], "left"))
    orphans = orphan_ex_dates(actions, bars)
    following = _orphan_targets(rows, orphans)
    on_time = following.where(F.col("known_from") <= market_close_ts("trade_date"))
    base = timeline(points, on_time.select("security_id", "ex_date"))
    late_points = _priced(rows.join(late_inputs.withColumnRenamed("ex_date", "trade_date"), ["security_id", "trade_date"]))
    columns = ["security_id", "trade_date", "bar_no", "valid_from", "status", "block_reason", "adjusted_return", "adjustment"]
    late_holes = following.where(F.col("known_from") > market_close_ts("trade_date")).select(
        "security_id",
        "trade_date",
        "bar_no",
        F.col("known_from").alias("valid_from"),
        F.lit(None).cast("string").alias("status"),
        F.lit(ORPHAN).alias("block_reason"),
        F.lit(None).cast("decimal(38,20)").alias("adjusted_return"),
        F.lit(None).cast("double").alias("adjustment"),
    )
    return base, late_points.select(*columns).unionByName(late_holes)


def _orphan_targets(rows: DataFrame, orphans: DataFrame) -> DataFrame:
    """Each orphan ex-date with the bar that follows it (when one precedes it too)."""
    touched = rows.join(orphans.select("security_id").distinct(), "security_id", "left_semi")
    bar = F.struct("trade_date", "bar_no")
    union = touched.select("security_id", F.col("trade_date").alias("d"), bar.alias("bar"), F.lit(None).cast("timestamp_ntz").alias("known_from")).unionByName(
        orphans.select("security_id", F.col("ex_date").alias("d"), F.lit(None).cast("struct<trade_date:date,bar_no:int>").alias("bar"), "known_from")
    )
    later = Window.partitionBy("security_id").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = union.withColumn("_n", F.last("bar", ignorenulls=True).over(later))
    return found.where(F.col("bar").isNull() & F.col("_n").isNotNull() & (F.col("_n.bar_no") > 1)).select(
        "security_id", F.col("d").alias("ex_date"), "known_from", F.col("_n.trade_date").alias("trade_date"), F.col("_n.bar_no").alias("bar_no")
    )


def late_bar_violations(bars: DataFrame) -> DataFrame:
    close = market_close_ts("trade_date")
    late = (F.col("available_at") > close) | (F.col("event_ts") > close) if "event_ts" in bars.columns else F.col("available_at") > close
    return violation(bars, late, "BAR_NOT_VISIBLE_ON_OWN_DATE", ["security_id", "trade_date"], F.col("available_at"))


def _outcome(orphans: Column, block: Column, nodata: Column, end_no: Column, value: Column) -> list[Column]:
    """Status, reason and value of a window: orphan, else first BLOCKED, else first NO_DATA."""
    blocked = F.coalesce(block["bar_no"] <= end_no, F.lit(False))
    empty = F.coalesce(nodata["bar_no"] <= end_no, F.lit(False))
    hole = F.coalesce(orphans > 0, F.lit(False))
    status = F.when(hole | blocked, BLOCKED).when(empty, NO_DATA).otherwise(OK)
    reason = F.when(hole, F.lit(ORPHAN)).when(blocked, block["reason"]).when(empty, nodata["reason"])
    return [status.alias("status"), reason.alias("block_reason"), F.when(~hole & ~blocked & ~empty, value).alias("value")]


def window_parts(rows: DataFrame, lookback: int) -> DataFrame:
    """Per bar its last ``lookback`` rows (fewer at the start) as start_no, end_no and the struct ``_w`` of :func:`corrected_windows`."""
    if lookback <= 0:
        raise ValueError("lookback must be positive")
    order = Window.partitionBy("security_id").orderBy("bar_no")
    head = order.rowsBetween(Window.unboundedPreceding, 0)
    full = F.col("bar_no") >= lookback

    def at_start(name: str) -> Column:
        return F.when(full, F.lag(name, lookback - 1).over(order)).otherwise(F.first(name).over(head))

    parts = {
        "holes": F.col("cum_orphan") - at_start("cum_orphan"),
        "block": at_start("next_block"),
        "nodata": at_start("next_nodata"),
        "product": F.col("cum_growth") / F.coalesce(F.lag("cum_growth", lookback).over(order), F.lit(1.0)),
        "zeros": F.col("cum_zero") - F.coalesce(F.lag("cum_zero", lookback).over(order), F.lit(0)),
    }
    prepared = rows.select("security_id", "trade_date", "session_idx", F.greatest(F.col("bar_no") - lookback + 1, F.lit(1)).alias("start_no"), F.col("bar_no").alias("end_no"), *[c.alias(f"_{n}") for n, c in parts.items()])
    return prepared.select("security_id", "trade_date", "session_idx", "start_no", "end_no", F.struct(*[F.col(f"_{n}").alias(n) for n in parts]).alias("_w"))


def lookback_windows(rows: DataFrame, lookback: int) -> DataFrame:
    """Per bar the cumulative return over its last ``lookback`` rows (fewer at the start), as the timeline has it."""
    plain = corrected_windows(window_parts(rows, lookback), Timeline(rows, None), "growth")
    return plain.select("security_id", "trade_date", "session_idx", F.col("end_no").alias("bar_no"), "start_no", "status", "block_reason", (F.col("value") - 1.0).alias("value"))


def cumulative_return(bars: DataFrame, actions: DataFrame, cal: SessionCalendar, asof_ts: object, lookback: int) -> DataFrame:
    """Cumulative adjusted return at every bar, all derived at one as-of."""
    return lookback_windows(asof_timeline(bars, actions, cal, asof_ts), lookback).withColumnRenamed("value", "cumulative_return")


def replayed_windows(windows: DataFrame, bars: DataFrame, actions: DataFrame, cal: SessionCalendar) -> DataFrame:
    """``windows`` (security_id, start_no, end_no, asof_ts, others) answered bar by bar, as an audit of the timeline.

    Every bar is priced once per state of knowledge of its own actions (before any is known, then from each stamp
    on), by the pricing of the single-as-of plan. Every window then goes over its own bars and takes each as its
    as-of knew it. It costs the length of every window, but only windows are moved: a security's bars, as many as the
    calendar has sessions, come to them as one array.
    """
    rows = stage(_bar_rows(bars, cal), "bar-rows")
    cuts = actions.where(F.col("available_at").isNotNull()).select("security_id", "ex_date", F.col("available_at").alias("known_from")).distinct()
    met = cuts.join(actions, ["security_id", "ex_date"]).where(F.col("available_at") <= F.col("known_from"))
    key = ("security_id", "ex_date", "known_from")
    inputs = pricing_inputs(latest_revision(met, (*key, "action_type")), key=key)
    states = inputs.unionByName(cuts.select("security_id", "ex_date").distinct(), allowMissingColumns=True).withColumnRenamed("ex_date", "trade_date")
    priced = _priced(rows.join(states, ["security_id", "trade_date"], "left"))
    growth = F.when(F.col("status") == OK, F.col("adjusted_return").cast("double") + 1.0).otherwise(1.0)
    known = F.struct("known_from", "status", F.col("block_reason").alias("reason"), growth.alias("growth"))
    each = priced.groupBy("security_id", "bar_no").agg(F.sort_array(F.collect_list(known)).alias("states"))
    listed = each.groupBy("security_id").agg(F.sort_array(F.collect_list(F.struct("bar_no", "states"))).alias("_bars"))
    hole = F.struct(F.col("bar_no").alias("at"), "known_from")
    holes = _orphan_targets(rows, orphan_ex_dates(actions, bars)).groupBy("security_id").agg(F.collect_list(hole).alias("_gaps"))
    met = windows.join(listed.join(holes, "security_id", "left"), "security_id")

    def at(b: Column) -> Column:
        newest = F.element_at(F.filter(b["states"], lambda v: v["known_from"].isNull() | (v["known_from"] <= F.col("asof_ts"))), -1)
        return F.struct(b["bar_no"].alias("bar_no"), newest.alias("v"))

    def first(status: str) -> Column:
        found = F.get(F.filter("_seen", lambda b: b["v"]["status"] == status), F.lit(0))
        return F.when(found.isNotNull(), F.struct(found["bar_no"].alias("bar_no"), found["v"]["reason"].alias("reason")))

    length = F.greatest(F.col("end_no") - F.col("start_no") + 1, F.lit(0))
    seen = met.withColumn("_seen", F.transform(F.slice("_bars", F.col("start_no"), length), at)).where(F.size("_seen") > 0)
    inside = F.filter("_gaps", lambda h: (h["at"] > F.col("start_no")) & (h["at"] <= F.col("end_no")) & (h["known_from"] <= F.col("asof_ts")))
    folded = seen.select(
        *windows.columns,
        F.coalesce(F.size(inside), F.lit(0)).alias("_holes"),
        first(BLOCKED).alias("_block"),
        first(NO_DATA).alias("_nodata"),
        F.aggregate("_seen", F.lit(1.0), lambda t, b: t * b["v"]["growth"]).alias("_product"),
    )
    parts = _outcome(F.col("_holes"), F.col("_block"), F.col("_nodata"), F.col("end_no"), F.col("_product"))
    return folded.select(*windows.columns, *parts)


def open_to_open_return(pairs: DataFrame, line: Timeline, cal: SessionCalendar) -> DataFrame:
    """Adjusted return between two opens for ``(security_id, entry_date, exit_date, asof_ts)``.

    ``exit_open / (entry_open * product(reference / previous close)) - 1`` over the bars
    after the entry up to the exit. Opens need normal trading on their date.
    """
    rows = line.rows
    checked = pairs.withColumn(
        "exit_date", F.when(F.col("exit_date") <= F.col("entry_date"), F.raise_error(F.lit("exit must be after entry"))).otherwise(F.col("exit_date"))
    )
    located = cal.positions(cal.positions(checked, "entry_date", "_ef", "_em"), "exit_date", "_xf", "_xm").drop("_ef", "_xf")
    usable = F.col("open")
    if "trade_status" in rows.columns:
        usable = F.when(F.col("trade_status").isNull() | (F.col("trade_status") == STATUS_NORMAL), F.col("open"))
    ahead = Window.partitionBy("security_id").orderBy("bar_no")
    edge = rows.select(
        "security_id",
        "trade_date",
        F.struct(
            usable.alias("open"),
            "bar_no",
            "cum_adjust",
            "cum_adjust_zero",
            "cum_orphan",
            F.lead("cum_orphan").over(ahead).alias("cum_orphan_next"),
            F.lead("next_block").over(ahead).alias("block_after"),
            F.lead("next_nodata").over(ahead).alias("nodata_after"),
        ).alias("e"),
    )
    # Merged: as a map of all bars an edge table would go through the driver.
    joined = located.join(edge.select("security_id", F.col("trade_date").alias("entry_date"), F.col("e").alias("a")).hint("merge"), ["security_id", "entry_date"], "left").join(
        edge.select("security_id", F.col("trade_date").alias("exit_date"), F.col("e").alias("b")).hint("merge"), ["security_id", "exit_date"], "left"
    )
    parts = F.struct(
        (F.col("b.cum_orphan") - F.col("a.cum_orphan_next")).alias("holes"),
        F.col("a.block_after").alias("block"),
        F.col("a.nodata_after").alias("nodata"),
        (F.col("b.cum_adjust") / F.col("a.cum_adjust")).alias("product"),
        (F.col("b.cum_adjust_zero") - F.col("a.cum_adjust_zero")).alias("zeros"),
    )
    met = joined.select(
        *pairs.columns,
        F.col("_em"),
        F.col("_xm"),
        F.col("a.open").alias("_eo"),
        F.col("b.open").alias("_xo"),
        (F.col("a.bar_no") + 1).alias("start_no"),
        F.col("b.bar_no").alias("end_no"),
        parts.alias("_w"),
    )
    result = corrected_windows(met, line, "adjust").withColumnsRenamed({"status": "_status", "block_reason": "_reason", "value": "_adjust"})
    early = (
        F.when(~F.col("_em"), F.struct(F.lit(BLOCKED).alias("s"), F.lit("ENTRY_OPEN_DATE_NOT_TRADING_DAY").alias("r")))
        .when(~F.col("_xm"), F.struct(F.lit(BLOCKED).alias("s"), F.lit("EXIT_OPEN_DATE_NOT_TRADING_DAY").alias("r")))
        .when(F.col("_eo").isNull(), F.struct(F.lit(NO_DATA).alias("s"), F.lit("MISSING_ENTRY_OPEN").alias("r")))
        .when(F.col("_xo").isNull(), F.struct(F.lit(NO_DATA).alias("s"), F.lit("MISSING_EXIT_OPEN").alias("r")))
    )
    final = result.withColumn("_early", early)
    stopped = F.col("_early").isNotNull()
    ratio = F.col("_xo").cast("double") / (F.col("_eo").cast("double") * F.col("_adjust")) - 1.0
    return final.select(
        *pairs.columns,
        F.when(stopped, F.col("_early.s")).otherwise(F.col("_status")).alias("status"),
        F.when(stopped, F.col("_early.r")).otherwise(F.col("_reason")).alias("block_reason"),
        F.when(~stopped & (F.col("_status") == OK), ratio).alias("adjusted_return"),
    )
