"""Point-in-time visibility: what was knowable at an as-of."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import (
    FACTOR_ACTION_TYPES,
    PIT_DERIVED,
    PIT_TABLES,
    RAW_UNADJUSTED,
    STATUS_NORMAL,
    ContractViolation,
    duplicate_keys,
    require_columns,
    union_all,
    violation,
)
from tidemark.functions.scalars import clock, is_exchange_stamp, market_close_ts, pad_id, timestamp_literal
from tidemark.operators.calendar import SessionCalendar, next_session

MASTER_TAINTED_FIELDS = ("is_st", "status")
COMPANION_SUFFIXES = ("available_at", "point_in_time_capability", "evidence_level")
APPLICABLE = "VISIBLE_APPLICABLE"
UNPROCESSED = "UNPROCESSED_BOUNDARY"
NOT_YET = "NOT_YET_VISIBLE"
UNSUPPORTED = "UNSUPPORTED_TYPE"


def pit_query(
    df: DataFrame,
    table: str,
    asof_ts: object,
    ids: Iterable[str] | DataFrame | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of a table visible at one as-of; the predicate is pushed to the scan.

    Bars also need ``event_ts <= asof``. ``ids`` is a list (pushed as IN) or a table
    (left semi join). The master's tainted fields are masked by their own stamps.
    """
    if table not in PIT_TABLES:
        raise ContractViolation(f"unsupported point-in-time table: {table}")
    require_columns(df, ["available_at"], table)
    asof = timestamp_literal(asof_ts)
    visible = df.where(F.col("available_at") <= asof)
    if table == "daily_bar_raw" and "event_ts" in df.columns:
        visible = visible.where(F.col("event_ts") <= asof)
    if ids is not None:
        require_columns(df, ["security_id"], table)
        if isinstance(ids, DataFrame):
            visible = visible.join(ids.select("security_id").distinct(), "security_id", "left_semi")
        else:
            visible = visible.where(F.col("security_id").isin(sorted({str(i).zfill(6) for i in ids})))
    if table == "security_master":
        visible = mask_future_fields(visible, asof)
    if columns is None:
        return visible
    wanted = list(dict.fromkeys(columns))
    require_columns(visible, wanted, table)
    if table == "security_master":
        wanted = with_companions(wanted, visible.columns)
    return visible.select(*wanted)


def pit_query_many(df: DataFrame, asofs: DataFrame) -> DataFrame:
    """Add ``visible_from``: the first of many as-ofs at which a row is visible.

    Visibility only grows with the as-of, so a table of as-ofs needs one value per
    row instead of one row per (row, as-of) pair: row r is in the answer of as-of t
    exactly when ``visible_from <= t``. As-ofs become one row per calendar day, with the
    day's own as-ofs and the first later one; each row then does one equi lookup on its day.
    """
    stamps = asofs.select(F.col("asof_ts").cast("timestamp_ntz").alias("t")).where(F.col("t").isNotNull())
    earliest = stamps.agg(F.min("t").cast("string")).first()[0]
    if earliest is None:
        raise ContractViolation("no as-of given")
    days = stamps.groupBy(F.to_date("t").alias("_start")).agg(F.array_sort(F.collect_set("t")).alias("_own"), F.min("t").alias("_lo"))
    # One row per day that has an as-of: calendar-sized.
    order = Window.orderBy("_start")
    spans = days.withColumns({"_stop": F.coalesce(F.date_sub(F.lead("_start").over(order), 1), F.col("_start")), "_later": F.lead("_lo").over(order)})
    lookup = spans.select(F.explode(F.sequence("_start", "_stop")).alias("_day"), "_start", "_own", "_later")
    lookup = lookup.select("_day", F.when(F.col("_day") == F.col("_start"), F.col("_own")).alias("_own"), "_later")
    stamp = F.greatest("available_at", "event_ts") if "event_ts" in df.columns else F.col("available_at")
    joined = df.withColumn("_stamp", stamp).withColumn("_day", F.to_date("_stamp")).join(lookup, "_day", "left")
    same_day = F.array_min(F.filter("_own", lambda t: t >= F.col("_stamp")))
    first = F.lit(earliest).cast("timestamp_ntz")
    value = F.when(F.col("_stamp") <= first, first).otherwise(F.coalesce(same_day, F.col("_later")))
    return joined.withColumn("visible_from", value).drop("_stamp", "_day", "_own", "_later")


def asof_view(df: DataFrame, table: str, trade_date: object) -> DataFrame:
    """What a strategy may see on a trade date: visible at its close and dated up to it."""
    day = F.lit(str(trade_date)).cast("date")
    visible = pit_query(df, table, market_close_ts(day))
    if "trade_date" in df.columns:
        visible = visible.where(F.col("trade_date").cast("date") <= day)
    return visible


def mask_future_fields(master: DataFrame, asof: object, fields: Sequence[str] = MASTER_TAINTED_FIELDS) -> DataFrame:
    """Null a field, its as-of and its stamp while the field's own stamp lies ahead."""
    cutoff = timestamp_literal(asof)
    masked = {}
    for name in fields:
        if name not in master.columns:
            continue
        stamp = f"{name}_available_at"
        require_columns(master, [stamp], "security_master")
        known = F.col(stamp) <= cutoff
        for column in (name, f"{name}_as_of", stamp):
            if column in master.columns:
                masked[column] = F.when(known, F.col(column))
    return master.withColumns(masked) if masked else master


def with_companions(columns: Sequence[str], available: Sequence[str]) -> list[str]:
    """Selecting a tainted field also selects its stamp, capability and evidence level."""
    result = list(dict.fromkeys(columns))
    for name in MASTER_TAINTED_FIELDS:
        if name not in columns:
            continue
        for suffix in COMPANION_SUFFIXES:
            companion = f"{name}_{suffix}"
            if companion not in available:
                raise ContractViolation(f"security_master.{name} is missing companion column {companion}")
            if companion not in result:
                result.append(companion)
    return result


def field_capabilities(master: DataFrame, fields: Sequence[str] = MASTER_TAINTED_FIELDS) -> DataFrame:
    """Per tainted field the stamp, capability and evidence of its lowest security id."""
    present = [name for name in fields if name in master.columns]
    aggregates = []
    for name in present:
        for suffix in COMPANION_SUFFIXES:
            column = f"{name}_{suffix}"
            if column in master.columns:
                aggregates.append(F.min_by(F.col(column).cast("string"), F.when(F.col(column).isNotNull(), F.col("security_id"))).alias(column))
    wide = master.agg(*aggregates)
    rows = [
        F.struct(
            F.lit(name).alias("field"),
            *[
                F.coalesce(F.col(f"{name}_{suffix}") if f"{name}_{suffix}" in master.columns else F.lit(None).cast("string"), F.lit("")).alias(suffix)
                for suffix in COMPANION_SUFFIXES
            ],
        )
        for name in present
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def check_exchange_stamps(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Violations for null, naive or non-+08:00 timestamp text."""
    return union_all([violation(df, ~is_exchange_stamp(name), f"NOT_EXCHANGE_TIMESTAMP:{name}", key, F.col(name)) for name in columns])


# -- corporate-action availability -------------------------------------------------


def resolve_available_at(actions: DataFrame, cal: SessionCalendar) -> DataFrame:
    """Add ``resolved_available_at`` and ``availability_reason`` under the disclosure contract.

    Time unknown (flag false): next session after the disclosure date at 09:30, and it
    must precede the ex-date. Time known: the disclosure stamp, never a bare midnight.
    No flag: the stored stamp. A row that cannot be resolved carries its reason.
    """
    for name, dtype in (("disclosure_time_known", "boolean"), ("disclosure_ts", "timestamp_ntz"), ("disclosure_date", "date"), ("available_at", "timestamp_ntz")):
        if name not in actions.columns:
            actions = actions.withColumn(name, F.lit(None).cast(dtype))
    flag = F.col("disclosure_time_known")
    located = next_session(actions, cal, "disclosure_date", out="_visible_day")
    derived = clock("_visible_day", 9, 30)
    midnight = F.date_format("disclosure_ts", "HH:mm:ss") == "00:00:00"
    reason = (
        F.when(flag.isNull(), F.when(F.col("available_at").isNull(), "NO_DISCLOSURE_FLAG_AND_NO_AVAILABLE_AT"))
        .when(flag, F.when(F.col("disclosure_ts").isNull(), "DISCLOSURE_TS_REQUIRED").when(midnight, "DISCLOSURE_TS_IS_MIDNIGHT"))
        .when(F.col("disclosure_date").isNull(), "DISCLOSURE_DATE_REQUIRED")
        .when(F.col("ex_date").isNull(), "EX_DATE_REQUIRED")
        .when(F.col("_visible_day").isNull(), "NO_NEXT_SESSION_AFTER_DISCLOSURE")
        .when(derived >= F.col("ex_date").cast("date").cast("timestamp_ntz"), "NOT_VERIFIABLE_BEFORE_EX_DATE")
    )
    value = F.when(flag.isNull(), F.col("available_at")).when(flag, F.col("disclosure_ts")).otherwise(derived)
    return (
        located.withColumn("availability_reason", reason)
        .withColumn("resolved_available_at", F.when(F.col("availability_reason").isNull(), value))
        .drop("_visible_day")
    )


def materialize_available_at(actions: DataFrame, cal: SessionCalendar) -> DataFrame:
    """Write the derived stamp on rows that declare a disclosure flag, keep the rest."""
    if "disclosure_time_known" not in actions.columns:
        return actions
    resolved = resolve_available_at(actions, cal)
    return resolved.withColumn(
        "available_at",
        F.when(F.col("disclosure_time_known").isNotNull(), F.col("resolved_available_at")).otherwise(F.col("available_at")),
    ).drop("resolved_available_at", "availability_reason")


def availability_violations(actions: DataFrame, cal: SessionCalendar) -> DataFrame:
    resolved = resolve_available_at(actions, cal)
    return violation(resolved, F.col("availability_reason").isNotNull(), "CA_AVAILABILITY", ["security_id", "ex_date"], F.col("availability_reason"))


def visibility_status(action_type: Column, available_at: Column, ex_date: Column, asof: Column, supported: Sequence[str] = FACTOR_ACTION_TYPES) -> tuple[Column, Column]:
    """Status and reason of a corporate action at an application as-of."""
    late = available_at > asof
    asof_day = F.to_date(asof)
    boundary = (ex_date < asof_day) | ((ex_date == asof_day) & (asof <= clock(asof_day, 9)))
    supported_type = action_type.isin(*supported)
    status = F.when(late & boundary, UNPROCESSED).when(late, NOT_YET).when(~supported_type, UNSUPPORTED).otherwise(APPLICABLE)
    reason = (
        F.when(late & boundary, F.lit("CA_AVAILABLE_AFTER_APPLICATION_ASOF"))
        .when(late, F.lit("CA_NOT_YET_VISIBLE_AT_ASOF"))
        .when(~supported_type, F.concat(F.lit("UNSUPPORTED_CA_TYPE:"), action_type))
        .otherwise(F.lit("CA_VISIBLE_AND_APPLICABLE"))
    )
    return status, reason


def classify_visibility(actions: DataFrame, asof_ts: object, supported: Sequence[str] = FACTOR_ACTION_TYPES) -> DataFrame:
    status, reason = visibility_status(F.col("action_type"), F.col("available_at"), F.col("ex_date"), timestamp_literal(asof_ts), supported)
    return actions.withColumn("visibility", status).withColumn("visibility_reason", reason)


def latest_revision(actions: DataFrame, key: Sequence[str] = ("security_id", "ex_date", "action_type")) -> DataFrame:
    """Newest ``available_at`` per key by an aggregate with partial combine (no window)."""
    rest = [name for name in actions.columns if name not in key and name != "available_at"]
    newest = actions.groupBy(*key).agg(F.max(F.struct("available_at", *[F.col(name) for name in rest])).alias("_r"))
    return newest.select(*[F.col(name) if name in key else F.col(f"_r.{name}").alias(name) for name in actions.columns])


def revision_conflicts(actions: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """Revisions with one stamp but different amounts: there is no right one to keep."""
    amounts = [name for name in ("cash_dividend_per_share", "share_ratio", "rights_price_per_share") if name in actions.columns]
    key = ["security_id", "ex_date", "action_type", "available_at"]
    signature = F.concat_ws("|", *[F.coalesce(F.col(name).cast("string"), F.lit("null")) for name in amounts])
    spread = actions.groupBy(*key).agg(F.min(signature).alias("_low"), F.max(signature).alias("_high"))
    if whitelist is not None:
        spread = spread.join(whitelist, key[:3], "left_anti")
    return violation(spread, F.col("_low") != F.col("_high"), "CONFLICTING_REVISIONS", key, F.concat_ws(" vs ", "_low", "_high"))


# -- bar predicates ------------------------------------------------------------------


def visible_on_own_date(bars: DataFrame) -> DataFrame:
    close = market_close_ts("trade_date")
    kept = bars.where(F.col("available_at") <= close)
    return kept.where(F.col("event_ts") <= close) if "event_ts" in bars.columns else kept


def tradable_universe(bars: DataFrame) -> DataFrame:
    """``(trade_date, security_id)`` visible on its own date with normal trading."""
    return visible_on_own_date(bars).where(F.col("trade_status") == STATUS_NORMAL).select("trade_date", pad_id("security_id").alias("security_id")).distinct()


def wrong_basis(df: DataFrame, expected: str, check: str) -> DataFrame:
    """Observed price bases other than the expected one, null included."""
    observed = df.groupBy("price_basis").agg(F.count(F.lit(1)).alias("_n"))
    bad = F.col("price_basis").isNull() | (F.col("price_basis") != expected)
    return violation(observed.withColumn("_b", F.coalesce("price_basis", F.lit("<null>"))), bad, check, ["_b"], F.col("_n"))


def raw_basis_violations(bars: DataFrame) -> DataFrame:
    return wrong_basis(bars, RAW_UNADJUSTED, "BARS_NOT_RAW_UNADJUSTED")


def pit_basis_violations(labels: DataFrame) -> DataFrame:
    return wrong_basis(labels, PIT_DERIVED, "LABELS_NOT_PIT_DERIVED")


def filter_by_ex_date(actions: DataFrame, start: object, end: object) -> DataFrame:
    day = F.col("ex_date").cast("string").try_cast("date")
    return actions.where(day.between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


# -- frozen slices -----------------------------------------------------------------


def freeze_bars(bars: DataFrame, ids: DataFrame, start: object, end: object, snapshot_id: str, suffix: str) -> DataFrame:
    """Subset restamped with a new snapshot id; the source id is kept beside it."""
    if not snapshot_id.endswith(f"_{suffix}"):
        raise ContractViolation(f"snapshot id must end with {suffix}")
    picked = bars.join(ids.select("security_id").distinct(), "security_id", "left_semi").where(
        F.col("trade_date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))
    )
    return picked.withColumn("source_snapshot_id", F.col("snapshot_id")).withColumn("snapshot_id", F.lit(snapshot_id))


def freeze_violations(frozen: DataFrame, ids: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """Missing ids, wrong basis, duplicate keys and empty board or listing date."""
    expected = ids.select("security_id").distinct()
    missing = violation(expected.join(frozen, "security_id", "left_anti"), F.lit(True), "MISSING_SECURITY", ["security_id"])
    checks = [missing, raw_basis_violations(frozen), duplicate_keys(frozen, ["security_id", "trade_date"], "DUPLICATE_BAR")]
    if master is not None:
        picked = expected.join(master, "security_id", "left")
        checks.append(violation(picked, F.col("board").isNull(), "MISSING_BOARD", ["security_id"]))
        checks.append(violation(picked, F.col("list_date").isNull(), "MISSING_LIST_DATE", ["security_id"]))
    return union_all(checks)


def verify_frozen(frozen: DataFrame, snapshot_id: str, expected_rows: int, actions: DataFrame | None = None, expected_fingerprint: str | None = None) -> DataFrame:
    """Re-check a stored slice: rows, snapshot id, basis, action columns and content."""
    from tidemark.operators.lineage import table_fingerprint

    stats = frozen.agg(F.count(F.lit(1)).alias("_n"), F.min("snapshot_id").alias("_lo"), F.max("snapshot_id").alias("_hi"))
    checks = [
        violation(stats, F.col("_n") != expected_rows, "ROW_COUNT", ["_n"], F.lit(str(expected_rows))),
        violation(stats, ~(F.col("_lo").eqNullSafe(snapshot_id) & F.col("_hi").eqNullSafe(snapshot_id)), "SNAPSHOT_ID", ["_lo", "_hi"]),
        raw_basis_violations(frozen),
    ]
    if expected_fingerprint is not None:
        print_ = table_fingerprint(frozen)
        checks.append(violation(print_, F.col("fingerprint") != expected_fingerprint, "CONTENT_FINGERPRINT", ["fingerprint"]))
    if actions is not None:
        if "available_at" in actions.columns:
            raise ContractViolation("a frozen action slice must not store available_at")
        checks.append(violation(actions, ~F.col("disclosure_time_known").eqNullSafe(False), "DISCLOSURE_TIME_NOT_UNKNOWN", ["security_id", "ex_date"]))
        checks.append(duplicate_keys(actions, ["security_id", "ex_date"], "DUPLICATE_ACTION"))
    return union_all(checks)
