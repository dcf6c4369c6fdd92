"""Contract tables from normalised frames: actions, master, verified records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import BEST_EFFORT, CASH_DIVIDEND, EVIDENCE_TAINTED, STATUS_NORMAL, STOCK_DIVIDEND, UNAVAILABLE, ContractViolation, duplicate_keys, union_all, violation
from tidemark.functions.scalars import board_from_id, close_ts_or_unknown, market_close_ts, pad_id, snapshot_date

CURRENT_ONLY = "CURRENT_SNAPSHOT_ONLY"
STABLE_PREFIX = "STABLE_BY_CODE_PREFIX"
ONE_TIME = "ONE_TIME_EVENT"

MASTER_COLUMNS = (
    "security_id", "name", "list_date", "delist_date", "board", "is_st", "status", "available_at",
    "board_available_at", "board_as_of", "board_point_in_time_capability", "board_evidence_level",
    "is_st_available_at", "is_st_as_of", "is_st_point_in_time_capability", "is_st_evidence_level",
    "status_available_at", "status_as_of", "status_point_in_time_capability", "status_evidence_level",
    "list_date_available_at", "list_date_as_of", "list_date_point_in_time_capability", "list_date_evidence_level",
    "delist_date_available_at", "delist_date_as_of", "delist_date_point_in_time_capability", "delist_date_evidence_level",
    "list_date_source_id", "snapshot_id", "revision_id",
)


def universe_from_bars(bars: DataFrame) -> DataFrame:
    return bars.select(pad_id("security_id").alias("security_id")).distinct().orderBy("security_id")


def attach_action_pit(actions: DataFrame, snapshot_id: str, revision_id: str) -> DataFrame:
    """Availability at 15:00 of the announcement date, or of the ex-date when there is none."""
    announced = F.col("announcement_date").cast("string").try_cast("date") if "announcement_date" in actions.columns else F.lit(None).cast("date")
    day = F.col("ex_date").cast("date")
    return actions.withColumns(
        {
            "ex_date": day,
            "event_ts": market_close_ts(day),
            "available_at": market_close_ts(F.coalesce(announced, day)),
            "snapshot_id": F.lit(snapshot_id),
            "revision_id": F.lit(revision_id),
            "point_in_time_capability": F.lit("ANNOUNCEMENT_DATE_T1500"),
            "evidence_level": F.lit(EVIDENCE_TAINTED),
        }
    )


def build_security_master(
    ids: DataFrame,
    names: DataFrame,
    listings: DataFrame,
    st: DataFrame | None,
    overrides: DataFrame | None,
    as_of: Column,
    snapshot_id: str,
    revision_id: str,
) -> DataFrame:
    """Left joins onto the universe, with field-level availability columns.

    ``st`` or ``overrides`` set to None means the source was unavailable.
    """
    rows = ids.select("security_id").distinct().join(names.select("security_id", "name"), "security_id", "left").join(listings, "security_id", "left")
    if st is None:
        rows = rows.withColumn("is_st", F.lit(UNAVAILABLE))
    else:
        flagged = st.select("security_id").distinct().withColumn("_st", F.lit(True))
        rows = rows.join(flagged, "security_id", "left").withColumn("is_st", F.coalesce("_st", F.lit(False)).cast("string"))
    if overrides is None:
        rows = rows.withColumn("status", F.lit(UNAVAILABLE))
    else:
        named = overrides.select("security_id", F.col("status").alias("_status"))
        rows = rows.join(named, "security_id", "left").withColumn("status", F.coalesce("_status", F.lit(STATUS_NORMAL)))
    listed = close_ts_or_unknown("list_date")
    snapshot_ts = market_close_ts(snapshot_date(F.lit(snapshot_id)))
    columns = {
        "name": F.coalesce("name", "exchange_name"),
        "board": board_from_id("security_id"),
        "delist_date": F.lit(None).cast("date"),
        "available_at": listed,
        "snapshot_id": F.lit(snapshot_id),
        "revision_id": F.lit(revision_id),
    }
    capability = {
        "board": (listed, STABLE_PREFIX, BEST_EFFORT),
        "is_st": (snapshot_ts, CURRENT_ONLY, EVIDENCE_TAINTED),
        "status": (snapshot_ts, CURRENT_ONLY, EVIDENCE_TAINTED),
        "list_date": (listed, ONE_TIME, BEST_EFFORT),
        "delist_date": (listed, ONE_TIME, BEST_EFFORT),
    }
    for name, (stamp, kind, evidence) in capability.items():
        columns[f"{name}_available_at"] = stamp
        columns[f"{name}_as_of"] = as_of
        columns[f"{name}_point_in_time_capability"] = F.lit(kind)
        columns[f"{name}_evidence_level"] = F.lit(evidence)
    return rows.withColumns(columns).select(*MASTER_COLUMNS)


def verified_action_rows(records: DataFrame, flavour: str, snapshot_id: str) -> DataFrame:
    """Verified records as actions.

    ``adjustment``: the cash column carries the ex-right deduction, the payout stands
    beside it. ``execution``: both cash fields are carried under their own names.
    """
    kind = F.when(F.col("share_ratio") > 0, STOCK_DIVIDEND).otherwise(CASH_DIVIDEND)
    zero = F.lit(0).cast("decimal(18,6)")
    if flavour == "adjustment":
        cash = [F.col("ex_right_cash_deduction_per_share").alias("cash_dividend_per_share"), F.col("cash_dividend_per_share").alias("cash_dividend_actual_per_share")]
    elif flavour == "execution":
        cash = [F.col("cash_dividend_per_share"), F.col("ex_right_cash_deduction_per_share")]
    else:
        raise ContractViolation(f"unknown flavour: {flavour}")
    return records.select(
        pad_id("security_id").alias("security_id"),
        "ex_date",
        "record_date",
        market_close_ts("ex_date").alias("event_ts"),
        kind.alias("action_type"),
        *cash,
        "share_ratio",
        zero.alias("rights_ratio"),
        zero.alias("rights_price"),
        "disclosure_date",
        F.lit(False).alias("disclosure_time_known"),
        F.lit(None).cast("timestamp_ntz").alias("disclosure_ts"),
        F.lit(snapshot_id).alias("snapshot_id"),
        "source_file",
        "source_sha256",
    )


# Column names of the verified record sheet.
VERIFIED_SHEET = {
    "code": "security_id",
    "公告日": "disclosure_date",
    "股权登记日": "record_date",
    "除权息日": "ex_date",
    "每股现金红利_税前": "cash_dividend_per_share",
    "除权实际扣减_每股": "ex_right_cash_deduction_per_share",
    "送股比例_每股": "share_ratio",
    "有无折算节": "adjustment_section",
    "类型": "share_type",
    "源文件": "source_file",
    "公告标题": "source_title",
}
ORDINARY_SHARE = "普通股"


def load_verified_actions(sheet: DataFrame, ordinary: str = ORDINARY_SHARE) -> DataFrame:
    """Typed ordinary-share records of a verified sheet; the deduction defaults to the payout."""
    rows = sheet.select(*[F.trim(F.col(f"`{name}`")).alias(target) for name, target in VERIFIED_SHEET.items()]).where(F.col("share_type") == ordinary)
    cash = F.col("cash_dividend_per_share").try_cast("decimal(18,6)")
    return rows.withColumns(
        {
            "security_id": pad_id("security_id"),
            "disclosure_date": F.col("disclosure_date").try_cast("date"),
            "record_date": F.col("record_date").try_cast("date"),
            "ex_date": F.col("ex_date").try_cast("date"),
            "cash_dividend_per_share": cash,
            "ex_right_cash_deduction_per_share": F.coalesce(F.nullif("ex_right_cash_deduction_per_share", F.lit("")).try_cast("decimal(18,6)"), cash),
            "share_ratio": F.coalesce(F.nullif("share_ratio", F.lit("")).try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")),
        }
    )


def drop_corrected(records: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the predecessor of each correction pair ``(discarded, retained)``.

    Also returns violations: a side is missing, or business fields differ.
    """
    fields = ["security_id", "disclosure_date", "cash_dividend_per_share", "ex_right_cash_deduction_per_share", "adjustment_section", "share_ratio", "record_date", "ex_date", "share_type"]
    signature = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(name).cast("string"), F.lit("")) for name in fields]), 256)
    prints = records.select("source_file", signature.alias("_s"))
    matched = (
        pairs.join(prints.select(F.col("source_file").alias("discarded"), F.col("_s").alias("_d")), "discarded", "left")
        .join(prints.select(F.col("source_file").alias("retained"), F.col("_s").alias("_r")), "retained", "left")
    )
    broken = union_all(
        [
            violation(matched, F.col("_d").isNull(), "CORRECTION_PREDECESSOR_MISSING", ["discarded"]),
            violation(matched, F.col("_r").isNull(), "CORRECTION_MISSING", ["retained"]),
            violation(matched, F.col("_d") != F.col("_r"), "CORRECTION_PAIR_DIFFERS", ["discarded", "retained"]),
        ]
    )
    return records.join(pairs.select(F.col("discarded").alias("source_file")), "source_file", "left_anti"), broken


def verified_violations(records: DataFrame, expected_counts: DataFrame | None = None, files: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """Every broken rule of the verified sheet; expectations arrive as tables."""
    key = ["security_id", "ex_date", "source_file"]
    ordered = (F.col("disclosure_date") <= F.col("record_date")) & (F.col("record_date") < F.col("ex_date"))
    checks = [
        violation(records, ~F.coalesce(ordered, F.lit(False)), "DATE_ORDER", key),
        violation(records, ~F.coalesce(F.col("cash_dividend_per_share") > 0, F.lit(False)), "CASH_NOT_POSITIVE", key),
        violation(records, ~F.coalesce(F.col("ex_right_cash_deduction_per_share") > 0, F.lit(False)), "DEDUCTION_NOT_POSITIVE", key),
        violation(records, F.col("share_ratio") < 0, "NEGATIVE_SHARE_RATIO", key),
        violation(records, ~F.col("source_file").startswith(F.concat(F.col("security_id"), F.lit("_"))), "FILE_PREFIX", key),
        duplicate_keys(records, ["security_id", "ex_date"], "DUPLICATE_RECORD"),
    ]
    if expected_counts is not None:
        counted = records.groupBy("security_id").agg(F.count(F.lit(1)).alias("_n"))
        compared = expected_counts.join(counted, "security_id", "full_outer")
        checks.append(violation(compared, ~F.col("expected").eqNullSafe(F.col("_n")), "RECORD_COUNT", ["security_id"], F.col("_n")))
    if files is not None:
        joined = records.join(files.select(F.col("file_name").alias("source_file"), F.col("sha256").alias("_sha")), "source_file", "left")
        checks.append(violation(joined, F.col("_sha").isNull(), "FILE_MISSING", key))
        if listing is not None:
            known = joined.join(listing.select(F.col("file_name").alias("source_file"), F.col("sha256").alias("_listed")), "source_file")
            checks.append(violation(known, F.col("_sha") != F.col("_listed"), "SHA256_MISMATCH", key))
    return union_all(checks)
