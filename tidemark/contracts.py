"""Data contracts: fixed vocabularies, column checks and fail-closed violations.

An assertion column that nothing selects is pruned by the optimizer, so checks
are explicit *violation frames* (one row per broken rule). ``enforce`` runs one
before the result is used and raises when it is not empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractViolation(ValueError):
    """A table breaks the data contract."""


# Fixed values.
RAW_UNADJUSTED = "RAW_UNADJUSTED"
VENDOR_ADJUSTED = "VENDOR_ADJUSTED"
PIT_DERIVED = "PIT_DERIVED"
STATUS_NORMAL = "正常"
STATUS_SUSPENDED = "停牌"
STATUS_MISSING = "缺失"
STATUS_DELISTED = "退市"
UNAVAILABLE = "UNAVAILABLE"
DAILY_LATENCY_VERSION = "daily_bar_t1500_asia_shanghai_v1"
BAR_FREQUENCY = "daily"
EVIDENCE_TAINTED = "EXPLORATORY_TAINTED"
BEST_EFFORT = "BEST_EFFORT_RELIABLE"
CASH_DIVIDEND = "CASH_DIVIDEND"
STOCK_DIVIDEND = "STOCK_DIVIDEND"
RIGHTS_ISSUE = "RIGHTS_ISSUE"
OTHER_ACTION = "OTHER"
FACTOR_ACTION_TYPES = (CASH_DIVIDEND, STOCK_DIVIDEND, RIGHTS_ISSUE)
LEDGER_ACTION_TYPES = (CASH_DIVIDEND, STOCK_DIVIDEND)
OK = "OK"
BLOCKED = "BLOCKED"
NO_DATA = "NO_DATA"

PIT_TABLES = ("daily_bar_raw", "security_master", "corporate_actions")
BAR_COLUMNS = (
    "security_id",
    "trade_date",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "amount",
    "trade_status",
    "event_ts",
    "available_at",
    "price_basis",
    "source_id",
    "revision_id",
    "snapshot_id",
    "declared_safety_latency_version",
    "bar_frequency",
)
ACTION_COLUMNS = (
    "security_id",
    "ex_date",
    "action_type",
    "cash_dividend_per_share",
    "share_ratio",
    "available_at",
    "source_id",
    "snapshot_id",
)
LABEL_COLUMNS = (
    "security_id",
    "signal_asof_ts",
    "entry_ts",
    "exit_ts",
    "future_return",
    "label_end_ts",
    "label_observed_at",
    "label_spec",
    "price_basis",
    "corporate_action_manifest",
    "snapshot_id",
)


def require_columns(df: DataFrame, columns: Iterable[str], label: str) -> DataFrame:
    """Return ``df`` or raise naming every missing column."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ContractViolation(f"{label} missing required columns: {missing}")
    return df


def violation(df: DataFrame, condition: Column, check: str, key: Sequence[str], detail: Column | None = None) -> DataFrame:
    """Rows of ``df`` breaking one rule, as ``(check, key, detail)``."""
    return df.where(condition).select(
        F.lit(check).alias("check"),
        F.concat_ws("/", *[F.col(name).cast("string") for name in key]).alias("key"),
        (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def duplicate_keys(df: DataFrame, key: Sequence[str], check: str) -> DataFrame:
    """Violation frame of keys seen more than once (partial aggregation, no window)."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return violation(counts, F.col("_n") > 1, check, key, F.col("_n"))


def enforce(violations: DataFrame, show: int = 5) -> None:
    """Raise when a violation frame has rows; only a few rows reach the driver."""
    found = violations.limit(show).collect()
    if found:
        text = "; ".join(f"{row['check']} [{row['key']}] {row['detail']}".strip() for row in found)
        raise ContractViolation(text)
