"""Fundamental releases on two clocks: the report period they are about, and when they were filed.

What a researcher could use at an as-of is the newest report period with any filing visible by
then, in that period's latest visible filing. Both steps are one running maximum over filings in
order of availability, of (period, availability, version): a restatement of an old period that
lands after a newer period's release never wins, and neither does the first filing once it is
restated. The maximum runs inside (key, time bucket) partitions and over one summary row per
bucket, so an issuer with a very long history is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import require_columns, union_all, violation
from tidemark.operators.asof import asof_join, asof_max

RELEASE_COLUMNS = ("security_id", "metric_name", "report_period_end", "metric_value", "available_at", "filing_version")
KEY = ("security_id", "metric_name")
PAYLOAD = ("report_period_end", "available_at", "filing_version", "metric_value")
FIRST_FILING, RESTATEMENT, LATE_FIRST, LATE_RESTATEMENT, REPEAT = "FIRST_FILING", "RESTATEMENT", "LATE_FIRST_FILING", "LATE_RESTATEMENT", "REPEAT"


def release_violations(releases: DataFrame) -> DataFrame:
    """Filings without key or stamps, known before their period ended or were announced, and equal filings with unlike values."""
    require_columns(releases, RELEASE_COLUMNS, "fundamental_release_pit")
    key = [*KEY, "report_period_end", "filing_version"]
    missing = F.lit(False)
    for name in (*KEY, "report_period_end", "available_at", "filing_version"):
        missing = missing | F.col(name).isNull()
    checks = [
        violation(releases, missing, "RELEASE_FIELD_MISSING", key),
        violation(releases, F.col("available_at").cast("date") <= F.col("report_period_end"), "KNOWN_BEFORE_PERIOD_END", key, F.col("available_at")),
    ]
    if "announcement_at" in releases.columns:
        checks.append(violation(releases, F.col("available_at") < F.col("announcement_at"), "AVAILABLE_BEFORE_ANNOUNCED", key, F.col("available_at")))
    if "currency" in releases.columns:
        mixed = releases.groupBy(*KEY).agg(F.count_distinct("currency").alias("_n"))
        checks.append(violation(mixed, F.col("_n") > 1, "MIXED_CURRENCY", list(KEY), F.col("_n")))
    ties = releases.groupBy(*KEY, "report_period_end", "available_at", "filing_version").agg(F.min("metric_value").alias("_lo"), F.max("metric_value").alias("_hi"), F.count("*").alias("_n"), F.count("metric_value").alias("_v"))
    checks.append(violation(ties, (F.col("_lo") != F.col("_hi")) | ((F.col("_v") > 0) & (F.col("_v") < F.col("_n"))), "CONTRADICTORY_FILING", [*KEY, "report_period_end", "filing_version"], F.col("available_at")))
    return union_all(checks)


def latest_release(asks: DataFrame, releases: DataFrame, by: Sequence[str] = KEY, asof: str = "asof_ts", bucket: str = "quarter") -> DataFrame:
    """``asks`` with the newest visible report period in its latest visible filing, null fields where nothing is visible."""
    require_columns(releases, RELEASE_COLUMNS, "fundamental_release_pit")
    found = asof_max(asks, releases, by, asof, "available_at", ["report_period_end", "available_at", "filing_version"], ["metric_value"], bucket=bucket, out="_r")
    return found.select(*asks.columns, *[F.col(f"_r.{name}").alias(name) for name in PAYLOAD])


def period_release(asks: DataFrame, releases: DataFrame, by: Sequence[str] = KEY, asof: str = "asof_ts", bucket: str = "quarter", prefix: str = "") -> DataFrame:
    """``asks`` (with ``report_period_end``) with that period's latest filing visible at the as-of."""
    found = asof_join(asks, releases, [*by, "report_period_end"], asof, "available_at", ["available_at", "filing_version", "metric_value"], bucket=bucket, tie_break=["filing_version"], out="_r")
    return found.select(*asks.columns, *[F.col(f"_r.{name}").alias(f"{prefix}{name}") for name in ("available_at", "filing_version", "metric_value")])


def year_on_year(asks: DataFrame, releases: DataFrame, by: Sequence[str] = KEY, asof: str = "asof_ts") -> DataFrame:
    """Newest visible value beside the same period a year before, both as known at the same as-of, and their growth.

    The growth is null where either value is missing or the earlier one is not positive.
    """
    now = latest_release(asks, releases, by, asof)
    back = now.withColumnRenamed("report_period_end", "_period").withColumnRenamed("available_at", "_at").withColumnRenamed("filing_version", "_version").withColumnRenamed("metric_value", "_value")
    both = period_release(back.withColumn("report_period_end", F.last_day(F.add_months("_period", -12))), releases, by, asof, prefix="prior_")
    growth = F.when(F.col("prior_metric_value") > 0, F.col("_value").cast("double") / F.col("prior_metric_value").cast("double") - 1.0)
    return both.select(*asks.columns, F.col("_period").alias("report_period_end"), F.col("_at").alias("available_at"), F.col("_version").alias("filing_version"), F.col("_value").alias("metric_value"), F.col("report_period_end").alias("prior_period_end"), "prior_available_at", "prior_metric_value", growth.alias("growth"))


def _just_before(stamp: Column) -> Column:
    return stamp - F.expr("interval 1 microsecond")


def release_history(releases: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Each filing with what it replaced and what it could change at the time.

    ``previous_value`` is its period's latest filing strictly before it, ``newest_period`` the newest period then public.
    ``kind``: FIRST_FILING or RESTATEMENT of the newest period, LATE_FIRST_FILING or LATE_RESTATEMENT of an older one, which
    changes no current value, and REPEAT for the same value again. Filings of equal stamps are each judged by what was before them.
    """
    names = [*by, "report_period_end", "available_at", "filing_version", "metric_value"]
    filed = releases.select(*names).withColumn("_before", _just_before(F.col("available_at")))
    asked = filed.withColumnsRenamed({"available_at": "_at", "filing_version": "_version", "metric_value": "_value"})
    replaced = period_release(asked, releases, by, "_before", prefix="previous_").withColumnRenamed("report_period_end", "_period")
    newest = asof_max(replaced, releases, by, "_before", "available_at", ["report_period_end"], [], out="_n")
    older = F.coalesce(F.col("_period") < F.col("_n.report_period_end"), F.lit(False))
    first = F.col("previous_available_at").isNull()
    kind = F.when(~first & F.col("_value").eqNullSafe(F.col("previous_metric_value")), REPEAT).when(older & first, LATE_FIRST).when(older, LATE_RESTATEMENT).when(first, FIRST_FILING).otherwise(RESTATEMENT)
    return newest.select(*by, F.col("_period").alias("report_period_end"), F.col("_at").alias("available_at"), F.col("_version").alias("filing_version"), F.col("_value").alias("metric_value"), F.col("previous_metric_value").alias("previous_value"), F.col("_n.report_period_end").alias("newest_period"), kind.alias("kind"))
