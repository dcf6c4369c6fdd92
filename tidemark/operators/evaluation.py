"""Rank-IC, quantiles, coverage and the block-bootstrap interval."""

from __future__ import annotations

import math
import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import EVIDENCE_TAINTED, OK
from tidemark.operators.labels import is_mature
from tidemark.operators.signals import ordinal_rank

BLOCK_LENGTH = 21
ITERATIONS = 500
SURVIVOR_BIAS_TAG = "EXPLORATORY_TAINTED: universe may carry survivor bias"


def match_labels(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points left-joined to one label per (signal as-of, security); the last seen wins.

    "Last" needs an order: ``ingest_seq`` when the labels carry it, else the label's
    observation stamp.
    """
    order = "ingest_seq" if "ingest_seq" in labels.columns else "label_observed_at"
    payload = ["future_return", "label_end_ts", "label_observed_at", F.col("status").alias("label_status")]
    one = labels.groupBy("signal_date", "security_id").agg(F.max(F.struct(F.col(order).alias("_o"), *payload)).alias("label"))
    return points.join(one, ["signal_date", "security_id"], "left")


def judged_points(points: DataFrame, labels: DataFrame, evaluation_asof: object) -> DataFrame:
    """All points with ``is_scored`` and, for scored ones, missing (first), immature or usable."""
    joined = match_labels(points, labels).select("*", "label.future_return", "label.label_end_ts", "label.label_observed_at").drop("label")
    scored = (F.col("status") == OK) & F.col("momentum_score").isNotNull()
    missing = F.col("future_return").isNull()
    mature = F.coalesce(is_mature(evaluation_asof), F.lit(False))
    return joined.withColumns(
        {"is_scored": scored, "is_missing": scored & missing, "is_immature": scored & ~missing & ~mature, "is_usable": scored & ~missing & mature}
    )


def usable_pairs(points: DataFrame, labels: DataFrame, evaluation_asof: object) -> DataFrame:
    return judged_points(points, labels, evaluation_asof).where("is_scored")


def rank_ic(points: DataFrame, labels: DataFrame, evaluation_asof: object) -> DataFrame:
    """Per signal date the ordinal-rank Spearman IC and sample counts.

    Both ranks are recomputed among usable pairs. A date needs two pairs for an IC.
    One join, two orders inside the date and one aggregate.
    """
    judged = judged_points(points, labels, evaluation_asof)
    group = ["signal_date", "is_usable"]
    ranked = judged.withColumns({"_rs": ordinal_rank(F.col("momentum_score"), group), "_rr": ordinal_rank(F.col("future_return"), group)})
    gap = (F.col("_rs") - F.col("_rr")).cast("bigint")
    usable = F.col("is_usable")
    per_date = ranked.groupBy("signal_date").agg(
        F.count_if(usable).alias("sample_size"),
        F.sum(F.when(usable, gap * gap)).alias("_d2"),
        F.max("universe_size").cast("bigint").alias("universe_size"),
        F.count_if("is_immature").alias("immature_label_count"),
        F.count_if("is_missing").alias("missing_label_count"),
    )
    n = F.col("sample_size")
    ic = F.when(n >= 2, 1.0 - (6 * F.col("_d2")).cast("double") / (n * (n * n - 1)).cast("double"))
    return per_date.select("signal_date", ic.alias("rank_ic"), "sample_size", "universe_size", "immature_label_count", "missing_label_count")


def coverage(ic: DataFrame) -> DataFrame:
    ratio = F.when(F.col("universe_size") > 0, F.col("sample_size") / F.col("universe_size")).otherwise(0.0)
    return ic.select("signal_date", "sample_size", "universe_size", ratio.alias("coverage"))


def coverage_summary(ic: DataFrame) -> DataFrame:
    covered = coverage(ic)
    return covered.agg(
        F.avg("coverage").alias("mean_coverage"),
        F.min("coverage").alias("min_coverage"),
        F.max("coverage").alias("max_coverage"),
        F.count_if(F.col("coverage") == 0).alias("zero_days"),
    )


def ic_summary(ic: DataFrame) -> DataFrame:
    """Mean IC, ICIR (null for fewer than two dates or no variance) and totals."""
    spread = F.stddev_samp("rank_ic")
    return ic.agg(
        F.count("rank_ic").alias("ic_dates"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.when((F.count("rank_ic") >= 2) & (spread > 0), F.avg("rank_ic") / spread).alias("icir"),
        F.coalesce(F.sum("immature_label_count"), F.lit(0)).alias("immature_label_count"),
        F.coalesce(F.sum("missing_label_count"), F.lit(0)).alias("missing_label_count"),
        F.lit(EVIDENCE_TAINTED).alias("evidence_status"),
        F.lit(SURVIVOR_BIAS_TAG).alias("survivor_bias_warning"),
    )


def quantile_returns(pairs: DataFrame, quantiles: int = 5) -> DataFrame:
    """Mean future return and count per score bucket over dates with at least two pairs.

    Bucket ``min(q, floor(i*q/n)+1)`` for 0-based position i; empty buckets stay.
    """
    by_date = Window.partitionBy("signal_date")
    placed = pairs.where("is_usable").withColumn("_i", ordinal_rank(F.col("momentum_score"), ["signal_date"]) - 1).withColumn("_n", F.count(F.lit(1)).over(by_date))
    bucket = F.least(F.lit(quantiles), F.floor(F.col("_i") * quantiles / F.col("_n")).cast("int") + 1)
    filled = placed.where("_n >= 2").groupBy(bucket.alias("quantile")).agg(F.avg("future_return").alias("mean_future_return"), F.count(F.lit(1)).alias("sample_count"))
    spark = pairs.sparkSession
    every = spark.range(1, quantiles + 1).select(F.col("id").cast("int").alias("quantile"))
    return every.join(filled, "quantile", "left").select("quantile", "mean_future_return", F.coalesce("sample_count", F.lit(0).cast("bigint")).alias("sample_count"))


def monotonicity(buckets: DataFrame, thin_cross_section: bool = False) -> DataFrame:
    """INSUFFICIENT, INCREASING, DECREASING or NOT_MONOTONIC over non-empty buckets."""
    # One row per bucket: a handful of rows by definition of the quantile count.
    steps = buckets.where(F.col("mean_future_return").isNotNull()).withColumn("_prev", F.lag("mean_future_return").over(Window.orderBy("quantile")))
    verdict = steps.agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.col("_prev").isNull() | (F.col("_prev") <= F.col("mean_future_return"))).alias("_up"),
        F.bool_and(F.col("_prev").isNull() | (F.col("_prev") >= F.col("mean_future_return"))).alias("_down"),
    )
    text = (
        F.when(F.lit(thin_cross_section), "NOT_APPLICABLE")
        .when(F.col("_n") < 2, "INSUFFICIENT")
        .when(F.col("_up"), "INCREASING")
        .when(F.col("_down"), "DECREASING")
        .otherwise("NOT_MONOTONIC")
    )
    return verdict.select(text.alias("quantile_monotonicity"))


def block_bootstrap_ci(ic: DataFrame, block: int = BLOCK_LENGTH, iterations: int = ITERATIONS, seed: int = 0) -> DataFrame:
    """Moving-block bootstrap interval of the mean IC.

    Block starts come from a seeded generator on the driver (iterations x blocks small
    integers); resampling is an equi join on the series index and a group average.
    The series has one row per date, so its length is bounded by the calendar.
    """
    spark = ic.sparkSession
    method = f"moving_block_bootstrap_non_iid(block_length={block},iterations={iterations})"
    values = ic.where(F.col("rank_ic").isNotNull()).select("signal_date", "rank_ic")
    n = values.count()
    if n <= block:
        note = f"{method};ci_unavailable_insufficient_samples(n={n}<=block={block})"
        return spark.range(1).select(F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"), F.lit(note).alias("ci_method"))
    series = values.withColumn("_i", F.row_number().over(Window.orderBy("signal_date")) - 1)
    generator = random.Random(seed)
    per_iteration = math.ceil(n / block)
    choices = range(n - block + 1)
    starts = [generator.choice(choices) for _ in range(iterations * per_iteration)]
    total = len(starts)
    table = spark.createDataFrame(
        pa.table(
            {
                "iteration": pa.array([k // per_iteration for k in range(total)], pa.int32()),
                "slot": pa.array([k % per_iteration for k in range(total)], pa.int32()),
                "start": pa.array(starts, pa.int32()),
            }
        )
    )
    drawn = table.select("iteration", "slot", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_k")).where(F.col("slot") * block + F.col("_k") < n)
    means = (
        drawn.withColumn("_i", F.col("start") + F.col("_k"))
        .join(series.select("_i", "rank_ic"), "_i")
        .groupBy("iteration")
        .agg(F.avg("rank_ic").alias("m"))
    )
    ordered = means.withColumn("_pos", F.row_number().over(Window.orderBy("m")) - 1)
    low, high = (25 * (iterations - 1)) // 1000, (975 * (iterations - 1)) // 1000
    return ordered.agg(
        F.max(F.when(F.col("_pos") == low, F.col("m"))).alias("ci_low"),
        F.max(F.when(F.col("_pos") == high, F.col("m"))).alias("ci_high"),
    ).withColumn("ci_method", F.lit(method))


def prediction_frame(points: DataFrame, labels: DataFrame, ic: DataFrame) -> DataFrame:
    """Signal points with their label, exclusion reason and the date's IC."""
    joined = match_labels(points, labels).join(ic.select("signal_date", "rank_ic"), "signal_date", "left")
    from tidemark.functions.scalars import market_close_ts

    return joined.select(
        market_close_ts("signal_date").alias("signal_asof_ts"),
        market_close_ts("score_date").alias("score_asof_ts"),
        "security_id",
        F.col("status").alias("signal_status"),
        F.col("reason").alias("signal_exclusion_reason"),
        "momentum_score",
        "cross_sectional_rank",
        F.col("label.label_status").alias("label_status"),
        F.col("label.future_return").alias("future_return"),
        F.col("label.label_end_ts").alias("label_end_ts"),
        F.col("label.label_observed_at").alias("label_observed_at"),
        "rank_ic",
        "evidence_status",
    )


def label_status_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("status").agg(F.count(F.lit(1)).alias("labels"))


def signal_size_stats(points: DataFrame) -> DataFrame:
    sizes = points.groupBy("signal_date").agg(F.count_if(F.col("status") == OK).alias("_n"))
    return sizes.agg(F.count(F.lit(1)).alias("signal_dates"), F.avg("_n").alias("avg_scorable"), F.min("_n").alias("min_scorable"), F.max("_n").alias("max_scorable"))


def status_diagnostics(returns: DataFrame) -> DataFrame:
    """Counts by status, reason and security in one grouping-sets pass."""
    level = F.when(F.grouping("security_id") == 0, "security").when(F.grouping("block_reason") == 0, "reason").otherwise("status")
    grouped = returns.groupingSets([[F.col("status")], [F.col("status"), F.col("block_reason")], [F.col("status"), F.col("security_id")]], F.col("status"), F.col("block_reason"), F.col("security_id"))
    return grouped.agg(level.alias("level"), F.count(F.lit(1)).alias("points")).where((F.col("level") != "reason") | F.col("block_reason").isNotNull()).select("level", "status", "block_reason", "security_id", "points")


def blocked_rate(returns: DataFrame, limit: float = 0.05) -> DataFrame:
    stats = returns.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("status") == "BLOCKED").alias("blocked"))
    rate = F.try_divide(F.col("blocked"), F.col("points"))
    return stats.select("points", "blocked", rate.alias("blocked_rate"), (rate <= limit).alias("within_limit"))
