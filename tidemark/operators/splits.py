"""Walk-forward folds with purging and embargo, by groups of decision dates.

Fold borders are positions on the calendar, so a sample's roles follow from its own session
by arithmetic: the folds in which a session trains, validates or tests are runs of consecutive
fold numbers. A sample takes all its roles in one generator, without a join between samples
and folds and without a loop over folds. Only the purge needs the fold itself, the first
decision of its later block, and that table is as long as the calendar at most.

Roles: ``TRAIN``, ``VALIDATION``, ``TEST``; ``PURGED`` where a label ends at or after the first
decision of the block that it must not see; ``EMBARGO`` in the sessions after a validation or
test block that are left out. All samples of a date have one block in a fold, so one date is
never on both sides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import ContractViolation, duplicate_keys, require_columns, union_all, violation
from tidemark.functions.scalars import market_close_ts
from tidemark.operators.calendar import SessionCalendar, with_session_idx

SAMPLE_COLUMNS = ("sample_id", "security_id", "decision_ts", "label_end_ts", "feature_asof_ts")
TRAIN, VALIDATION, TEST, PURGED, EMBARGO = "TRAIN", "VALIDATION", "TEST", "PURGED", "EMBARGO"


@dataclass(frozen=True)
class WalkForward:
    """Lengths in sessions. ``train`` null grows the training block from the first session; ``step`` null moves by one validation block."""

    validation: int
    min_train: int
    test: int = 0
    embargo: int = 0
    step: int | None = None
    train: int | None = None
    purge_validation: bool = True

    def __post_init__(self) -> None:
        if self.validation < 1 or self.min_train < 1 or self.test < 0 or self.embargo < 0 or (self.step is not None and self.step < 1):
            raise ContractViolation("blocks must be at least one session long, test and embargo not negative")
        if self.train is not None and self.train < self.min_train:
            raise ContractViolation("a rolling training block is shorter than min_train")

    @property
    def stride(self) -> int:
        return self.step or self.validation

    @property
    def tail(self) -> int:
        """Sessions from the start of a validation block to the end of the fold's last block."""
        return self.validation + (self.embargo + self.test if self.test else 0)

    def folds(self, sessions: int) -> int:
        """Folds whose blocks all lie inside the calendar."""
        return max(0, math.floor((sessions - self.tail - self.min_train) / self.stride) + 1)


def fold_borders(cal: SessionCalendar, plan: WalkForward) -> DataFrame:
    """One row per fold with the first and last session of each block; no longer than the calendar."""
    count = plan.folds(cal.size)
    start = [plan.min_train + f * plan.stride for f in range(count)]
    train = [0 if plan.train is None else max(0, v - plan.train) for v in start]
    stop = [v + plan.validation - 1 for v in start]
    test = [v + plan.validation + plan.embargo if plan.test else None for v in start]
    day = lambda places: pa.array([None if p is None else cal.dates[p] for p in places], pa.date32())
    table = pa.table(
        {
            "fold": pa.array(range(count), pa.int32()),
            "train_start": day(train),
            "train_end": day([v - 1 for v in start]),
            "validation_start": day(start),
            "validation_end": day(stop),
            "test_start": day(test),
            "test_end": day([None if t is None else t + plan.test - 1 for t in test]),
        }
    )
    return cal.spark.createDataFrame(table)


def _run(idx: Column, lo: int | None, hi: int, plan: WalkForward, count: int, block: str) -> Column:
    """Folds in which a session is ``lo`` to ``hi`` sessions after the fold's first validation session, as (fold, block)."""
    # idx - (min_train + f * stride) in [lo, hi]
    first = F.ceil((idx - plan.min_train - hi) / F.lit(plan.stride))
    last = F.lit(count - 1) if lo is None else F.floor((idx - plan.min_train - lo) / F.lit(plan.stride))
    first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(count - 1)).cast("int")
    run = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
    return F.transform(run, lambda f: F.struct(f.alias("fold"), F.lit(block).alias("block")))


def _blocks(idx: Column, plan: WalkForward, count: int) -> Column:
    """All (fold, block) of a session: TRAIN, VALIDATION, TEST or EMBARGO."""
    parts = [
        _run(idx, None if plan.train is None else -plan.train, -1, plan, count, TRAIN),
        _run(idx, 0, plan.validation - 1, plan, count, VALIDATION),
    ]
    after = plan.validation
    if plan.embargo:
        parts.append(_run(idx, after, after + plan.embargo - 1, plan, count, EMBARGO))
        after += plan.embargo
    if plan.test:
        parts.append(_run(idx, after, after + plan.test - 1, plan, count, TEST))
        if plan.embargo:
            parts.append(_run(idx, after + plan.test, after + plan.test + plan.embargo - 1, plan, count, EMBARGO))
    return F.concat(*parts)


def sample_violations(samples: DataFrame, cal: SessionCalendar) -> DataFrame:
    """Samples that no split may take: each rule by its name."""
    require_columns(samples, SAMPLE_COLUMNS, "samples")
    located = with_session_idx(samples.withColumn("_decided", F.col("decision_ts").cast("date")), cal, "_decided")
    missing = F.col("sample_id").isNull() | F.col("decision_ts").isNull() | F.col("label_end_ts").isNull() | F.col("feature_asof_ts").isNull()
    key = ["sample_id"]
    return union_all(
        [
            violation(located, missing, "SAMPLE_FIELD_MISSING", key),
            violation(located, F.col("_decided").isNotNull() & F.col("session_idx").isNull(), "DECISION_NOT_A_SESSION", key, F.col("_decided")),
            violation(located, F.col("label_end_ts") <= F.col("decision_ts"), "LABEL_ENDS_BEFORE_DECISION", key, F.col("label_end_ts")),
            violation(located, F.col("feature_asof_ts") > F.col("decision_ts"), "FEATURE_AFTER_DECISION", key, F.col("feature_asof_ts")),
            duplicate_keys(samples.where("sample_id is not null"), key, "DUPLICATE_SAMPLE"),
        ]
    )


def first_decisions(samples: DataFrame, cal: SessionCalendar, plan: WalkForward) -> DataFrame:
    """Per fold the first decision of its validation and of its test block, in the samples themselves.

    Partial aggregation leaves a row per session and block; a block without samples has none.
    """
    per_day = samples.groupBy(F.col("decision_ts").cast("date").alias("_decided")).agg(F.min("decision_ts").alias("_first"))
    blocks = with_session_idx(per_day, cal, "_decided").where("session_idx is not null").select("_first", F.explode(_blocks(F.col("session_idx"), plan, plan.folds(cal.size))).alias("_b"))
    pick = lambda block: F.min(F.when(F.col("_b.block") == block, F.col("_first")))
    return blocks.groupBy(F.col("_b.fold").alias("fold")).agg(pick(VALIDATION).alias("first_validation"), pick(TEST).alias("first_test"))


def walk_forward(samples: DataFrame, cal: SessionCalendar, plan: WalkForward) -> DataFrame:
    """Samples with a fold and their role in it, one row per fold that a sample has a block in.

    A training sample is PURGED if its label ends at or after the fold's first validation decision (the first
    test decision where the validation block has no samples), a validation sample, with ``purge_validation``, if it ends at
    or after the first test decision. Samples must pass :func:`sample_violations`; those outside every fold, or
    on a date that is no session, have no row.
    """
    require_columns(samples, SAMPLE_COLUMNS, "samples")
    count = plan.folds(cal.size)
    located = with_session_idx(samples.withColumn("_decided", F.col("decision_ts").cast("date")), cal, "_decided").where("session_idx is not null")
    if not count:
        blocked = located.select(*samples.columns, F.lit(None).cast("int").alias("fold"), F.lit(None).cast("string").alias("block"), F.lit(None).cast("string").alias("role"))
        return blocked.where(F.lit(False))
    each = located.withColumn("_b", F.explode(_blocks(F.col("session_idx"), plan, count)))
    borders = F.broadcast(first_decisions(samples, cal, plan).withColumnRenamed("fold", "_fold"))  # calendar-bounded
    joined = each.join(borders, F.col("_b.fold") == F.col("_fold"), "left")
    next_block = F.when(F.col("_b.block") == TRAIN, F.coalesce("first_validation", "first_test"))
    if plan.purge_validation:
        next_block = next_block.when(F.col("_b.block") == VALIDATION, F.col("first_test"))
    purged = F.coalesce(F.col("label_end_ts") >= next_block, F.lit(False))
    return joined.select(*samples.columns, F.col("_b.fold").alias("fold"), F.col("_b.block").alias("block"), F.when(purged, PURGED).otherwise(F.col("_b.block")).alias("role"))


def fold_summary(assigned: DataFrame) -> DataFrame:
    """Per fold and role: samples, dates and the outermost stamps."""
    day = F.col("decision_ts").cast("date")
    return assigned.groupBy("fold", "role").agg(
        F.count("*").alias("samples"), F.count_distinct(day).alias("dates"), F.min("decision_ts").alias("first_decision"), F.max("decision_ts").alias("last_decision"), F.max("label_end_ts").alias("last_label_end")
    )


def fold_violations(assigned: DataFrame, cal: SessionCalendar, plan: WalkForward) -> DataFrame:
    """What breaks the rules of a walk-forward split in any assignment (sample_id, decision_ts, label_end_ts, fold, role).

    Judged from the roles alone, not from how they were made: labels that reach into a later block, dates on
    two sides, blocks out of order, and training, validation or test inside an embargo.
    """
    used = assigned.where(F.col("role").isin(TRAIN, VALIDATION, TEST))
    when = lambda role, value: F.when(F.col("role") == role, value)
    span = F.broadcast(  # a row per fold
        used.groupBy("fold").agg(*[agg(when(role, F.col("decision_ts"))).alias(f"_{name}_{role.lower()}") for role in (TRAIN, VALIDATION, TEST) for name, agg in (("first", F.min), ("last", F.max))])
    )
    rows = used.join(span, "fold")
    key = ["fold", "sample_id"]
    later = F.coalesce(when(TRAIN, F.coalesce("_first_validation", "_first_test")).when(F.col("role") == VALIDATION, F.col("_first_test") if plan.purge_validation else F.lit(None).cast("timestamp_ntz")), F.lit(None).cast("timestamp_ntz"))
    sides = used.groupBy("fold", F.col("decision_ts").cast("date").alias("day")).agg(F.count_distinct("role").alias("_sides"))
    day = lambda c: F.col(c).cast("date")
    order = span.withColumn("_bad", F.concat_ws(",", F.when(day("_last_train") >= day("_first_validation"), "TRAIN-VALIDATION"), F.when(day("_last_validation") >= day("_first_test"), "VALIDATION-TEST"), F.when(day("_last_train") >= day("_first_test"), "TRAIN-TEST")))
    borders = F.broadcast(fold_borders(cal, plan))
    checks = [
        violation(rows, F.coalesce(F.col("label_end_ts") >= later, F.lit(False)), "LABEL_REACHES_LATER_BLOCK", key, F.col("label_end_ts")),
        violation(sides, F.col("_sides") > 1, "DATE_ON_TWO_SIDES", ["fold", "day"], F.col("_sides")),
        violation(order, F.col("_bad") != "", "BLOCKS_OUT_OF_ORDER", ["fold"], F.col("_bad")),
    ]
    if plan.embargo:
        placed = cal.positions(used.join(borders.select("fold", "validation_end", "test_end"), "fold").withColumn("_decided", F.col("decision_ts").cast("date")), "_decided", "_at", "_m")
        ends = cal.positions(cal.positions(placed, "validation_end", "_ve", "_m1"), "test_end", "_te", "_m2")
        inside = lambda c: F.coalesce(F.col("_at").between(F.col(c) + 1, F.col(c) + plan.embargo), F.lit(False))
        checks.append(violation(ends, inside("_ve") | inside("_te"), "INSIDE_EMBARGO", key, F.col("role")))
    return union_all(checks)


def label_samples(labels: DataFrame) -> DataFrame:
    """Samples of a label table (A14): decided at the signal's as-of, known at the label's observation."""
    return labels.select(
        F.concat_ws("/", "security_id", F.col("signal_asof_ts").cast("date").cast("string")).alias("sample_id"),
        "security_id",
        F.col("signal_asof_ts").alias("decision_ts"),
        F.col("label_observed_at").alias("label_end_ts"),
        F.col("signal_asof_ts").alias("feature_asof_ts"),
    )


def calendar_samples(bars: DataFrame, cal: SessionCalendar, holding: Column | int) -> DataFrame:
    """A sample per bar: decided at its close, its label ends at the close ``holding`` sessions later (at most the last session)."""
    rows = with_session_idx(bars.select("security_id", "trade_date", (holding if isinstance(holding, Column) else F.lit(holding)).cast("int").alias("_hold")), cal, "trade_date")
    ended = cal.date_at(rows, F.least(F.col("session_idx") + F.col("_hold"), F.lit(cal.size - 1)), "_end")
    later = F.when(F.col("_end") > F.col("trade_date"), market_close_ts("_end")).otherwise(market_close_ts(F.date_add("trade_date", 1)))
    return ended.select(
        F.concat_ws("/", "security_id", F.col("trade_date").cast("string")).alias("sample_id"),
        "security_id",
        market_close_ts("trade_date").alias("decision_ts"),
        later.alias("label_end_ts"),
        market_close_ts("trade_date").alias("feature_asof_ts"),
    )
