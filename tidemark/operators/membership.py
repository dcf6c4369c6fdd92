"""Index membership on two clocks: when a security was a member, and when that was known.

A row says that from ``effective_from`` up to ``effective_to`` (null: until further notice) a
security is, or with ``is_member`` false is not, a member, and is known from ``available_at``.
Where rows overlap, the one known last decides, so a late correction may cut a membership in
two, join two, or close one after the fact, and an earlier as-of still sees what it saw.

Looking up who was a member is a stab into intervals. Intervals are cut at the borders of time
buckets, and a date meets only the pieces of its own bucket: an equality join with a local test,
however long a membership lasts. Rows are moved once, by index and security, and are cut, compared
and put together there; windows are a security's rows in an index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import require_columns, union_all, violation
from tidemark.functions.scalars import timestamp_literal
from tidemark.operators.intervals import bucket_start, day_bucket, pieces

MEMBERSHIP_COLUMNS = ("index_id", "security_id", "effective_from", "effective_to", "available_at", "revision_id")
BUCKET_DAYS = 91
BROADCAST_ASKS = 200_000


def _member(rows: DataFrame) -> Column:
    return F.coalesce(F.col("is_member"), F.lit(True)) if "is_member" in rows.columns else F.lit(True)


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with ``_v``, which grows in the order in which rows of a security in an index decide and is odd for a member.

    The order is (available_at, revision_id, is_member). The rows are moved once, to the partition of their (index, security).
    """
    order = Window.partitionBy("index_id", "security_id").orderBy("available_at", "revision_id", "_is")
    numbered = rows.withColumn("_is", _member(rows)).select(*MEMBERSHIP_COLUMNS, "_is").withColumn("_n", F.row_number().over(order).cast("bigint"))
    return numbered.withColumn("_v", F.col("_n") * 2 + F.col("_is").cast("int")).drop("_n", "_is")


def membership_violations(rows: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Rows without key or stamps, empty intervals, and equally old rows that contradict each other on a day."""
    require_columns(rows, MEMBERSHIP_COLUMNS, "index_membership_pit")
    key = ["index_id", "security_id", "effective_from", "revision_id"]
    missing = F.col("index_id").isNull() | F.col("security_id").isNull() | F.col("effective_from").isNull() | F.col("available_at").isNull()
    checks = [violation(rows, missing, "MEMBERSHIP_FIELD_MISSING", key), violation(rows, F.col("effective_to") <= F.col("effective_from"), "EMPTY_MEMBERSHIP", key, F.col("effective_to"))]
    if "announcement_at" in rows.columns:
        checks.append(violation(rows, F.col("available_at") < F.col("announcement_at"), "AVAILABLE_BEFORE_ANNOUNCED", key, F.col("available_at")))
    # A contradiction starts where the later of the two intervals starts, so it is met in that bucket alone.
    flagged = rows.where(~missing).withColumn("_is", _member(rows))
    latest = flagged.agg(F.max(F.greatest("effective_from", F.coalesce("effective_to", "effective_from")))).first()[0]
    if latest is None:
        return union_all(checks)
    cut = pieces(flagged, F.col("effective_from"), F.coalesce(F.col("effective_to"), F.date_add(F.lit(latest), 1)), bucket_days)
    same = ["index_id", "security_id", "available_at", "revision_id", "_bucket"]
    yes, no = (cut.where(c).select(*same, F.col("_lo").alias(f"_{n}_lo"), F.col("_stop").alias(f"_{n}_stop")) for n, c in (("yes", "_is"), ("no", "not _is")))
    first = F.greatest("_yes_lo", "_no_lo")
    clash = yes.join(no, same).where((first < F.least("_yes_stop", "_no_stop")) & (day_bucket(first, bucket_days) == F.col("_bucket")))
    checks.append(violation(clash.withColumn("effective_from", first), F.lit(True), "CONTRADICTORY_MEMBERSHIP", key, F.col("available_at")))
    return union_all(checks)


def members_at(rows: DataFrame, asks: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Members per (index_id, date, asof_ts) of ``asks``, with the row that decided.

    A row counts if it is known at the as-of and its interval holds the date; of a security's rows the last
    known one decides, equal stamps by the larger ``revision_id``.
    """
    require_columns(rows, MEMBERSHIP_COLUMNS, "index_membership_pit")
    asks = asks.select("index_id", F.col("date").cast("date").alias("date"), F.col("asof_ts").cast("timestamp_ntz").alias("asof_ts")).distinct()
    span = asks.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, stop = F.lit(span["lo"]).cast("date"), F.date_add(F.lit(span["hi"]).cast("date"), 1)
    held = _ranked(rows.where(F.col("index_id").isNotNull() & F.col("available_at").isNotNull()))
    cut = pieces(held.drop("revision_id"), F.greatest("effective_from", lo), F.least(F.coalesce("effective_to", stop), stop), bucket_days)
    asked = asks.withColumn("_bucket", day_bucket(F.col("date"), bucket_days))
    # Asks of checked size come to the rows: a row and what it answers stay in the partition of its security.
    hit = cut.join(F.broadcast(asked) if span["n"] <= BROADCAST_ASKS else asked, ["index_id", "_bucket"]).where((F.col("_lo") <= F.col("date")) & (F.col("date") < F.col("_stop")) & (F.col("available_at") <= F.col("asof_ts")))
    # A number is compared without sorting the hits, which are many a row; the row that decided is read by it afterwards.
    decided = hit.groupBy("index_id", "date", "asof_ts", "security_id").agg(F.max("_v").alias("_v")).where("_v % 2 = 1")
    source = held.select(F.col("index_id").alias("_i"), F.col("security_id").alias("_s"), F.col("_v").alias("_w"), "available_at", "revision_id")
    same = (F.col("index_id") == F.col("_i")) & F.col("security_id").eqNullSafe(F.col("_s")) & (F.col("_v") == F.col("_w"))
    return decided.join(source, same).select("index_id", "date", "asof_ts", "security_id", "available_at", "revision_id")


def known_intervals(rows: DataFrame, asofs: Sequence[object], bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """The membership history as each as-of knew it: (asof_ts, index_id, security_id, effective_from, effective_to).

    Intervals of a security in an index are disjoint and never touch; ``effective_to`` is null for one
    that no known row ends. ``asofs`` is a short list of stamps: a segment keeps the deciding row of each.
    """
    require_columns(rows, MEMBERSHIP_COLUMNS, "index_membership_pit")
    stamps = [timestamp_literal(a) for a in asofs]
    last = rows.agg(F.max(F.greatest("effective_from", F.coalesce("effective_to", "effective_from")))).first()[0]
    # Past the last border of all nothing changes any more: what holds on that day is open-ended.
    horizon = F.date_add(F.lit(last).cast("date"), 1)
    key = ["index_id", "security_id"]
    seen = F.lit(False)
    for stamp in stamps:
        seen = seen | (F.col("available_at") <= stamp)
    held = _ranked(rows.where(seen & F.col("index_id").isNotNull() & F.col("security_id").isNotNull())).drop("revision_id")
    cut = pieces(held, F.col("effective_from"), F.coalesce(F.col("effective_to"), horizon), bucket_days)
    first_day = bucket_start(F.col("_bucket"), bucket_days)
    inside = cut.select(*key, "_bucket", F.greatest("_lo", first_day).alias("lo"), F.least("_stop", F.date_add(first_day, bucket_days)).alias("hi"), "available_at", "_v")
    # From here on rows stay in the partition of their security: a piece is cut at the borders of its own bucket, at most its days.
    borders = Window.partitionBy(*key, "_bucket")
    edges = F.array_sort(F.array_union(F.collect_set("lo").over(borders), F.collect_set("hi").over(borders)))
    within = F.filter("_edges", lambda d: (d >= F.col("lo")) & (d <= F.col("hi")))
    segments = F.arrays_zip(F.expr("slice(_within, 1, size(_within) - 1)").alias("from"), F.expr("slice(_within, 2, size(_within) - 1)").alias("to"))
    spread = inside.withColumn("_edges", edges).withColumn("_within", within).select(*key, "available_at", "_v", F.explode(segments).alias("_g"))
    best = spread.groupBy(*key, F.col("_g.from").alias("from"), F.col("_g.to").alias("to")).agg(*[F.max(F.when(F.col("available_at") <= stamp, F.col("_v"))).alias(f"_v{i}") for i, stamp in enumerate(stamps)])
    members = F.filter(F.array_distinct(F.array(*[F.when(F.col(f"_v{i}") % 2 == 1, stamp) for i, stamp in enumerate(stamps)])), lambda a: a.isNotNull())
    held = best.select(F.explode(members).alias("asof_ts"), *key, "from", "to")
    # Islands: segments are disjoint and in order, at most the days of the history for one security.
    order = Window.partitionBy("asof_ts", *key).orderBy("from")
    fresh = F.when(F.lag("to").over(order) == F.col("from"), 0).otherwise(1)
    numbered = held.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy("asof_ts", *key, "_island").agg(F.min("from").alias("effective_from"), F.max("to").alias("stop"))
    return islands.select("asof_ts", *key, "effective_from", F.when(F.col("stop") < horizon, F.col("stop")).alias("effective_to"))
