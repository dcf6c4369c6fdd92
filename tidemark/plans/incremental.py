"""Incremental build: append or correct bars, and carry the running growth on from the last stored row.

A stored table is parquet by (year, bucket), the bucket by hash of the security, with a digest per partition
beside it. An append reads only the partitions that its rows fall into, merges, and replaces those whose
digest changed. Running it again finds the same digests and writes nothing, and a run that died between two
writes is finished by running it again.

The growth table holds the running product of ``1 + r`` per security. What changed says from which date on a
security has to be priced again; the row before it is carried in as the first factor, so the product goes on
with the same numbers in the same order as a full build, and ends in the same bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.contracts import OK, ContractViolation, duplicate_keys, enforce, require_columns
from tidemark.operators.actions import visible_inputs
from tidemark.operators.calendar import SessionCalendar
from tidemark.operators.lineage import fingerprint
from tidemark.operators.returns import return_points
from tidemark.staging import stage

KEY = ("security_id", "trade_date")
PARTS = ("year", "bucket")
BARS, GROWTH = "bars", "growth"
GROWTH_COLUMNS = ("security_id", "trade_date", "close", "status", "block_reason", "adjusted_return", "cum_growth")


@dataclass(frozen=True)
class Store:
    """A folder that all nodes reach, and the number of security buckets, which is fixed for the life of the store."""

    path: str
    buckets: int = 64

    def table(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def parts(self) -> list[Column]:
        return [F.year("trade_date").alias("year"), bucket_of(F.col("security_id"), self.buckets).alias("bucket")]


def bucket_of(security_id: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(security_id.cast("binary")), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read(spark: SparkSession, store: Store, name: str) -> DataFrame | None:
    return spark.read.parquet(store.table(name)) if _exists(spark, store.table(name)) else None


def digests(spark: SparkSession, store: Store, name: str) -> DataFrame | None:
    """(year, bucket, fingerprint, rows) of a stored table, as recorded."""
    return read(spark, store, f"{name}_digests")


def _write(df: DataFrame, path: str, parts: Sequence[str], order: Sequence[str]) -> None:
    spread = df.repartition(*parts).sortWithinPartitions(*parts, *order)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def replace_partitions(spark: SparkSession, store: Store, name: str, merged: DataFrame) -> DataFrame:
    """Write the partitions of ``merged`` whose content differs from what is recorded; returns those, (year, bucket, fingerprint, rows).

    ``merged`` holds whole partitions and is staged, so that it may have been read from the table itself.
    """
    columns = [c for c in merged.columns if c not in PARTS]
    fresh = stage(fingerprint(merged, PARTS, columns, buckets=64), "digests")
    known = digests(spark, store, name)
    if known is None:
        changed = fresh
    else:
        recorded = known.select(*PARTS, F.col("fingerprint").alias("_old"))
        changed = fresh.join(recorded, list(PARTS), "left").where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).drop("_old")
    changed = stage(changed, "changed")
    if changed.isEmpty():
        return changed
    # The recorded digests of the years that change, with the new ones in their place.
    years = changed.select("year").distinct()
    kept = changed if known is None else known.join(years, "year", "left_semi").join(changed.select(*PARTS), list(PARTS), "left_anti").select(*changed.columns).unionByName(changed)
    kept = stage(kept, "digests")
    _write(merged.join(changed.select(*PARTS), list(PARTS), "left_semi"), store.table(name), PARTS, KEY)
    _write(kept, store.table(f"{name}_digests"), ["year"], ["bucket"])
    return changed


def append_bars(spark: SparkSession, store: Store, rows: DataFrame) -> DataFrame:
    """Add rows, or replace stored ones of the same (security_id, trade_date); returns (security_id, since) of what changed.

    Rows equal to what is stored change nothing. Two rows of one key in ``rows`` fail: only the caller knows which one is later.
    """
    require_columns(rows, [*KEY, "close"], "bars")
    if set(PARTS) & set(rows.columns):
        raise ContractViolation(f"{PARTS} are the store's own columns")
    incoming = stage(rows.select("*", *store.parts()), "incoming")
    enforce(duplicate_keys(incoming, KEY, "DUPLICATE_BAR"))
    stored = read(spark, store, BARS)
    if stored is None:
        replace_partitions(spark, store, BARS, incoming)
        return incoming.groupBy("security_id").agg(F.min("trade_date").alias("since"))
    if sorted(stored.columns) != sorted(incoming.columns):
        raise ContractViolation("appended bars have other columns than the stored ones")
    touched = F.broadcast(incoming.select(*PARTS).distinct())  # one row per partition: years x buckets at most
    before = stored.join(touched, list(PARTS), "left_semi").select(*incoming.columns)
    merged = stage(before.join(incoming.select(*KEY), list(KEY), "left_anti").unionByName(incoming), "merged")
    news = stage(incoming.exceptAll(before), "news")
    replace_partitions(spark, store, BARS, merged)
    return news.groupBy("security_id").agg(F.min("trade_date").alias("since"))


def changed_by_actions(before: DataFrame, after: DataFrame, asof_ts: object) -> DataFrame:
    """(security_id, since) where the pricing inputs known at an as-of differ between two versions of the actions table."""
    old, new = (visible_inputs(a, asof_ts).withColumn("action_types", F.concat_ws(",", "action_types")) for a in (before, after))
    differing = old.exceptAll(new).unionByName(new.exceptAll(old))
    return differing.groupBy("security_id").agg(F.min("ex_date").alias("since"))


def extend_growth(spark: SparkSession, store: Store, actions: DataFrame, cal: SessionCalendar, asof_ts: object, changed: DataFrame) -> DataFrame:
    """Price the changed securities again from their ``since`` on and carry the running growth forward; returns the partitions written.

    Only partitions of a changed security from the year of ``since`` on are read, besides one stored row per security
    and year. ``changed`` may hold a security several times; the earliest date counts.
    """
    since = stage(changed.groupBy("security_id").agg(F.min("since").alias("since")).withColumn("bucket", bucket_of(F.col("security_id"), store.buckets)), "since")
    if since.isEmpty():
        return since.select(F.lit(0).alias("year"), "bucket", F.lit("").alias("fingerprint"), F.lit(0).cast("long").alias("rows")).where(F.lit(False))
    first_year = since.agg(F.min(F.year("since"))).first()[0]
    bars = read(spark, store, BARS).where(F.col("year") >= first_year).join(since.drop("bucket"), "security_id").where("trade_date >= since").drop("since", *PARTS)
    stored, tails = read(spark, store, GROWTH), read(spark, store, "growth_tails")
    columns = [c for c in ("security_id", "trade_date", "close") if c in bars.columns]
    if stored is None:
        points, carry = bars.select(*columns), None
    else:
        # The row before: in the year of ``since``, or the last row of an earlier year.
        here = stored.where(F.col("year") >= first_year).join(since.drop("bucket"), "security_id").where("trade_date < since").select("security_id", F.struct("trade_date", "close", "cum_growth").alias("_t"))
        earlier = tails.join(since.drop("bucket"), "security_id").where(F.col("year") < F.year("since")).select("security_id", F.struct("trade_date", "close", "cum_growth").alias("_t"))
        carry = stage(here.unionByName(earlier).groupBy("security_id").agg(F.max("_t").alias("_t")).select("security_id", "_t.*"), "carry")
        points = bars.select(*columns).unionByName(carry.select(*columns))
    priced = return_points(points, visible_inputs(actions, asof_ts), cal)
    growth = F.when(F.col("status") == OK, F.col("adjusted_return").cast("double") + 1.0).otherwise(1.0)
    if carry is not None:
        priced = priced.join(carry.select("security_id", "trade_date", F.col("cum_growth").alias("_carried")), ["security_id", "trade_date"], "left")
    else:
        priced = priced.withColumn("_carried", F.lit(None).cast("double"))
    run = Window.partitionBy("security_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # as long as the calendar
    fresh = priced.withColumn("cum_growth", F.product(F.coalesce("_carried", growth)).over(run)).where("_carried is null").select(*GROWTH_COLUMNS, *store.parts())
    fresh = stage(fresh, "growth-rows")
    if stored is None:
        merged = fresh
    else:
        touched = F.broadcast(fresh.select(*PARTS).distinct())
        kept = stored.join(touched, list(PARTS), "left_semi").join(since.select("security_id", "since"), "security_id", "left").where("since is null or trade_date < since").select(*fresh.columns)
        merged = stage(kept.unionByName(fresh), "growth-merged")
    changed_parts = replace_partitions(spark, store, GROWTH, merged)
    if not changed_parts.isEmpty():
        last = merged.groupBy("year", "security_id").agg(F.max(F.struct("trade_date", "close", "cum_growth")).alias("_t")).select("year", "security_id", "_t.*")
        years = F.broadcast(last.select("year").distinct())
        if tails is not None:
            last = tails.join(years, "year", "left_semi").join(last.select("year", "security_id"), ["year", "security_id"], "left_anti").select(*last.columns).unionByName(last)
        _write(stage(last, "tails"), store.table("growth_tails"), ["year"], ["security_id"])
    return changed_parts
