"""Intermediate tables that several later steps read.

A plan that reads an expensive intermediate five times computes it five times, and a
lost executor recomputes all of it. ``stage`` writes the intermediate once as parquet
in the shared checkpoint folder and reads it back: lineage is cut, later scans prune
columns, and Spark knows the real size when it picks a join. The shuffles that built it
are deleted once it is written: nothing reads them again.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The session's shared ``spark.checkpoint.dir``.

    Where it is unset, a folder of the warehouse is set for the session, which every node of a cluster
    reaches too, unless the warehouse itself is a folder of the driver's machine: then a cluster has nowhere
    to stage and this fails. Nothing is ever staged in a machine-local folder of a cluster.
    """
    configured = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        system = spark._jvm.org.apache.hadoop.fs.Path(warehouse).getFileSystem(spark._jsc.hadoopConfiguration())
        configured = fallback_folder(warehouse, system.getUri().getScheme(), spark.sparkContext.master)
        spark.conf.set(SETTING, configured)
    return configured.rstrip("/")


def fallback_folder(warehouse: str, scheme: str, master: str) -> str:
    """The folder of the warehouse to stage in; a machine-local one (scheme file) serves a local master only."""
    if scheme == "file" and not master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all nodes reach: the warehouse {warehouse} is the driver's own")
    return f"{warehouse.rstrip('/')}/_staged"


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """What is written inside has its own plan: no later one reads its shuffles."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path, compression="zstd")
    _WRITTEN.setdefault(id(spark), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *key: str, a_core: int | None = None) -> DataFrame:
    """Rows dealt by key into the session's number of shuffle partitions (``a_core`` for each core at most), kept as many.

    What follows folds, sorts or spreads each key's rows: long work on few bytes, which AQE would put into one task.
    """
    spark = rows.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if a_core is not None:
        number = min(number, a_core * spark.sparkContext.defaultParallelism)
    return rows.repartition(number, *key)


_WRITTEN: dict[int, list[str]] = {}


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove staged folders (all of the session's own, or ``paths``); results read from them must be saved before."""
    written = _WRITTEN.setdefault(id(spark), [])
    for path in list(written) if paths is None else paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        written.remove(path)


@contextmanager
def staging_scope(spark: SparkSession):
    """Remove what was staged inside once the block ends."""
    before = set(_WRITTEN.setdefault(id(spark), []))
    try:
        yield
    finally:
        release(spark, [p for p in _WRITTEN[id(spark)] if p not in before])
