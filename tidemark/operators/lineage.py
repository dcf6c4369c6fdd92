"""Snapshot-id lists, content fingerprints and equivalence of two computations."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import ContractViolation, enforce, violation
from tidemark.operators.signals import RANKING_METHOD

HASH_DIGITS = 10


def join_snapshot_ids(df: DataFrame, by: Sequence[str], column: str = "snapshot_id", out: str = "input_snapshot_id") -> DataFrame:
    """Sorted distinct ids per group, ``;``-joined; inputs may be joined lists themselves.

    Ids are made distinct by a shuffle before they are listed, so the list holds ids,
    not rows.
    """
    pieces = df.select(*by, F.explode(F.split(F.coalesce(F.col(column), F.lit("")), ";")).alias("_id")).where(F.col("_id") != "").distinct()
    return pieces.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list("_id")), ";").alias(out))


def canonical_json(columns: Sequence[str]) -> Column:
    """One row as JSON with keys in alphabetical order and explicit nulls."""
    fields = F.struct(*[F.col(name).cast("string").alias(name) for name in sorted(columns)])
    return F.to_json(fields, {"ignoreNullFields": "false"})


def fingerprint(df: DataFrame, by: Sequence[str], columns: Sequence[str], out: str = "fingerprint", buckets: int = 256, header: Mapping[str, object] | None = None) -> DataFrame:
    """SHA-256 per group over its rows, order-independent, without gathering them.

    ``header`` holds parameters that belong to the content, hashed before the rows.

    Row digests fall into buckets by their own leading bits; each (group, bucket) adds
    up its digests in four numeric lanes (partial aggregation, exact decimals). The
    final digest covers at most ``buckets`` short lines per group, however hot it is.
    """
    rows = df.select(*by, F.sha2(canonical_json(columns), 256).alias("_h"))
    lanes = [F.sum(F.conv(F.substring("_h", 1 + 15 * lane, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_l{lane}") for lane in range(4)]
    bucket = F.pmod(F.conv(F.substring("_h", 61, 4), 16, 10).cast("bigint"), F.lit(buckets))
    sums = rows.groupBy(*by, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), *lanes)
    line = F.concat_ws(":", F.col("_b").cast("string"), F.col("_n").cast("string"), "_l0", "_l1", "_l2", "_l3")
    top = json.dumps({k: str(v) for k, v in header.items()}, sort_keys=True, ensure_ascii=False) + "|" if header else ""
    digest = F.sha2(F.concat(F.lit(top), F.array_join(F.sort_array(F.collect_list(line)), "|")), 256).alias(out)
    return sums.groupBy(*by).agg(digest, F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the fingerprint and row count of a whole table."""
    return fingerprint(df, [], list(columns) if columns is not None else list(df.columns), buckets=4096)


def signal_fingerprint(points: DataFrame, header: Mapping[str, object] | None = None) -> DataFrame:
    """One manifest hash per signal date over its points, exclusions and ``header``.

    The header names what the points were made with: lookback, skip, ranking method, input snapshot.
    Two signals that differ in any of them have different hashes. As-of stamps, universe size and
    exclusions are part of the rows.
    """
    # As decimals of HASH_DIGITS places: the text of a double differs between runs in its last bits.
    rounded = points.withColumn("momentum_score", F.round("momentum_score", HASH_DIGITS).cast(f"decimal(28,{HASH_DIGITS})"))
    return fingerprint(rounded, ["signal_date"], ["security_id", "momentum_score", "cross_sectional_rank", "status", "reason", "score_date", "universe_size"], "signal_manifest_hash", header={"ranking_method": RANKING_METHOD, **(header or {})})


def frozen_violations(current: DataFrame, recorded_hash: str | None) -> DataFrame:
    """Tamper check: the recorded hash must exist and match the content."""
    if not recorded_hash or recorded_hash == "UNFROZEN":
        raise ContractViolation("slice is not frozen")
    return violation(table_fingerprint(current), F.col("fingerprint") != recorded_hash, "HASH_MISMATCH", ["fingerprint"])


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in only one of two computations, with the side that has them."""
    if sorted(a.columns) != sorted(b.columns):
        raise ContractViolation("computations have different columns")
    other = b.select(*a.columns)
    return a.exceptAll(other).withColumn("only_in", F.lit("a")).unionByName(other.exceptAll(a).withColumn("only_in", F.lit("b")))


def first_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Empty when equal, else the first differing row by key."""
    return differences(a, b).orderBy(*keys, "only_in").limit(1)


def assert_equivalent(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    found = first_difference(a, b, keys)
    enforce(violation(found, F.lit(True), "NOT_EQUIVALENT", list(keys), F.col("only_in")))
