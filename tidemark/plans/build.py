"""Data build: landed vendor bars and actions to contract tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.contracts import enforce, require_columns
from tidemark.operators import quality as q
from tidemark.operators.calendar import SessionCalendar, densify_bars
from tidemark.operators.pit import revision_conflicts
from tidemark.sources.builders import attach_action_pit
from tidemark.sources.writers import write_actions, write_bars, write_manifest


def build_bars(vendor_bars: DataFrame, cal: SessionCalendar, path: str, source_id: str, revision_id: str, snapshot_id: str) -> DataFrame:
    """Densify, write by year and return long-format build statistics."""
    require_columns(vendor_bars, ["security_id", "trade_date", "open", "high", "low", "close", "volume", "amount"], "vendor bars")
    write_bars(densify_bars(vendor_bars, cal, source_id, revision_id, snapshot_id), path)
    stored = vendor_bars.sparkSession.read.parquet(path)
    stats = q.bar_build_stats(stored)
    write_manifest(stats, f"{path}_manifest")
    return stats


def build_actions(actions: DataFrame, universe: DataFrame, path: str, revision_id: str, snapshot_id: str) -> DataFrame:
    """Stamp availability, refuse conflicting revisions, write and return statistics."""
    stamped = attach_action_pit(actions, snapshot_id, revision_id)
    enforce(revision_conflicts(stamped))
    write_actions(stamped, path)
    stored = actions.sparkSession.read.parquet(path)
    stats = q.action_build_stats(stored, universe)
    write_manifest(stats, f"{path}_manifest")
    return stats
