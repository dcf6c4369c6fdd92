"""Forward open-to-open labels and their evaluation-side reader."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import BLOCKED, EVIDENCE_TAINTED, LABEL_COLUMNS, OK, PIT_DERIVED, ContractViolation, enforce, require_columns, union_all, violation
from tidemark.functions.scalars import market_close_ts, market_open_ts, pad_id, timestamp_literal
from tidemark.operators.actions import event_intervals, manifest_text
from tidemark.operators.calendar import SessionCalendar, next_session
from tidemark.operators.pit import pit_basis_violations
from tidemark.operators.returns import Timeline, open_to_open_return, prepare_timeline
from tidemark.operators.signals import id_date_grid

HOLDING_SESSIONS = 21
LABEL_SPEC = "forward_21d_t1_to_t22_open_pit_adjusted_return"


@dataclass(frozen=True)
class LabelSpec:
    name: str = LABEL_SPEC
    holding: int = HOLDING_SESSIONS
    entry_lag: int = 1
    price_basis: str = PIT_DERIVED

    @property
    def exit_lag(self) -> int:
        return self.entry_lag + self.holding


def future_return_labels(
    bars: DataFrame,
    actions: DataFrame,
    cal: SessionCalendar,
    ids: DataFrame,
    signal_dates: Sequence[dt.date],
    spec: LabelSpec = LabelSpec(),
    manifest: bool = True,
    line: Timeline | None = None,
) -> DataFrame:
    """Labels per (signal date, id): enter at the next open, leave ``holding`` sessions later.

    Everything is derived as of the exit's 15:00 close, the moment the label is observed.
    """
    known = set(cal.dates)
    outside = [d for d in signal_dates if d not in known]
    if outside:
        raise ContractViolation(f"signal dates are not sessions: {outside[:3]}")
    if spec.price_basis != PIT_DERIVED or spec.entry_lag < 1 or spec.holding < 1:
        raise ContractViolation("unsupported label spec")
    position = {d: i for i, d in enumerate(cal.dates)}
    early = [d for d in signal_dates if position[d] + spec.exit_lag >= cal.size]
    if early:
        raise ContractViolation(f"no exit session for signal dates: {early[:3]}")
    if line is None:
        line = prepare_timeline(bars, actions, cal, ids)
    grid = id_date_grid(ids, cal, signal_dates)
    dated = next_session(next_session(grid, cal, "signal_date", spec.entry_lag, "entry_date"), cal, "signal_date", spec.exit_lag, "exit_date")
    pairs = dated.withColumn("asof_ts", market_close_ts("exit_date"))
    results = open_to_open_return(pairs, line, cal)
    status = (
        F.when(F.col("status") == OK, OK)
        .when(F.col("block_reason") == "MISSING_ENTRY_OPEN", "NOT_TRADABLE_ENTRY")
        .when(F.col("block_reason") == "MISSING_EXIT_OPEN", "NOT_TRADABLE_EXIT")
        .when(F.col("status") == BLOCKED, BLOCKED)
        .otherwise("NO_DATA")
    )
    if manifest:
        # Only labels that reached the return carry events, as the early exits do not.
        results = results.join(event_intervals(actions), "security_id", "left")
        reached = ~F.col("block_reason").isin("MISSING_ENTRY_OPEN", "MISSING_EXIT_OPEN") | F.col("block_reason").isNull()
        text = F.when(reached, manifest_text(F.col("security_id"), F.coalesce("_events", F.array().cast("array<struct<ex_date:date,action_type:string,available_at:timestamp_ntz,superseded_at:timestamp_ntz,source_id:string>>")), F.col("asof_ts")))
        manifest_column = F.coalesce(text, F.lit("no_visible_ca_events"))
    else:
        manifest_column = F.lit("not_requested")
    return results.select(
        "security_id",
        "signal_date",
        market_close_ts("signal_date").alias("signal_asof_ts"),
        market_open_ts("entry_date").alias("entry_ts"),
        market_open_ts("exit_date").alias("exit_ts"),
        F.col("adjusted_return").alias("future_return"),
        market_open_ts("exit_date").alias("label_end_ts"),
        F.col("asof_ts").alias("label_observed_at"),
        F.lit(spec.name).alias("label_spec"),
        F.lit(PIT_DERIVED).alias("price_basis"),
        manifest_column.alias("corporate_action_manifest"),
        status.alias("status"),
        F.col("block_reason").alias("reason"),
        F.lit(EVIDENCE_TAINTED).alias("evidence_status"),
    )


def query_labels(labels: DataFrame, ids: Sequence[str] | DataFrame, entry_ts: object, exit_ts: object, spec: str = LABEL_SPEC, check: bool = True) -> DataFrame:
    """Exact entry, exit and spec match on a contract-checked label table."""
    if spec != LABEL_SPEC:
        raise ContractViolation(f"unsupported label spec: {spec}")
    require_columns(labels, LABEL_COLUMNS, "future_return_labels")
    if check:
        no_manifest = violation(labels, F.col("corporate_action_manifest").isNull(), "LABEL_WITHOUT_MANIFEST", ["security_id"])
        enforce(union_all([pit_basis_violations(labels), no_manifest]))
    picked = labels.where(
        (F.col("entry_ts") == timestamp_literal(entry_ts)) & (F.col("exit_ts") == timestamp_literal(exit_ts)) & (F.col("label_spec") == spec)
    )
    if isinstance(ids, DataFrame):
        picked = picked.join(ids.select("security_id").distinct(), "security_id", "left_semi")
    else:
        picked = picked.where(pad_id("security_id").isin(sorted({str(i).zfill(6) for i in ids})))
    defaults = {"status": OK, "evidence_status": EVIDENCE_TAINTED}
    return picked.withColumns({name: F.coalesce(F.col(name), F.lit(value)) if name in labels.columns else F.lit(value) for name, value in defaults.items()})


def is_mature(evaluation_asof: object) -> Column:
    asof = timestamp_literal(evaluation_asof)
    return (F.col("label_end_ts") <= asof) & (F.col("label_observed_at") <= asof)
