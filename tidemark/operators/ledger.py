"""FIFO lots, corporate-action entitlements, ledger replay and daily NAV.

Fills are keyed by (portfolio, security, execution date, side), so everything that is
ordered per (portfolio, security) is bounded by the calendar; what is ordered per
portfolio (cash) runs in two levels, per day and across days. Only two things are
sequential by nature and fold over short arrays: the actions of one security held by
one portfolio, and the sells that consume one lot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import LEDGER_ACTION_TYPES, duplicate_keys, union_all, violation
from tidemark.functions.scalars import clock, decimal_or_zero, market_close_ts, money
from tidemark.operators.asof import running_sum
from tidemark.operators.calendar import SessionCalendar, next_session, with_session_idx
from tidemark.operators.pit import latest_revision
from tidemark.staging import dealt, stage

POSITION = ["portfolio_id", "security_id"]
LATE_REASON = "CA_AVAILABLE_AFTER_APPLICATION_ASOF"
#: Cells of a block of positions and sessions, of the sums that one task keeps, and what sums of 64 bits may reach.
BLOCK_CELLS, KEPT_CELLS, SAFE = 2_000_000, 4_000_000, 2**62


def fill_key_violations(fills: DataFrame) -> DataFrame:
    return duplicate_keys(fills, [*POSITION, "execution_date", "side"], "DUPLICATE_FILL_KEY")


# -- entitlements ------------------------------------------------------------------------


def ledger_actions(actions: DataFrame, cal: SessionCalendar) -> DataFrame:
    """What the ledger does with each action on its ex-date session.

    Visible by 09:00: APPLY (latest revision per type), or UNSUPPORTED for other types.
    Visible only later that day, with no 09:00 version of its key: UNPROCESSED.
    """
    key = ["security_id", "ex_date", "action_type"]
    on_session = with_session_idx(actions, cal, "ex_date", "_s").where(F.col("_s").isNotNull()).drop("_s")
    morning = on_session.where(F.col("available_at") <= clock("ex_date", 9))
    kind = F.when(F.col("action_type").isin(*LEDGER_ACTION_TYPES), "APPLY").otherwise("UNSUPPORTED")
    columns = [*key, "available_at", decimal_or_zero("cash_dividend_per_share").alias("cash"), decimal_or_zero("share_ratio").alias("ratio")]
    applied = latest_revision(morning).select(*columns, kind.alias("kind"), F.lit(1).alias("ord"))
    same_day = on_session.where((F.col("available_at") > clock("ex_date", 9)) & (F.col("available_at") <= market_close_ts("ex_date")))
    late = same_day.join(morning.select(*key).distinct(), key, "left_anti").select(*columns, F.lit("UNPROCESSED").alias("kind"), F.lit(0).alias("ord"))
    return applied.unionByName(late)


def _fold_entitlements(rows: DataFrame) -> DataFrame:
    """Fold ``acts`` (in order) along each position; stock dividends add up along the fold.

    The position from fills alone is the sum of ``flows`` before an action's day or, where ``bases`` are given instead,
    each of them in turn. A batch folds together: the positions before all actions by one search, the bonus by one step per
    payout that a security made, never one per position.
    """
    schema = rows.schema
    kinds = [(name, schema[name].dataType.simpleString()) for name in POSITION] + [(f.name, f.dataType.simpleString()) for f in schema["acts"].dataType.elementType.fields if f.name != "micro"]
    columns = ", ".join(f"{name} {kind}" for name, kind in [*kinds, ("prior", "bigint"), ("share_delta", "bigint")])
    return rows.mapInArrow(_folded, columns)


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All elements of the lists, and where each list begins and the last one ends."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]


def _numbers(values: pa.Array, missing: int = 0) -> np.ndarray:
    return values.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)


def _days(values: pa.Array) -> np.ndarray:
    """Day numbers; a missing day comes before all others."""
    return _numbers(values.cast(pa.int32()), -(2**31)) + 2**32


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        acts, starts = _flat(batch.column("acts"))
        act_row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        if "flows" in batch.schema.names:
            flows, begins = _flat(batch.column("flows"))
            key = np.repeat(np.arange(batch.num_rows) << 34, np.diff(begins)) + _days(flows.field("day"))
            order = np.argsort(key, kind="stable")
            run = np.concatenate([[0], np.cumsum(_numbers(flows.field("delta"))[order])])
            before = np.searchsorted(key[order], (act_row << 34) + _days(acts.field("ex_date")), side="left")
            act, row, base = np.arange(len(acts)), act_row, run[before] - run[begins[act_row]]
        else:
            bases, begins = _flat(batch.column("bases"))
            each, values = np.diff(begins), _numbers(bases)
            values = values[np.lexsort((values, np.repeat(np.arange(batch.num_rows), each)))]
            act = np.repeat(np.arange(len(acts)), each[act_row])
            row = act_row[act]
            nth = np.arange(len(act)) - np.repeat(np.cumsum(each[act_row]) - each[act_row], each[act_row])
            base = values[begins[row] + nth]
        micro, granted, bonus = _numbers(acts.field("micro"))[act], np.zeros(len(act), np.int64), np.zeros(batch.num_rows, np.int64)
        paying = np.flatnonzero(micro > 0)
        if len(paying):
            own = row[paying]
            step = np.arange(len(paying)) - np.searchsorted(own, own, side="left")
            turn = np.argsort(step, kind="stable")
            for at in np.split(paying[turn], np.flatnonzero(np.diff(step[turn])) + 1):
                held, rate = np.maximum(base[at] + bonus[row[at]], 0), micro[at]
                wide = int(held.max()) * int(rate.max()) >= 2**63
                granted[at] = (held.astype(object) * rate // 1_000_000).astype(np.int64) if wide else held * rate // 1_000_000
                bonus[row[at]] += granted[at]
        total = np.concatenate([[0], np.cumsum(granted)])
        first = np.searchsorted(row, row, side="left")
        prior = base + total[:-1] - total[first]
        kept = np.flatnonzero(prior > 0)
        found, where = acts.take(pa.array(act[kept])), pa.array(row[kept])
        names = [f.name for f in acts.type if f.name != "micro"]
        yield pa.RecordBatch.from_arrays([*[batch.column(name).take(where) for name in POSITION], *[found.field(name) for name in names], pa.array(prior[kept]), pa.array(granted[kept])], [*POSITION, *names, "prior", "share_delta"])


#: Shares of a security's positions, each beside its own copy of the security's actions.
SHARES = 8


def _share() -> Column:
    return F.pmod(F.xxhash64("portfolio_id"), F.lit(SHARES)).cast("int")


def _with_actions(positions: DataFrame, actions: DataFrame, cal: SessionCalendar) -> DataFrame:
    """Each position (with its ``_share``) beside ``acts``, the actions of its security as one array: no row per position and action is moved."""
    paid = F.when((F.col("kind") == "APPLY") & (F.col("ratio") > 0), (F.col("ratio") * 1_000_000).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    act = F.struct("ex_date", "ord", "action_type", "available_at", "kind", "cash", "ratio", paid.alias("micro"))
    acts = ledger_actions(actions, cal).groupBy("security_id").agg(F.sort_array(F.collect_list(act)).alias("acts"))
    shared = acts.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    # Merged, not broadcast: the join keeps the partitions of the positions.
    return positions.join(shared.hint("merge"), ["security_id", "_share"])


def dividend_entitlements(actions: DataFrame, positions: DataFrame, cal: SessionCalendar) -> DataFrame:
    """Entitlements of given positions ``(portfolio_id, security_id, total_quantity)``.

    Cash accrues per payout and position in cents and pays on the next session (null
    when the calendar ends: it stays pending). Stock adds ``floor(position * ratio)``.
    """
    held = dealt(positions.where(F.col("total_quantity") > 0).withColumn("_share", _share()), "security_id", "_share").groupBy(*POSITION, "_share").agg(F.collect_list(F.col("total_quantity").cast("bigint")).alias("bases"))
    return _entitled(_fold_entitlements(_with_actions(held, actions, cal).select(*POSITION, "acts", "bases")), cal)


def _entitled(folded: DataFrame, cal: SessionCalendar) -> DataFrame:
    held = folded.where(F.col("prior") > 0)
    amount = F.when((F.col("kind") == "APPLY") & (F.col("cash") > 0), money(F.col("cash") * F.col("prior").cast("decimal(16,0)")))
    dated = next_session(held.withColumn("accrued", F.coalesce(amount, F.lit(0).cast("decimal(18,2)"))), cal, "ex_date", out="pay_date")
    return dated


def entitlements(fills: DataFrame, actions: DataFrame, cal: SessionCalendar) -> DataFrame:
    """Entitlements along the positions that fills and earlier stock dividends build up.

    The fills of a position become one array of days, as long as the calendar at most, and meet its security's actions there.
    """
    signed = F.when(F.col("side") == "buy", F.col("filled_quantity")).otherwise(-F.col("filled_quantity"))
    # Dealt once by security and share: both groupings, the join and the fold stay where the rows are.
    moved = dealt(fills.select(*POSITION, F.col("execution_date").alias("day"), signed.cast("bigint").alias("delta"), _share().alias("_share")), "security_id", "_share")
    daily = moved.groupBy(*POSITION, "_share", "day").agg(F.sum("delta").alias("delta"))
    flows = daily.groupBy(*POSITION, "_share").agg(F.collect_list(F.struct("day", "delta")).alias("flows"))
    return _entitled(_fold_entitlements(_with_actions(flows, actions, cal).select(*POSITION, "acts", "flows")), cal)


# -- FIFO -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class FifoResult:
    matches: DataFrame
    remaining: DataFrame
    sells: DataFrame
    violations: DataFrame


def fifo_match(fills: DataFrame, grants: DataFrame | None = None, openings: DataFrame | None = None) -> FifoResult:
    """First-in first-out matching of sells to lots, with cent-exact partial costs.

    Lots are buys (sellable from the next session), zero-cost grants (sellable at once)
    and optional openings ``(portfolio_id, security_id, lot_date, quantity, cost)``. Lots
    and sells are laid out as intervals of the running quantity; their merged end points
    cut elementary segments, and each segment belongs to one lot and one sell. No lot is
    compared with a sell it does not meet. Rows are sorted by position and stream through
    ``_segmented``, which cuts all whole positions of a batch together.
    """
    buys = fills.where("side = 'buy'").select(*POSITION, F.col("execution_date").alias("lot_date"), F.lit(1).alias("lot_kind"), F.lit("").alias("lot_tag"), F.col("filled_quantity").cast("bigint").alias("quantity"), F.col("net_amount").cast("decimal(18,2)").alias("cost"))
    parts = [buys]
    if grants is not None:
        parts.append(grants.select(*POSITION, F.col("ex_date").alias("lot_date"), F.lit(0).alias("lot_kind"), F.col("action_type").alias("lot_tag"), F.col("share_delta").alias("quantity"), F.lit(0).cast("decimal(18,2)").alias("cost")).where(F.col("quantity") > 0))
    if openings is not None:
        parts.append(openings.select(*POSITION, "lot_date", F.lit(-1).alias("lot_kind"), F.lit("").alias("lot_tag"), F.col("quantity").cast("bigint").alias("quantity"), F.col("cost").cast("decimal(18,2)").alias("cost")))
    lots = union_all(parts)
    sells = fills.where("side = 'sell'").select(*POSITION, F.col("execution_date").alias("sell_date"), F.col("filled_quantity").cast("bigint").alias("quantity"), F.col("net_amount").cast("decimal(18,2)").alias("net"))

    # Lots and sells are dealt once, as plain columns; every window and grouping below is by position too.
    narrow = lots.select(*POSITION, F.lit(0).alias("typ"), F.col("lot_date").alias("day"), "lot_kind", "lot_tag", "quantity", F.col("cost").alias("amount")).unionByName(
        sells.select(*POSITION, F.lit(1).alias("typ"), F.col("sell_date").alias("day"), F.lit(0).alias("lot_kind"), F.lit("").alias("lot_tag"), "quantity", F.col("net").alias("amount"))
    )
    ordered = dealt(narrow, *POSITION).sortWithinPartitions(*POSITION, "typ", "day", "lot_kind", "lot_tag")
    keys = ", ".join(f"{name} {narrow.schema[name].dataType.simpleString()}" for name in POSITION)
    segments = lambda what, columns: ordered.mapInArrow(_segmented(what), f"{keys}, {columns}")
    lot = "lot_date date, lot_kind int, lot_tag string"
    checked = segments("broken", "_day date, quantity bigint, exceeds boolean")
    key = [*POSITION, "_day"]
    broken = union_all(
        [
            violation(checked, F.col("exceeds"), "SELL_EXCEEDS_POSITION", key, F.col("quantity")),
            violation(checked, ~F.col("exceeds"), "SELL_BEFORE_SELLABLE", key, F.col("quantity")),
        ]
    )
    matches = segments("matches", f"{lot}, sell_date date, quantity bigint, cost decimal(18,2)")
    remaining = segments("remaining", f"{lot}, quantity bigint, cost decimal(18,2)")
    booked = segments("sells", "sell_date date, quantity bigint, net_amount decimal(18,2), consumed_cost decimal(18,2)")
    pnl = (F.col("net_amount") - F.col("consumed_cost")).cast("decimal(18,2)")
    return FifoResult(matches, remaining, booked.withColumn("realized_pnl", pnl), broken)


def _whole_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in runs of whole positions, with the place of each row's position among them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        whole = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()
        if not whole:
            continue
        place = _places(whole[0])
        # The last position may go on in the next batch.
        last = int(np.searchsorted(place, place[-1]))
        rest = [whole[0].slice(last)]
        if last:
            yield whole[0].slice(0, last), place[:last]
    for batch in rest:
        yield batch, _places(batch)


def _places(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (_codes(batch.column(name)) for name in POSITION)
    return np.concatenate([[0], np.cumsum((np.diff(a) != 0) | (np.diff(b) != 0))])


def _codes(values: pa.Array) -> np.ndarray:
    """Equal values, nulls too, have equal numbers."""
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _cents(values: pa.Array) -> np.ndarray:
    """Amounts of decimal(18,2) in cents, 0 where there is none."""
    words = np.frombuffer(values.buffers()[1], np.int64)[2 * values.offset : 2 * (values.offset + len(values)) : 2]
    return np.where(values.is_valid().to_numpy(zero_copy_only=False), words, 0)


def _amounts(cents: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """The other way; null where not known."""
    words = np.stack([cents, cents >> 63], axis=1)
    valid = None if known is None else pa.py_buffer(np.packbits(known, bitorder="little"))
    return pa.Array.from_buffers(pa.decimal128(18, 2), len(cents), [valid, pa.py_buffer(np.ascontiguousarray(words))])


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole quotients towards zero."""
    return np.where(a < 0, -(-a // b), a // b)


def _running(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each group of sorted rows."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[1:] - total[np.searchsorted(group, group, side="left")]


def _parts_of_costs(lot: np.ndarray, q: np.ndarray, quantity: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """What each segment takes of its lot's cost, rounded to cents; the segment that empties the lot takes the rest.

    Sequential in the segments of one lot, so each step goes over the next segment of all lots.
    """
    part, left, value = np.zeros(len(q), np.int64), quantity.copy(), cost.copy()
    if not len(q):
        return part
    wide = 2 * int(np.abs(value).max(initial=0)) * int(q.max()) + int(left.max()) >= SAFE
    step = np.arange(len(lot)) - np.searchsorted(lot, lot, side="left")
    turn = np.argsort(step, kind="stable")
    for at in np.split(turn, np.flatnonzero(np.diff(step[turn])) + 1):
        own = lot[at]
        c, n, have = value[own], q[at], left[own]
        if wide:
            taken = np.array([c_ if n_ == h_ else (abs(2 * c_ * n_ + h_) // (2 * h_)) * (1 if 2 * c_ * n_ + h_ >= 0 else -1) for c_, n_, h_ in zip(c.tolist(), n.tolist(), have.tolist(), strict=True)], np.int64)
        else:
            taken = np.where(n == have, c, _divided(2 * c * n + have, 2 * have))
        part[at] = taken
        value[own] -= taken
        left[own] -= n
    return part


def _segmented(what: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One kind of results of the segments into which the ends of lots and sells cut the running quantity of each position."""

    def of(batch: pa.RecordBatch, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        quantity, typ = _numbers(batch.column("quantity")), _numbers(batch.column("typ"))
        ends = _running(quantity, 2 * place + typ)
        span = int(ends.max()) + 1
        if span * int(place[-1] - place[0] + 1) >= SAFE and place[-1] > place[0]:
            half = int(np.searchsorted(place, (place[0] + place[-1]) // 2, side="right"))
            yield from of(batch.slice(0, half), place[:half])
            yield from of(batch.slice(half), place[half:])
            return
        # All positions lie behind each other on one line.
        at = (place - place[0]) * span + ends
        lots, sells = np.flatnonzero(typ == 0), np.flatnonzero(typ == 1)
        cuts = np.unique(at)
        owner = (cuts - 1) // span
        q = cuts - np.maximum(np.concatenate([[0], cuts[:-1]]), owner * span)
        cuts, owner, q = cuts[q > 0], owner[q > 0], q[q > 0]

        def met(rows: np.ndarray) -> np.ndarray:
            """The lot or sell that each segment lies in, -1 where there is none."""
            if not len(rows):
                return np.full(len(cuts), -1)
            k = np.searchsorted(at[rows], cuts, side="left")
            found = rows[np.minimum(k, len(rows) - 1)]
            return np.where((k < len(rows)) & (place[found] - place[0] == owner), found, -1)

        lot, sell = met(lots), met(sells)
        column = lambda name, rows: batch.column(name).take(pa.array(rows))
        key = lambda rows: [column(name, rows) for name in POSITION]
        if what == "broken":
            day = _days(batch.column("day"))
            dated = batch.column("day").is_valid().to_numpy(zero_copy_only=False)
            bought = _numbers(batch.column("lot_kind"))[lot] == 1
            early = (lot >= 0) & (sell >= 0) & dated[lot] & dated[sell] & np.where(bought, day[lot] >= day[sell], day[lot] > day[sell])
            bad = np.flatnonzero((sell >= 0) & ((lot < 0) | early))
            yield pa.RecordBatch.from_arrays([*key(sell[bad]), column("day", sell[bad]), pa.array(q[bad]), pa.array(lot[bad] < 0)], [*POSITION, "_day", "quantity", "exceeds"])
            return
        amount, priced = _cents(batch.column("amount")), batch.column("amount").is_valid().to_numpy(zero_copy_only=False)
        owned = np.flatnonzero(lot >= 0)
        part = np.zeros(len(q), np.int64)
        part[owned] = _parts_of_costs(lot[owned], q[owned], quantity, amount)
        if what == "sells":
            # A sell's cost is that of its date; rows without a whole key meet none.
            day = np.concatenate([[0], np.cumsum((np.diff(place[sells]) != 0) | (np.diff(_days(batch.column("day"))[sells]) != 0))]) if len(sells) else sells
            known = np.logical_and.reduce([batch.column(name).is_valid().to_numpy(zero_copy_only=False)[sells] for name in (*POSITION, "day")])
            both = np.flatnonzero((lot >= 0) & (sell >= 0) & priced[lot])
            spent = np.zeros(len(sells), np.int64)
            np.add.at(spent, day[np.searchsorted(sells, sell[both])], part[both])
            yield pa.RecordBatch.from_arrays(
                [*key(sells), column("day", sells), column("quantity", sells), column("amount", sells), _amounts(np.where(known, spent[day], 0))],
                [*POSITION, "sell_date", "quantity", "net_amount", "consumed_cost"],
            )
            return
        kept = np.flatnonzero((lot >= 0) & ((sell >= 0) == (what == "matches")))
        mine = lot[kept]
        sold = [("sell_date", column("day", sell[kept]))] if what == "matches" else []
        named = [*zip(POSITION, key(mine), strict=True), ("lot_date", column("day", mine)), ("lot_kind", column("lot_kind", mine)), ("lot_tag", column("lot_tag", mine)), *sold, ("quantity", pa.array(q[kept])), ("cost", _amounts(part[kept], priced[mine]))]
        yield pa.RecordBatch.from_arrays([x for _, x in named], [n for n, _ in named])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, place in _whole_positions(batches):
            yield from of(batch, place)

    return run


# -- ledger -----------------------------------------------------------------------------------

# Entries with their phase of the day and their reason. Rows carry the number until they are booked.
EVENTS = (
    ("CA_DIVIDEND_PAID", 0, "CASH_DIVIDEND_PAID_SIMPLIFIED_EX_DATE_PLUS_ONE"),
    ("UNPROCESSED_CA", 1, f"UNPROCESSED_CA:{LATE_REASON}"),
    ("UNSUPPORTED_CORPORATE_EVENT", 2, None),
    ("CA_DIVIDEND_ACCRUED", 2, "CASH_DIVIDEND_RECEIVABLE_ACCRUED_TAX_GROSS"),
    ("CA_SHARES_ADJUSTED", 2, "STOCK_DIVIDEND_SHARES_ADJUSTED"),
    ("SELL_FILL", 3, "T1_OPEN_FILLED"),
    ("BUY_FILL", 4, "T1_OPEN_FILLED"),
    ("SELL_LOCK", 5, "SELL_INVENTORY_LOCKED"),
    ("SELL_LOCK_RELEASE", 3, "SELL_INVENTORY_LOCK_RELEASED"),
)


def replay_ledger(fills: DataFrame, actions: DataFrame, cal: SessionCalendar, opening_cash: DataFrame, sell_orders: DataFrame | None = None, granted: DataFrame | None = None) -> DataFrame:
    """Ledger entries with running position, available cash and dividends receivable.

    Day order: pay dividends, corporate actions, sells, buys, then sell locks decided at
    the close. ``opening_cash`` is ``(portfolio_id, cash)``; ``sell_orders`` adds lock and
    release entries from locked sell orders and their outcomes (``status`` column).
    """
    # Read by the lots and by five kinds of entries: staged, so that positions are folded once.
    grants = stage(entitlements(fills, actions, cal), "entitlements") if granted is None else granted
    fifo = fifo_match(fills, grants.where(F.col("share_delta") > 0))
    zero = F.lit(0).cast("decimal(18,2)")
    none = F.lit(0).cast("bigint")

    def entry(df: DataFrame, kind: Column, day: Column, tag: Column = F.lit(None), quantity: Column = none, cash: Column = zero, cost: Column = zero, pnl: Column = zero, locked: Column = none, receivable: Column = zero) -> DataFrame:
        return df.select(
            *POSITION, day.alias("trade_date"), kind.cast("int").alias("_kind"), tag.cast("string").alias("_tag"),
            quantity.cast("bigint").alias("quantity_delta"), cash.cast("decimal(18,2)").alias("cash_delta"), cost.cast("decimal(18,2)").alias("cost_basis_delta"),
            pnl.cast("decimal(18,2)").alias("realized_pnl"), locked.cast("bigint").alias("locked_quantity_delta"), receivable.cast("decimal(18,2)").alias("receivable_delta"),
        )

    code = {name: F.lit(k) for k, (name, _, _) in enumerate(EVENTS)}
    ex = F.col("ex_date")
    accrued = grants.where(F.col("accrued") > 0)
    paid = accrued.where(F.col("pay_date").isNotNull()).groupBy(*POSITION, "ex_date", "pay_date").agg(F.sum("accrued").alias("amount"))
    buys = fills.where("side = 'buy'")

    def of_grant(name: str, when: Column, *tag: Column, quantity: Column = none, receivable: Column = zero) -> Column:
        return F.when(when, F.struct(code[name].alias("kind"), F.concat_ws("|", "action_type", *tag).alias("tag"), quantity.alias("quantity"), receivable.alias("receivable")))

    # What a grant books, in one pass over them.
    booked = F.array(
        of_grant("UNPROCESSED_CA", F.col("kind") == "UNPROCESSED", F.col("available_at").cast("string")),
        of_grant("UNSUPPORTED_CORPORATE_EVENT", F.col("kind") == "UNSUPPORTED", F.lit("0")),
        of_grant("CA_DIVIDEND_ACCRUED", F.col("accrued") > 0, F.lit("1"), receivable=F.col("accrued")),
        of_grant("CA_SHARES_ADJUSTED", F.col("share_delta") > 0, F.lit("2"), quantity=F.col("share_delta")),
    )
    granting = grants.select(*POSITION, "ex_date", F.explode(booked).alias("_e")).where(F.col("_e").isNotNull()).select(*POSITION, "ex_date", "_e.*")
    entries = [
        entry(paid, code["CA_DIVIDEND_PAID"], F.col("pay_date"), ex, cash=F.col("amount"), receivable=-F.col("amount")),
        entry(granting, F.col("kind"), ex, F.col("tag"), quantity=F.col("quantity"), receivable=F.col("receivable")),
        entry(fifo.sells, code["SELL_FILL"], F.col("sell_date"), quantity=-F.col("quantity"), cash=F.col("net_amount"), cost=-F.col("consumed_cost"), pnl=F.col("realized_pnl")),
        entry(buys, code["BUY_FILL"], F.col("execution_date"), quantity=F.col("filled_quantity"), cash=-F.col("net_amount"), cost=F.col("net_amount")),
    ]
    if sell_orders is not None:
        locks = sell_orders.where("side = 'sell' and lock_status = 'LOCKED'")
        entries.append(entry(locks, code["SELL_LOCK"], F.col("decision_date"), locked=F.col("quantity")))
        unfilled = locks.where("status <> 'FILLED'")
        entries.append(entry(unfilled, code["SELL_LOCK_RELEASE"], F.col("next_session"), F.lit("r"), locked=-F.col("quantity")))

    def phased(rows: DataFrame, *by: str) -> DataFrame:
        """Rows dealt by key, with the phase of the day in which each is booked."""
        return dealt(rows, *by).withColumn("_phase", F.coalesce(*[F.when(F.col("_kind") == k, F.lit(phase)) for k, (_, phase, _) in enumerate(EVENTS)]))

    # Rows without a day are numbered before all others and not given out, so they change no position either.
    by_position = Window.partitionBy(*POSITION, F.col("trade_date").isNull()).orderBy("trade_date", "_phase", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    summed = phased(union_all(entries), *POSITION).withColumns({
        "position_quantity_after": F.sum("quantity_delta").over(by_position),
        "cost_basis_after": F.sum("cost_basis_delta").over(by_position),
        "locked_quantity_after": F.sum("locked_quantity_delta").over(by_position),
    })
    # Read twice by the running sums: staged, so that its inputs are computed once.
    rows = stage(summed.drop("_phase"), "ledger-rows").withColumn("_one", F.lit(1))
    day = ["portfolio_id", "trade_date"]
    rows = running_sum(rows, day[:1], day[1:], ["_phase", "security_id", "_tag"], ["cash_delta", "receivable_delta", "_one"], ["_cash", "_receivable", "event_id"], phased(rows, *day))
    named = F.coalesce(*[F.when(F.col("_kind") == k, F.lit(name)) for k, (name, _, _) in enumerate(EVENTS)])
    # The tag of an unsupported event is its type, if it has one, and a mark.
    unsupported = (F.col("_kind") == code["UNSUPPORTED_CORPORATE_EVENT"]) & (F.col("_tag") != "0")
    why = F.coalesce(F.when(unsupported, F.concat(F.lit("UNSUPPORTED_CORPORATE_EVENT:"), F.expr("substring(_tag, 1, length(_tag) - 2)"))), *[F.when(F.col("_kind") == k, F.lit(reason)) for k, (_, _, reason) in enumerate(EVENTS) if reason])
    joined = rows.join(opening_cash.select("portfolio_id", F.col("cash").cast("decimal(18,2)").alias("_open")), "portfolio_id", "left")
    return joined.select(
        *POSITION, "trade_date", named.alias("event_type"), "quantity_delta", "cash_delta", "cost_basis_delta", "realized_pnl", why.alias("fill_reason"), "locked_quantity_delta", "receivable_delta", "event_id",
        "position_quantity_after", "cost_basis_after", "locked_quantity_after", (F.coalesce("_open", zero) + F.col("_cash")).cast("decimal(18,2)").alias("cash_after"), F.col("_receivable").cast("decimal(18,2)").alias("receivable_after"),
    )


def ledger_violations(entries: DataFrame) -> DataFrame:
    """States that no ledger may reach: overdrawn cash, receivables paid twice, oversold or over-released positions.

    Each is tested on its own running state, so an accrued dividend does not hide spent cash.
    """
    key = ["portfolio_id", "security_id", "trade_date", "event_id"]
    return union_all(
        [
            violation(entries, F.col("cash_after") < 0, "NEGATIVE_CASH", key, F.col("cash_after")),
            violation(entries, F.col("receivable_after") < 0, "NEGATIVE_RECEIVABLE", key, F.col("receivable_after")),
            violation(entries, F.col("position_quantity_after") < 0, "NEGATIVE_POSITION", key, F.col("position_quantity_after")),
            violation(entries, F.col("locked_quantity_after") < 0, "NEGATIVE_LOCK", key, F.col("locked_quantity_after")),
        ]
    )


def position_view(fills: DataFrame, actions: DataFrame, cal: SessionCalendar, day: object, locked: DataFrame | None = None) -> DataFrame:
    """Held positions after a date: total, sellable, locked, unsellable and cost.

    ``locked`` is ``(portfolio_id, security_id, locked_quantity)`` of open sell orders.
    """
    cutoff = F.lit(str(day)).cast("date")
    until = fills.where(F.col("execution_date") <= cutoff)
    grants = stage(entitlements(until, actions.where(F.col("ex_date") <= cutoff), cal), "entitlements")
    lots = fifo_match(until, grants.where(F.col("share_delta") > 0)).remaining
    free = (F.col("lot_kind") != 1) | (F.col("lot_date") < cutoff)
    held = lots.groupBy(*POSITION).agg(
        F.sum("quantity").alias("total_quantity"),
        F.sum(F.when(free, F.col("quantity")).otherwise(F.lit(0))).alias("_free"),
        F.sum("cost").cast("decimal(18,2)").alias("cost_basis"),
    )
    if locked is None:
        held = held.withColumn("locked_quantity", F.lit(0).cast("bigint"))
    else:
        held = held.join(locked, POSITION, "left").withColumn("locked_quantity", F.least(F.coalesce("locked_quantity", F.lit(0).cast("bigint")), F.col("_free")))
    return held.where(F.col("total_quantity") > 0).select(
        *POSITION, "total_quantity", (F.col("_free") - F.col("locked_quantity")).alias("sellable_quantity"), "locked_quantity",
        (F.col("total_quantity") - F.col("_free")).alias("unsellable_quantity"), "cost_basis",
    )


def position_violations(view: DataFrame) -> DataFrame:
    total = F.col("locked_quantity") + F.col("sellable_quantity") + F.col("unsellable_quantity")
    return violation(view, (total != F.col("total_quantity")) | (F.col("sellable_quantity") < 0) | (F.col("cost_basis") < 0), "POSITION_INVARIANT", POSITION, F.col("total_quantity"))


# -- marks and NAV ------------------------------------------------------------------------------


def mark_to_last_close(positions: DataFrame, bars: DataFrame, cal: SessionCalendar, day: str = "trade_date") -> DataFrame:
    """Latest non-null close at or before each position's date, with its age in sessions.

    ``positions`` holds ``security_id`` and a date; marks are built once per security and
    session from the bars, then joined on both. A held id without any close fails.
    """
    located = cal.positions(positions, day, "_at").drop("_member")
    joined = located.join(_marks(bars, cal), ["security_id", "_at"], "left")
    mark = F.when(F.col("_close").isNull(), F.raise_error(F.concat(F.lit("no visible close for held security "), F.col("security_id")))).otherwise(money("_close"))
    return joined.withColumns({"mark": mark, "stale_sessions": F.col("_at") - F.col("_from")}).drop("_at", "_close", "_from")


def _marks(bars: DataFrame, cal: SessionCalendar) -> DataFrame:
    """Last close per security and session, with the session it is from: each close lasts until the next one."""
    closes = with_session_idx(bars.where(F.col("close").isNotNull()).select("security_id", "trade_date", "close"), cal, "trade_date", "_from").where(F.col("_from").isNotNull())
    order = Window.partitionBy("security_id").orderBy("_from")
    until = F.coalesce(F.lead("_from").over(order) - 1, F.lit(cal.size - 1))
    return closes.withColumn("_until", until).select("security_id", F.col("close").alias("_close"), "_from", F.explode(F.sequence("_from", "_until")).alias("_at"))


def _on_session(df: DataFrame, index: str, day: str) -> DataFrame:
    """A ledger date off the calendar cannot be placed in a NAV: fail."""
    message = F.concat(F.lit("not a session: "), F.col(day).cast("string"))
    return df.withColumn(index, F.coalesce(F.col(index), F.raise_error(message).cast("int")))


def _holdings_value(located: DataFrame, bars: DataFrame, cal: SessionCalendar) -> DataFrame:
    """(portfolio_id, _at) with the market value, cost and unmarked positions of what is held after each session.

    Portfolios are dealt into rows and securities into columns of a grid of tasks. A cell gets the position changes of its
    portfolios and securities and the closes of its securities, so closes move once per row and sums of a portfolio once
    per column, and the product of positions and sessions is only ever a block of numbers in one task.
    """
    number = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, isqrt(number // 3))
    down = max(1, number // across)
    column = F.pmod(F.xxhash64("security_id"), F.lit(across)).cast("int")
    cents = lambda name: (F.col(name) * 100).cast("bigint")
    changed = (F.coalesce("quantity_delta", F.lit(0)) != 0) | (F.coalesce("cost_basis_delta", F.lit(0)) != 0)
    moves = located.where(changed).select(
        (F.pmod(F.xxhash64("portfolio_id"), F.lit(down)).cast("int") * across + column).alias("_cell"), "security_id", F.lit(1).alias("typ"), "portfolio_id", F.col("_i").alias("at"),
        F.coalesce("quantity_delta", F.lit(0)).cast("bigint").alias("dq"), F.coalesce(cents("cost_basis_delta"), F.lit(0)).cast("bigint").alias("dc"),
    )
    closes = with_session_idx(bars.where(F.col("close").isNotNull()).select("security_id", "trade_date", money("close").alias("_close")), cal, "trade_date", "at").where(F.col("at").isNotNull())
    listed = closes.groupBy("security_id").agg(F.collect_list(F.struct("at", cents("_close").alias("c"))).alias("marks"))
    copies = listed.select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_row")).select((F.col("_row") * across + column).alias("_cell"), "security_id", F.lit(0).alias("typ"), "marks")
    both = moves.unionByName(copies, allowMissingColumns=True).repartitionById(down * across, "_cell").sortWithinPartitions("security_id", "typ", "portfolio_id")
    kind = located.schema["portfolio_id"].dataType.simpleString()
    parts = both.drop("_cell").mapInArrow(_valued(cal.size), f"portfolio_id {kind}, _at int, mv decimal(38,0), cost decimal(38,0), unmarked bigint")
    amount = lambda name: (F.sum(name).cast("decimal(26,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(28,2)").alias(name)
    return parts.groupBy("portfolio_id", "_at").agg(amount("mv"), amount("cost"), F.sum("unmarked").alias("unmarked"))


def _valued(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the positions of one cell: rows come by security, its closes first, then by portfolio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[object, int] = {}
        sums = np.zeros((3, 16, size), np.int64)
        reached, rest, kind, known = 0, None, None, (None, np.full(size, -1, np.int64), np.zeros(size, np.int64))

        def rows(ids: list, parts: np.ndarray) -> pa.RecordBatch:
            n, at = np.nonzero((parts != 0).any(axis=0))
            mv, cost, unmarked = parts[:, n, at]
            money = lambda x: pa.array(x.tolist(), pa.decimal128(38, 0)) if x.dtype == object else pa.array(x).cast(pa.decimal128(38, 0))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(n)), pa.array(at.astype(np.int32)), money(mv), money(cost), pa.array(unmarked.astype(np.int64))], ["portfolio_id", "_at", "mv", "cost", "unmarked"])

        def whole(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sums, reached, rest, known
            batch = table.combine_chunks().to_batches()[0]
            security, typ, portfolio = _codes(batch.column("security_id")), _numbers(batch.column("typ")), _codes(batch.column("portfolio_id"))
            new = np.concatenate([[True], (np.diff(security) != 0) | (np.diff(portfolio) != 0) | (np.diff(typ) != 0)])
            begins = np.flatnonzero(new)
            stops = np.append(begins[1:], len(new))
            # The last position may go on in the next batch.
            rest = None if last else table.slice(begins[-1])
            if not last:
                begins, stops = begins[:-1], stops[:-1]
            if not len(begins):
                return
            end = stops[-1]
            # Closes of each security in the batch, carried on from session to session.
            securities, own = np.unique(security[:end], return_inverse=True)
            seen, price = np.full((len(securities), size), -1, np.int64), np.zeros((len(securities), size), np.int64)
            named = batch.column("security_id")
            carried = named[0].as_py()
            if known[0] is not None and known[0] == (carried,):
                seen[own[0]], price[own[0]] = known[1], known[2]
            for k in np.flatnonzero(typ[:end] == 0):
                marks, _ = _flat(batch.column("marks").slice(k, 1))
                at, cents = _numbers(marks.field("at")), _numbers(marks.field("c"))
                up = np.lexsort((cents, at))
                mine = np.full(size, -1, np.int64)
                mine[at[up]] = np.arange(len(up))
                mine = np.maximum.accumulate(mine)
                seen[own[k]], price[own[k]] = mine, np.where(mine >= 0, cents[up][mine], 0)
            known = ((named[end - 1].as_py(),), seen[own[end - 1]].copy(), price[own[end - 1]].copy())
            moved = typ[begins] == 1
            begins, stops = begins[moved], stops[moved]
            at, dq, dc = (_numbers(batch.column(name)) for name in ("at", "dq", "dc"))
            ids = batch.column("portfolio_id").take(pa.array(begins)).to_pylist()
            block = max(1, BLOCK_CELLS // size)
            for k in range(0, len(begins), block):
                first, stop, names = begins[k : k + block], stops[k : k + block], ids[k : k + block]
                count = stop - first
                rows_of = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                cell = np.repeat(np.arange(len(first)), count) * size + at[rows_of]
                held, cost = np.zeros(len(first) * size, np.int64), np.zeros(len(first) * size, np.int64)
                np.add.at(held, cell, dq[rows_of])
                np.add.at(cost, cell, dc[rows_of])
                held, cost = held.reshape(-1, size).cumsum(axis=1), cost.reshape(-1, size).cumsum(axis=1)
                mine = own[first]
                prices, open_ = price[mine], held != 0
                bound = max(int(np.abs(held).max()) * int(np.abs(prices).max()), int(np.abs(cost).max())) * len(first)
                if bound >= SAFE:
                    held = held.astype(object)
                worth = np.stack([held * prices, np.where(open_, cost, 0), open_ & (seen[mine] < 0)])
                for name in names:
                    if name not in slots:
                        slots[name] = len(slots)
                slot = np.array([slots[name] for name in names])
                order = np.argsort(slot, kind="stable")
                edges = np.flatnonzero(np.diff(slot[order], prepend=-1))
                added = np.add.reduceat(worth[:, order], edges, axis=1)
                to = slot[order][edges]
                if bound >= SAFE:
                    yield rows([names[order[e]] for e in edges], added)
                    continue
                if reached + bound >= SAFE:
                    yield rows(list(slots), sums[:, : len(slots)])
                    sums[:], reached = 0, 0
                if len(slots) > sums.shape[1]:
                    sums = np.concatenate([sums, np.zeros((3, len(slots), size), np.int64)], axis=1)
                sums[:, to] += added
                reached += bound
                if len(slots) * size > KEPT_CELLS:
                    yield rows(list(slots), sums[:, : len(slots)])
                    slots.clear()
                    sums, reached = np.zeros((3, 16, size), np.int64), 0

        for batch in batches:
            kind = batch.schema.field("portfolio_id").type
            table = pa.Table.from_batches([batch])
            yield from whole(table if rest is None else pa.concat_tables([rest, table]), False)
        if rest is not None:
            yield from whole(rest, True)
        if slots:
            yield rows(list(slots), sums[:, : len(slots)])

    return run


def daily_nav(entries: DataFrame, bars: DataFrame, cal: SessionCalendar, opening_cash: DataFrame, fills: DataFrame | None = None) -> DataFrame:
    """NAV per (portfolio, session) from the first entry to the last session.

    Positions change only at entries; their values are summed where changes and closes
    meet (``_holdings_value``), and no row per position and session is made. Oversold positions count with
    their negative value; ``ledger_violations`` reports them. A position without any close
    so far has no market value and counts in ``unmarked_positions``; ``unmarked_violations``
    reports it.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    located = _on_session(with_session_idx(entries, cal, "trade_date", "_i"), "_i", "trade_date")
    valued = _holdings_value(located, bars, cal)
    daily = located.groupBy("portfolio_id", F.col("_i").alias("_at")).agg(
        F.sum("cash_delta").alias("dc"), F.sum("receivable_delta").alias("dr"), F.sum("realized_pnl").alias("pnl"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("event_type") == "CA_DIVIDEND_ACCRUED", F.col("receivable_delta")).otherwise(zero)).alias("acc"),
    )
    if fills is not None:
        paid = with_session_idx(fills, cal, "execution_date", "_at").groupBy("portfolio_id", "_at").agg(F.sum("total_fee").alias("fees"))
    else:
        paid = daily.select("portfolio_id", "_at", zero.alias("fees"))
    starts = daily.groupBy("portfolio_id").agg(F.min("_at").alias("_lo"))
    grid = starts.select("portfolio_id", F.explode(F.sequence(F.col("_lo"), F.lit(cal.size - 1))).alias("_at"))
    rows = grid.join(daily, ["portfolio_id", "_at"], "left").join(valued, ["portfolio_id", "_at"], "left").join(paid, ["portfolio_id", "_at"], "left")
    so_far = Window.partitionBy("portfolio_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    cash = F.coalesce(F.sum(F.coalesce("dc", zero) + F.coalesce("dr", zero)).over(so_far), zero)
    opened = rows.withColumn("_run", cash).join(opening_cash.select("portfolio_id", F.col("cash").alias("_open")), "portfolio_id", "left")
    total = F.col("_run") + F.coalesce(F.col("_open"), zero)
    mv, cost = F.coalesce("mv", zero), F.coalesce("cost", zero)
    return opened.join(F.broadcast(cal.sessions), F.col("_at") == F.col("session_idx")).select(
        "portfolio_id",
        "trade_date",
        money(total + mv).alias("nav"),
        money(total).alias("cash"),
        money(mv).alias("holdings_market_value"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("event_count"),
        money(F.coalesce("pnl", zero)).alias("realized_pnl"),
        money(mv - cost).alias("unrealized_pnl"),
        money(F.coalesce("acc", zero)).alias("dividend_accrued"),
        money(F.coalesce("fees", zero)).alias("fees"),
        F.coalesce("unmarked", F.lit(0).cast("bigint")).alias("unmarked_positions"),
    )


def unmarked_violations(nav: DataFrame) -> DataFrame:
    """Days on which a portfolio holds securities that have had no close yet."""
    return violation(nav, F.col("unmarked_positions") > 0, "HELD_WITHOUT_CLOSE", ["portfolio_id", "trade_date"], F.col("unmarked_positions"))


def accounting_identity(nav: DataFrame, opening_cash: DataFrame) -> DataFrame:
    """Per row the deviation from ``prev nav + realized + change in unrealized + accrued``."""
    order = Window.partitionBy("portfolio_id").orderBy("trade_date")
    zero = F.lit(0).cast("decimal(18,2)")
    rows = nav.join(opening_cash.select("portfolio_id", F.col("cash").cast("decimal(18,2)").alias("_open")), "portfolio_id", "left")
    previous = F.coalesce(F.lag("nav").over(order), F.col("_open"), zero)
    before = F.coalesce(F.lag("unrealized_pnl").over(order), zero)
    expected = previous + F.col("realized_pnl") + (F.col("unrealized_pnl") - before) + F.col("dividend_accrued")
    return rows.select("portfolio_id", "trade_date", "nav", "cash", money(expected).alias("expected_nav"), F.abs(F.col("nav") - money(expected)).alias("deviation"))


def identity_violations(checked: DataFrame) -> DataFrame:
    key = ["portfolio_id", "trade_date"]
    return union_all([violation(checked, F.col("deviation") > 0, "ACCOUNTING_IDENTITY", key, F.col("deviation")), violation(checked, F.col("cash") < 0, "NEGATIVE_CASH", key, F.col("cash"))])


def run_summary(fills: DataFrame, entries: DataFrame, nav: DataFrame) -> DataFrame:
    """One row per portfolio: outcomes, categories, action events, fees and final NAV."""
    status, reason = F.col("status"), F.col("reason")
    outcomes = fills.groupBy("portfolio_id").agg(
        F.count_if(status == "FILLED").alias("filled"),
        F.count_if(status == "REJECTED").alias("rejected"),
        F.count_if(status == "SUSPENDED").alias("suspended"),
        F.count_if(status == "UNFILLED").alias("unfilled"),
        F.count_if(reason.isin("LIMIT_UP_NO_BUY", "LIMIT_DOWN_NO_SELL")).alias("limit_rejected"),
        F.count_if(reason == "CASH_INSUFFICIENT").alias("cash_insufficient"),
        F.count_if(reason.isin("CAPACITY_NO_ADV_DATA", "CAPACITY_REJECTED")).alias("capacity_rejected"),
        F.count_if(reason == "NO_OPEN_PRICE").alias("no_open_price"),
        F.count_if((F.col("lock_status") == "LOCKED") & (F.col("capacity_reason") == "CAPACITY_CAPPED")).alias("capacity_capped"),
        F.count_if((F.col("lock_status") == "LOCKED") & (F.col("original_quantity") != F.col("locked_quantity")) & (F.col("capacity_reason") != "CAPACITY_CAPPED")).alias("lot_adjusted"),
        F.sum("total_fee").cast("decimal(28,2)").alias("total_fees"),
    )
    events = entries.groupBy("portfolio_id").agg(
        F.count_if(F.col("event_type").startswith("CA_") | F.col("event_type").isin("UNSUPPORTED_CORPORATE_EVENT", "UNPROCESSED_CA")).alias("ca_events"),
        F.count_if(F.col("event_type") == "UNPROCESSED_CA").alias("unprocessed_ca"),
    )
    final = nav.groupBy("portfolio_id").agg(F.max_by("nav", "trade_date").alias("final_nav"), F.count(F.lit(1)).alias("sessions"))
    return outcomes.join(events, "portfolio_id", "full_outer").join(final, "portfolio_id", "full_outer")


# Event codes of the ledger and the action each reports.
ACTION_OF_EVENT = {
    "CA_DIVIDEND_ACCRUED": "CASH_DIVIDEND",
    "CA_DIVIDEND_PAID": "CASH_DIVIDEND_PAYMENT",
    "CA_SHARES_ADJUSTED": "STOCK_DIVIDEND",
    "UNSUPPORTED_CORPORATE_EVENT": "UNSUPPORTED",
    "UNPROCESSED_CA": "UNPROCESSED",
}


def ca_observations(entries: DataFrame) -> DataFrame:
    """Per corporate-action entry the position and cost around it."""
    kind = F.col("event_type")
    mapping = F.create_map(*[F.lit(x) for pair in ACTION_OF_EVENT.items() for x in pair])
    seen = entries.where(kind.isin(*ACTION_OF_EVENT))
    accrued = F.when(kind == "CA_DIVIDEND_ACCRUED", F.col("receivable_delta")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return seen.select(
        "portfolio_id",
        "event_type",
        mapping[kind].alias("action_type"),
        "security_id",
        "trade_date",
        (F.col("position_quantity_after") - F.col("quantity_delta")).alias("prior_position"),
        F.col("quantity_delta").alias("share_delta"),
        accrued.alias("receivable_cash_delta"),
        "cost_basis_delta",
        (F.col("cost_basis_after") - F.col("cost_basis_delta")).alias("total_cost_basis_before"),
        F.col("cost_basis_after").alias("total_cost_basis_after"),
        F.when(kind == "CA_SHARES_ADJUSTED", F.col("trade_date")).alias("sellable_date"),
        "fill_reason",
    )


def entitlement_audit(actions: DataFrame, cal: SessionCalendar, quantity: int = 1000, cost: str = "10000.00") -> DataFrame:
    """A preset position on every event: what is booked beside what each wrong reading gives."""
    # Every event is audited alone: the position is the preset one before each of them.
    rows = ledger_actions(actions, cal).where("kind = 'APPLY'")
    deductions = latest_revision(actions.where(F.col("available_at") <= clock("ex_date", 9))).select("security_id", "ex_date", "action_type", F.col("ex_right_cash_deduction_per_share").alias("deduction"))
    joined = rows.join(deductions, ["security_id", "ex_date", "action_type"], "left")
    held = F.lit(quantity).cast("decimal(16,0)")
    share_delta = F.floor(held * F.col("ratio")).cast("bigint")
    booked = money(F.col("cash") * held)
    wrong = money(F.col("deduction") * held)
    total_cost = F.lit(cost).cast("decimal(18,2)")
    after = (F.lit(quantity) + share_delta).cast("double")
    return joined.select(
        "security_id",
        "ex_date",
        "action_type",
        booked.alias("receivable_cash_delta"),
        wrong.alias("deduction_cash_delta"),
        F.coalesce(booked == wrong, F.lit(False)).alias("fields_not_distinct"),
        share_delta.alias("share_delta"),
        total_cost.alias("total_cost_basis_after"),
        (total_cost.cast("double") / after).alias("unit_cost_after"),
        (F.when(share_delta > 0, total_cost.cast("double") / after < total_cost.cast("double") / quantity)).alias("unit_cost_diluted"),
        F.when(share_delta > 0, F.col("ex_date")).alias("new_lot_sellable_from"),
    )
