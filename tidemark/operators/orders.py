"""Order locking and T+1 open fills as joins over an intents table.

Intents are ``(portfolio_id, decision_date, security_id, side, quantity, intent_seq)``,
keyed by the first four. Market state is computed once per (security, session) and
joined to orders by equality, so a heavily traded security costs a skewed hash join
(split by AQE), never a window over its orders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import STATUS_SUSPENDED, ContractViolation, enforce, union_all, violation
from tidemark.functions.pricing import FeeSchedule, LimitRules, reference_terms
from tidemark.functions.scalars import limit_prices, market_close_ts, money
from tidemark.operators.actions import pricing_inputs
from tidemark.operators.asof import running_sum
from tidemark.operators.calendar import SessionCalendar, listing_session_number, next_session
from tidemark.operators.pit import latest_revision
from tidemark.operators.returns import late_bar_violations
from tidemark.operators.rules import NORMAL, rules_asof
from tidemark.staging import dealt, stage

PRICE_TOLERANCE = 1e-9
CLOSE_LOOKBACK = 60
ADV_SESSIONS = 20


@dataclass(frozen=True)
class ExecutionRules:
    fees: FeeSchedule = field(default_factory=FeeSchedule)
    limits: LimitRules | DataFrame = field(default_factory=LimitRules)
    lot: int = 100
    lot_policy: str = "ROUND_DOWN"
    opening_fraction: Decimal | Column = Decimal("0.05")
    adv_sessions: int = ADV_SESSIONS
    close_lookback: int = CLOSE_LOOKBACK
    strict_pit: bool = True

    def __post_init__(self) -> None:
        if not isinstance(self.opening_fraction, Column) and self.opening_fraction <= 0:
            raise ContractViolation("opening liquidity fraction must be positive")
        if self.adv_sessions <= 0:
            raise ContractViolation("trailing window must be positive")
        if self.lot_policy not in ("ROUND_DOWN", "REJECT"):
            raise ContractViolation(f"unknown lot policy: {self.lot_policy}")


def decision_keys(orders: DataFrame) -> DataFrame:
    """The distinct (security, decision date) of orders, nulls included: what market terms depend on."""
    return orders.select("security_id", "decision_date").distinct()


def with_decision_terms(orders: DataFrame, terms: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Orders with the columns that ``terms`` hold for their (security, decision date, ``also``); null keys meet null keys."""
    key = ["security_id", "decision_date", *also]
    same = F.lit(True)
    for name in key:
        same = same & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    return orders.join(terms.withColumnsRenamed({name: f"_of_{name}" for name in key}), same, "left").drop(*[f"_of_{name}" for name in key])


def lot_quantity(orders: DataFrame, policy: str = "ROUND_DOWN", lot: int = 100) -> DataFrame:
    """Buys in whole lots; a buy left with nothing is null with ODD_LOT_REJECTED."""
    quantity = F.col("quantity").cast("bigint")
    odd = quantity % lot
    floored = quantity - odd
    usable = F.when(odd == 0, quantity)
    if policy == "ROUND_DOWN":
        usable = usable.when(floored > 0, floored)
    value = F.when(F.col("side") != "buy", quantity).otherwise(usable)
    return orders.withColumn("lot_quantity", value).withColumn("lot_reason", F.when(value.isNull(), F.lit("ODD_LOT_REJECTED")))


def market_state(bars: DataFrame, keys: DataFrame, cal: SessionCalendar, close_lookback: int = CLOSE_LOOKBACK, adv_sessions: int = ADV_SESSIONS) -> DataFrame:
    """Last close and trailing mean amount per wanted (security, decision date).

    Both look back over calendar sessions at or before the date. ``keys`` holds
    ``security_id, decision_date``; frames run per security along the calendar.
    """
    wanted = cal.positions(keys.select("security_id", "decision_date").distinct(), "decision_date").drop("_member")
    traded = bars.join(F.broadcast(cal.sessions), "trade_date").select("security_id", F.col("session_idx").alias("_floor"), "close", "amount", F.lit(None).cast("date").alias("decision_date"))
    nothing = F.lit(None)
    asked = wanted.select("security_id", "_floor", nothing.cast(bars.schema["close"].dataType).alias("close"), nothing.cast(bars.schema["amount"].dataType).alias("amount"), "decision_date")
    rows = traded.unionByName(asked)
    by_security = Window.partitionBy("security_id").orderBy("_floor")
    recent = by_security.rangeBetween(-(close_lookback - 1), 0)
    trailing = by_security.rangeBetween(-(adv_sessions - 1), 0)
    counted = F.when(F.col("amount") >= 0, F.col("amount"))
    stated = rows.withColumns(
        {
            "last_close": F.max(F.when(F.col("close").isNotNull(), F.struct("_floor", "close"))).over(recent)["close"],
            "_sum": F.sum(counted).over(trailing),
            "_n": F.count(counted).over(trailing),
        }
    )
    adv = F.when(F.col("_n") > 0, money((F.col("_sum").cast("decimal(24,4)") / F.col("_n").cast("decimal(6,0)"))))
    return stated.where(F.col("decision_date").isNotNull()).select("security_id", "decision_date", "last_close", adv.alias("trailing_adv_notional"), F.col("_n").alias("adv_days"))


def last_close_asof(keys: DataFrame, bars: DataFrame, cal: SessionCalendar, max_sessions: int = CLOSE_LOOKBACK) -> DataFrame:
    """Keys with the last non-null close of the trailing sessions, in cents."""
    state = market_state(bars, keys, cal, max_sessions).select("security_id", "decision_date", money("last_close").alias("last_close"))
    return keys.join(state, ["security_id", "decision_date"], "left")


def capacity(orders: DataFrame, bars: DataFrame, cal: SessionCalendar, n: int = ADV_SESSIONS, fraction: Decimal = Decimal("0.05")) -> DataFrame:
    """Trailing mean amount, order cap and window status per order."""
    state = market_state(bars, orders, cal, adv_sessions=n).select("security_id", "decision_date", "trailing_adv_notional", "adv_days")
    return _with_cap(orders.join(state, ["security_id", "decision_date"], "left"), n, fraction)


def _with_cap(rows: DataFrame, n: int, fraction: Decimal | Column) -> DataFrame:
    status = F.when(F.col("trailing_adv_notional").isNull(), F.lit(None)).when(F.col("adv_days") >= n, F.lit("ADV_FULL_WINDOW")).otherwise(F.lit("ADV_PARTIAL_WINDOW"))
    cap = money(F.col("trailing_adv_notional") * F.lit(fraction).cast("decimal(8,6)"))
    return rows.withColumn("max_order_notional", cap).withColumn("adv_window_status", status).drop("adv_days")


EXECUTION = ("open_price", "trade_status", "has_bar")


def execution_bar(orders: DataFrame, bars: DataFrame, day: str = "next_session") -> DataFrame:
    """Open and status of the execution session; ``has_bar`` tells an absent row from a null open."""
    state = bars.select("security_id", F.col("trade_date").alias(day), F.col("open").alias("open_price"), "trade_status", F.lit(True).alias("has_bar"))
    return orders.join(state, ["security_id", day], "left").withColumn("has_bar", F.coalesce("has_bar", F.lit(False)))


def board_asof(orders: DataFrame, master: DataFrame, day: str = "decision_date") -> DataFrame:
    """Board and listing date visible at the close of a day; null when either is unknown."""
    view = master.select("security_id", "board", "list_date", F.col("available_at").alias("_known")).where(F.col("board").isNotNull() & F.col("list_date").isNotNull())
    joined = orders.join(view, "security_id", "left")
    seen = F.col("_known") <= market_close_ts(day)
    return joined.withColumns({"board": F.when(seen, F.col("board")), "list_date": F.when(seen, F.col("list_date"))}).drop("_known")


def limit_reference(orders: DataFrame, actions: DataFrame) -> DataFrame:
    """Ex-right adjusted reference for orders with ``next_session`` and ``last_close``.

    Pricing inputs are built per distinct (security, decision, next session) that meets
    an action, as visible at the decision's close. Orders that meet a rights issue without
    usable terms have no reference and carry the reason in ``reference_violation``: they are
    rejected when locked, and ``reference_violations`` lists them.
    """
    dated = orders.select("security_id", "decision_date", F.col("next_session").alias("ex_date")).where(F.col("ex_date").isNotNull()).distinct()
    # Merged, as all actions are small on disk and large as a map.
    met = dated.join(actions.hint("merge"), ["security_id", "ex_date"])
    key = ("security_id", "ex_date", "decision_date")
    known = met.where(F.col("available_at") <= market_close_ts("decision_date"))
    inputs = pricing_inputs(latest_revision(known, (*key, "action_type")), "deduction", key)
    later = met.where(F.col("available_at") <= market_close_ts("ex_date")).select(*key).distinct().withColumn("_later", F.lit(True))
    joined = (
        orders.withColumnRenamed("next_session", "ex_date")
        .join(inputs, list(key), "left")
        .join(later, list(key), "left")
        .withColumnRenamed("ex_date", "next_session")
    )
    previous = money("last_close")
    zero = F.lit(0).cast("decimal(18,6)")
    seen = F.col("action_types").isNotNull() & F.col("last_close").isNotNull()
    broken = seen & F.col("input_reason").isNotNull()
    usable = seen & ~broken
    terms = reference_terms(F.when(usable, F.col("next_session")), previous, F.coalesce("cash", zero), F.coalesce("split_ratio", zero), F.coalesce("rights_ratio", zero), F.coalesce("rights_consideration", zero.cast("decimal(24,12)")))
    adjusted = F.when(usable, money(terms.price))
    status = (
        F.when(broken, "LIMIT_REF_INPUT_VIOLATION")
        .when(seen & (adjusted != previous), "LIMIT_REF_ADJUSTED_FOR_CA")
        .when(~seen & F.col("_later").isNotNull() & F.col("last_close").isNotNull(), "LIMIT_REF_UNADJUSTED_CA_INVISIBLE")
        .otherwise("NONE")
    )
    drop = ("cash", "split_ratio", "rights_ratio", "rights_consideration", "rights_price", "action_types", "input_reason", "_later")
    reference = F.when(~broken, F.coalesce(adjusted, previous))
    return joined.withColumns({"reference_price": reference, "limit_reference_status": status, "reference_violation": F.when(broken, F.col("input_reason"))}).drop(*drop)


def reference_violations(orders: DataFrame) -> DataFrame:
    """Orders of ``limit_reference`` (or locked ones) whose reference price cannot be formed, with the reason."""
    return violation(orders, F.col("reference_violation").isNotNull(), "LIMIT_REFERENCE_INPUT", ["portfolio_id", "decision_date", "security_id", "side"], F.col("reference_violation"))


def price_limits(orders: DataFrame, master: DataFrame, cal: SessionCalendar, rules: LimitRules | DataFrame = LimitRules(), master_day: str = "decision_date") -> DataFrame:
    """Limit-up and limit-down prices of the next session under the board's dated rule.

    ``rules`` are dated parameters, or a table of rule rows of which each decision uses those known at its close; orders
    may then carry a ``status_flag``. A new listing that its rule exempts has no limit, flagged or not.
    """
    named = board_asof(orders, master, master_day)
    numbered = listing_session_number(named, cal, "list_date", "next_session", "_nth")
    if isinstance(rules, LimitRules):
        numbered = numbered.withColumn("_rule", rules.resolve("board", "next_session"))
    else:
        flagged = numbered if "status_flag" in orders.columns else numbered.withColumn("status_flag", F.lit(NORMAL))
        numbered = rules_asof(flagged.withColumn("_known", market_close_ts("decision_date")), rules, "next_session", "_known", "_rule").drop("_known", *([] if "status_flag" in orders.columns else ["status_flag"]))
    nth, policy = F.col("_nth"), F.col("_rule.policy")
    exempt = ((policy == "FIRST_FIVE_NO_LIMIT") & (nth <= 5)) | ((policy == "FIRST_DAY_NO_LIMIT") & (nth == 1))
    asymmetric = (policy == "FIRST_DAY_ASYMMETRIC") & (nth == 1) & F.col("_rule.first_up").isNotNull() & F.col("_rule.first_down").isNotNull()
    daily_up, daily_down = limit_prices("reference_price", F.col("_rule.daily_rate"))
    first_up, first_down = limit_prices("reference_price", F.col("_rule.first_up"), F.col("_rule.first_down"))
    broken = F.col("reference_violation").isNotNull() if "reference_violation" in orders.columns else F.lit(False)
    check = (
        F.when(broken, "SKIPPED_CA_INPUT")
        .when(F.col("reference_price").isNull(), "SKIPPED_NO_PREV_CLOSE")
        .when(F.col("board").isNull() | F.col("list_date").isNull(), "SKIPPED_NO_MASTER")
        .when(F.col("_rule").isNull(), "SKIPPED_NO_RULE")
        .when(F.coalesce(exempt, F.lit(False)), "EXEMPT_NEW_LISTING")
        .otherwise("APPLIED")
    )
    use_first = F.coalesce(asymmetric, F.lit(False))
    checked = numbered.withColumn("limit_check", check)
    applied = F.col("limit_check") == "APPLIED"
    return checked.withColumns(
        {
            "price_cap": F.when(applied, F.when(use_first, first_up).otherwise(daily_up)),
            "price_floor": F.when(applied, F.when(use_first, first_down).otherwise(daily_down)),
        }
    ).drop("_nth", "_rule", "board", "list_date")


def lock_orders(
    intents: DataFrame,
    bars: DataFrame,
    actions: DataFrame,
    master: DataFrame,
    cal: SessionCalendar,
    rules: ExecutionRules = ExecutionRules(),
    end_date: object | None = None,
    check: bool = True,
    execution: bool = False,
) -> DataFrame:
    """Locked orders, or rejections with one reason by the fixed order of checks.

    With ``execution`` they also carry the bar they will meet, looked up once per security and decision date;
    nothing here reads it, and ``fill_orders`` uses it instead of meeting every order with the bars.
    """
    if check:
        enforce(late_bar_violations(bars))
    # Prices, limits and trailing amounts depend on the security and the decision date: once per pair, not per order.
    flagged = ["status_flag"] if "status_flag" in intents.columns and not isinstance(rules.limits, LimitRules) else []
    keys = intents.select("security_id", "decision_date", *flagged).distinct()
    keys = next_session(stage(keys, "decision-keys"), cal, "decision_date")
    if end_date is not None:
        keys = keys.withColumn("next_session", F.when(F.col("next_session") <= F.lit(str(end_date)).cast("date"), F.col("next_session")))
    state = market_state(bars, keys, cal, rules.close_lookback, rules.adv_sessions)
    terms = limit_reference(keys.join(state, ["security_id", "decision_date"], "left"), actions)
    terms = price_limits(terms, master, cal, rules.limits, "decision_date" if rules.strict_pit else "next_session")
    terms = stage(execution_bar(terms, bars) if execution else terms, "decision-terms")
    rows = with_decision_terms(lot_quantity(intents, rules.lot_policy, rules.lot), terms, flagged)
    rows = _with_cap(rows, rules.adv_sessions, rules.opening_fraction)
    reference, wanted, cap = F.col("reference_price"), F.col("lot_quantity"), F.col("max_order_notional")
    evaluated = (wanted > 0) & reference.isNotNull()
    over = evaluated & (money(reference * wanted.cast("decimal(16,0)")) > cap)
    shares = F.expr("cast(max_order_notional div reference_price as bigint)")
    capped = F.when(over, shares - shares % rules.lot)
    reason = (
        F.when(F.col("next_session").isNull(), "NO_NEXT_SESSION")
        .when(F.col("lot_reason").isNotNull(), F.col("lot_reason"))
        .when(F.col("reference_violation").isNotNull(), "CA_INPUT_VIOLATION")
        .when(evaluated & cap.isNull(), "CAPACITY_NO_ADV_DATA")
        .when(F.col("_capped") <= 0, "CAPACITY_REJECTED")
    )
    rows = rows.withColumn("_capped", capped).withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    rows = rows.withColumn("locked_quantity", F.when(ok, F.least(wanted, F.coalesce(F.col("_capped"), wanted))).otherwise(F.lit(0).cast("bigint")))
    price = F.coalesce("price_cap", "reference_price")
    reserve_fees = rules.fees.breakdown(F.lit("buy"), F.col("next_session"), F.when(ok & (F.col("side") == "buy") & (F.col("locked_quantity") > 0), price), F.col("locked_quantity"))
    zero = F.lit(0).cast("decimal(18,2)")
    return rows.withColumns(
        {
            "reserved_cash": F.coalesce(reserve_fees["net_amount"], zero),
            "capacity_reason": F.when(ok & F.col("_capped").isNotNull(), "CAPACITY_CAPPED").otherwise("NONE"),
            "adv_window_status": F.when(evaluated & (ok | (F.col("reject_reason") == "CAPACITY_REJECTED")), F.coalesce("adv_window_status", F.lit("NOT_EVALUATED"))).otherwise("NOT_EVALUATED"),
            "original_quantity": F.col("quantity").cast("bigint"),
            "reference_price": F.when(ok, reference),
            "price_cap": F.when(ok, F.col("price_cap")),
            "price_floor": F.when(ok, F.col("price_floor")),
            "limit_check": F.when(ok, F.col("limit_check")).otherwise("NOT_EVALUATED"),
            "limit_reference_status": F.when(ok, F.col("limit_reference_status")).otherwise("NONE"),
            "trailing_adv_notional": F.when(ok & evaluated, F.col("trailing_adv_notional")),
            "max_order_notional": F.when(ok & evaluated, cap),
            "lock_status": F.when(F.col("reject_reason") == "NO_NEXT_SESSION", "UNFILLED").when(~ok, "REJECTED").otherwise("LOCKED"),
        }
    ).drop("_capped", "lot_reason", "lot_quantity", "last_close")


# -- cash admission -----------------------------------------------------------------------


def admit_by_cash(locked: DataFrame, cash: DataFrame, seq: str = "intent_seq", rounds: int = 2) -> DataFrame:
    """Reserve cash per (portfolio, decision date) in intent order.

    An order whose reserve exceeds the remaining cash is rejected and takes nothing.
    Exact, in three steps: days whose reserves fit are accepted whole; in the others
    each round rejects what can no longer fit and accepts the longest fitting prefix,
    using bucketed running sums; the few orders then left are walked in order by a
    stream over sorted partitions that carries only the remaining cash.
    """
    day = ["portfolio_id", "decision_date"]
    asking = locked.where((F.col("side") == "buy") & (F.col("lock_status") == "LOCKED"))
    cents = (F.col("reserved_cash") * 100).cast("bigint")
    slim = asking.select(*day, F.col(seq).alias("_seq"), "security_id", cents.alias("_r"))
    opening = cash.select(*day, (F.col("available_cash") * 100).cast("bigint").alias("_left"))
    open_rows = slim.join(opening, day).where(F.col("_r") > 0)
    decided = []
    for number in range(rounds):
        if number:
            # Each round refers to its input several times: staged, so the plan stays one round long.
            open_rows = stage(open_rows, "cash-round")
        fitting = open_rows.where(F.col("_r") <= F.col("_left")).withColumn("_chunk", F.floor(F.col("_seq") / 4096))
        summed = stage(running_sum(fitting, day, ["_chunk"], ["_seq", "security_id"], "_r", "_run").drop("_chunk"), "cash-round")
        inside = F.col("_run") <= F.col("_left")
        edge = summed.groupBy(*day).agg(F.max(F.when(inside, F.col("_run"))).alias("_spent"), F.min(F.when(~inside, F.struct("_seq", "security_id"))).alias("_stop"))
        placed = summed.join(edge, day)
        decided.append(placed.where(inside).select(*day, "security_id", "_seq"))
        beyond = ~inside & ~((F.col("_stop._seq") == F.col("_seq")) & (F.col("_stop.security_id") == F.col("security_id")))
        open_rows = placed.where(beyond).select(*day, "_seq", "security_id", "_r", (F.col("_left") - F.coalesce("_spent", F.lit(0))).alias("_left"))
    open_rows = stage(open_rows, "cash-round") if rounds else open_rows
    rest = open_rows.where(F.col("_r") <= F.col("_left"))
    decided.append(_walk_cash(rest, day))
    accepted = union_all(decided).select(*day, "security_id", F.col("_seq").alias(seq), F.lit(True).alias("_ok")).where(F.col("security_id").isNotNull() & F.col(seq).isNotNull())
    # Orders meet their decisions in one shuffle by day, in which fill_orders numbers them too.
    both = locked.withColumn("_ok", F.lit(None).cast("boolean")).unionByName(accepted, allowMissingColumns=True)
    order = Window.partitionBy(*day, seq, "security_id")
    joined = dealt(both.withColumn("_is_order", F.col("_ok").isNull()), *day).withColumn("_ok", F.max("_ok").over(order)).where("_is_order").drop("_is_order")
    needs = (F.col("side") == "buy") & (F.col("lock_status") == "LOCKED") & (F.col("reserved_cash") > 0)
    refused = needs & F.col("_ok").isNull()
    return joined.withColumns(
        {
            "lock_status": F.when(refused, "REJECTED").otherwise(F.col("lock_status")),
            "reject_reason": F.when(refused, "CASH_INSUFFICIENT").otherwise(F.col("reject_reason")),
            "locked_quantity": F.when(refused, F.lit(0).cast("bigint")).otherwise(F.col("locked_quantity")),
            "reserved_cash": F.when(refused, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("reserved_cash")),
        }
    ).drop("_ok")


def accept_in_order(reserves: np.ndarray, left: int, keep: np.ndarray) -> int:
    """Mark in ``keep`` what greedy admission accepts and return the cash left: one step per rejection, not per order."""
    at = np.flatnonzero(reserves <= left)
    while len(at):
        spent = np.cumsum(reserves[at])
        fit = int(np.searchsorted(spent, left, side="right"))
        keep[at[:fit]] = True
        left -= int(spent[fit - 1]) if fit else 0
        at = at[fit + 1 :]
        at = at[reserves[at] <= left]
    return left


def _walk_cash(rows: DataFrame, day: list[str]) -> DataFrame:
    sorted_rows = rows.repartition(*day).sortWithinPartitions(*day, "_seq", "security_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left = None, 0
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            reserves = batch["_r"].to_numpy()
            # Runs of one portfolio-day; the batch is sorted.
            new_day = (batch[day] != batch[day].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new_day) if len(batch) else []
            for start, stop in zip(starts, [*starts[1:], len(batch)], strict=True):
                here = tuple(batch[day].iloc[start])
                if here != current:
                    current, left = here, int(batch["_left"].iloc[start])
                left = accept_in_order(reserves[start:stop], left, keep[start:stop])
            yield batch.loc[keep, ["portfolio_id", "decision_date", "security_id", "_seq"]]

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{name} {types[name]}" for name in ("portfolio_id", "decision_date", "security_id", "_seq"))
    return sorted_rows.mapInPandas(walk, schema)


# -- fills -----------------------------------------------------------------------------------


def fill_orders(locked: DataFrame, bars: DataFrame, fees: FeeSchedule = FeeSchedule(), seq: str = "intent_seq", slippage: Column | None = None) -> DataFrame:
    """T+1 open outcomes with fees; sells come before buys in a portfolio's round.

    ``slippage`` is a share of the open that buys pay more and sells get less; limits are judged at the open itself.
    """
    rows = locked if all(name in locked.columns for name in EXECUTION) else execution_bar(locked, bars)
    open_price = F.col("open_price")
    applied = F.col("limit_check") == "APPLIED"
    up = applied & (F.col("side") == "buy") & (open_price.cast("double") >= F.col("price_cap").cast("double") - PRICE_TOLERANCE)
    down = applied & (F.col("side") == "sell") & (open_price.cast("double") <= F.col("price_floor").cast("double") + PRICE_TOLERANCE)
    reason = (
        F.when(F.col("lock_status") != "LOCKED", F.col("reject_reason"))
        .when(~F.col("has_bar"), "NO_OPEN_PRICE")
        .when(F.col("trade_status") == STATUS_SUSPENDED, "NO_TRADE_SUSPENDED")
        .when(open_price.isNull(), "NO_OPEN_PRICE")
        .when(F.coalesce(up, F.lit(False)), "LIMIT_UP_NO_BUY")
        .when(F.coalesce(down, F.lit(False)), "LIMIT_DOWN_NO_SELL")
        .otherwise("T1_OPEN_FILLED")
    )
    status = (
        F.when(F.col("lock_status") != "LOCKED", F.col("lock_status"))
        .when(F.col("reason") == "NO_OPEN_PRICE", "UNFILLED")
        .when(F.col("reason") == "NO_TRADE_SUSPENDED", "SUSPENDED")
        .when(F.col("reason") == "T1_OPEN_FILLED", "FILLED")
        .otherwise("REJECTED")
    )
    judged = rows.withColumn("reason", reason).withColumn("status", status)
    filled = F.col("status") == "FILLED"
    paid = open_price
    if slippage is not None:
        share = F.when(F.col("side") == "buy", slippage).otherwise(-slippage).cast("decimal(8,6)")
        paid = F.round(open_price.cast("decimal(14,6)") * (F.lit(1).cast("decimal(8,6)") + share), 6).cast("decimal(14,6)")
    priced = fees.breakdown(F.col("side"), F.col("next_session"), F.when(filled, paid), F.when(filled, F.col("locked_quantity")))
    zero = F.lit(0).cast("decimal(18,2)")
    limit_hit = F.col("reason").isin("LIMIT_UP_NO_BUY", "LIMIT_DOWN_NO_SELL")
    order = Window.partitionBy("portfolio_id", "decision_date").orderBy(F.col("side").desc(), F.col(seq))
    return judged.withColumns(
        {
            "execution_date": F.when(F.col("lock_status") == "LOCKED", F.col("next_session")),
            "execution_price": F.when(filled, paid).when(limit_hit, open_price),
            "filled_quantity": F.when(filled, F.col("locked_quantity")).otherwise(F.lit(0).cast("bigint")),
            "limit_check": F.when(filled | limit_hit, F.col("limit_check")).otherwise("NOT_EVALUATED"),
            "round_seq": F.row_number().over(order),
            **{name: F.coalesce(value, zero) for name, value in priced.items()},
        }
    ).drop(*EXECUTION)


def fees(df: DataFrame, schedule: FeeSchedule = FeeSchedule(), side: str = "side", day: str = "execution_date", price: str = "price", quantity: str = "quantity") -> DataFrame:
    return df.withColumns(schedule.breakdown(F.col(side), F.col(day), F.col(price), F.col(quantity)))


def sell_lock_violations(sells: DataFrame, positions: DataFrame, lot: int = 100) -> DataFrame:
    """Sells above the sellable quantity, or odd lots that do not sell everything."""
    joined = sells.join(positions.select("portfolio_id", "security_id", F.col("sellable_quantity").alias("_s")), ["portfolio_id", "security_id"], "left")
    sellable = F.coalesce(F.col("_s"), F.lit(0))
    key = ["portfolio_id", "decision_date", "security_id"]
    return union_all(
        [
            violation(joined, F.col("quantity") > sellable, "SELL_EXCEEDS_SELLABLE", key, F.col("quantity")),
            violation(joined, (F.col("quantity") <= sellable) & (F.col("quantity") % lot != 0) & (F.col("quantity") != sellable), "ODD_LOT_SELL", key, F.col("quantity")),
        ]
    )


# -- targets ----------------------------------------------------------------------------------


def equal_weight_targets(points: DataFrame, top_n: int, cap: Decimal) -> DataFrame:
    """Top n ranked points per signal date at weight min(1/k, cap)."""
    if top_n <= 0:
        raise ContractViolation("top_n must be positive")
    eligible = points.where((F.col("status") == "OK") & F.col("cross_sectional_rank").isNotNull())
    order = Window.partitionBy("signal_date").orderBy("cross_sectional_rank", "security_id")
    chosen = eligible.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top_n)
    # Top n rows per date remain, so counting them is a small window.
    size = F.count(F.lit(1)).over(Window.partitionBy("signal_date"))
    one = F.lit(1).cast("decimal(10,0)")
    weight = F.least((one / size.cast("decimal(10,0)")).cast("decimal(28,20)"), F.lit(cap).cast("decimal(28,20)"))
    return chosen.withColumn("weight", weight).drop("_n")


def holdings_vs_targets(positions: DataFrame, targets: DataFrame, by: tuple[str, ...] = ("portfolio_id", "decision_date")) -> DataFrame:
    """Union of held and targeted ids per portfolio and date, zero-filled."""
    joined = positions.join(targets, [*by, "security_id"], "full_outer")
    return joined.withColumns(
        {
            "total_quantity": F.coalesce("total_quantity", F.lit(0).cast("bigint")),
            "sellable_quantity": F.coalesce("sellable_quantity", F.lit(0).cast("bigint")),
            "weight": F.coalesce("weight", F.lit(0).cast("decimal(28,20)")),
        }
    )


def orders_to_targets(
    book: DataFrame,
    nav: DataFrame,
    buffer: Decimal = Decimal("0.02"),
    lot: int = 100,
    signal_hash: str | None = None,
) -> DataFrame:
    """Sells then buys towards target quantities.

    ``book`` is ``holdings_vs_targets`` with a ``price`` column (null = no visible close);
    ``nav`` holds ``portfolio_id, decision_date, nav``. A held id without a price fails.
    """
    day = ["portfolio_id", "decision_date"]
    rows = book.join(nav.select(*day, "nav"), day)
    held_blind = (F.col("total_quantity") > 0) & F.col("price").isNull()
    weight = F.when(held_blind, F.raise_error(F.concat(F.lit("missing visible close for held security "), F.col("security_id")))).otherwise(F.col("weight"))
    invest = (F.col("nav").cast("decimal(18,2)") * (F.lit(1).cast("decimal(6,4)") - F.lit(buffer).cast("decimal(6,4)"))).cast("decimal(22,6)")
    value = (invest * weight.cast("decimal(14,12)")).cast("decimal(26,10)")
    raw = F.floor(value.cast("decimal(24,8)") / F.col("price").cast("decimal(14,6)")).cast("bigint")
    target = F.when(F.coalesce(F.col("price") > 0, F.lit(False)) & (F.col("weight") > 0), raw - raw % lot).otherwise(F.lit(0).cast("bigint"))
    sized = rows.withColumn("target_quantity", target)
    excess = F.least(F.col("total_quantity") - F.col("target_quantity"), F.col("sellable_quantity"))
    sell = F.when(F.col("target_quantity") > 0, excess - excess % lot).otherwise(excess)
    gap = F.col("target_quantity") - F.col("total_quantity")
    both = F.array(
        F.struct(F.lit("sell").alias("side"), F.when(F.col("total_quantity") > F.col("target_quantity"), sell).otherwise(F.lit(0).cast("bigint")).alias("quantity"), F.lit("momentum_signal_sell_to_target").alias("reason")),
        F.struct(F.lit("buy").alias("side"), F.when(gap > 0, gap - gap % lot).otherwise(F.lit(0).cast("bigint")).alias("quantity"), F.lit("momentum_signal_buy_to_target").alias("reason")),
    )
    carried = ["signal_manifest_hash"] if "signal_manifest_hash" in book.columns else []
    intents = sized.select(*day, "security_id", F.col("weight").alias("target_weight"), *carried, F.inline(both)).where(F.col("quantity") > 0)
    if signal_hash is not None and not carried:
        intents = intents.withColumn("signal_manifest_hash", F.lit(signal_hash))
    order = Window.partitionBy(*day).orderBy(F.col("side").desc(), "security_id")
    return intents.withColumn("intent_seq", F.row_number().over(order))


def fixed_universe_orders(tradable: DataFrame, positions: DataFrame | None, k: int, quantity: int, lot: int = 100) -> DataFrame:
    """First k tradable ids per date are targets: sell other sellable holdings, buy missing ones.

    ``positions`` is ``(portfolio_id, trade_date, security_id, total_quantity, sellable_quantity)``;
    None is the buy-only variant for one portfolio 0.
    """
    if k <= 0 or quantity <= 0 or quantity % lot:
        raise ContractViolation("target count must be positive and quantity a lot multiple")
    order = Window.partitionBy("trade_date").orderBy("security_id")
    targets = tradable.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("trade_date", "security_id")
    if positions is None:
        return targets.select(
            F.lit(0).cast("bigint").alias("portfolio_id"), F.col("trade_date").alias("decision_date"), "security_id",
            F.lit("buy").alias("side"), F.lit(quantity).cast("bigint").alias("quantity"), F.lit("fixed_id_order_dummy_strategy").alias("reason"),
        )
    held = positions.where(F.col("total_quantity") > 0)
    sells = held.where(F.col("sellable_quantity") > 0).join(targets, ["trade_date", "security_id"], "left_anti").select(
        "portfolio_id", F.col("trade_date").alias("decision_date"), "security_id", F.lit("sell").alias("side"), F.col("sellable_quantity").cast("bigint").alias("quantity"), F.lit("fixed_id_order_dummy_rebalance_sell").alias("reason"),
    )
    # A portfolio's k targets per date are the answer's own size.
    wanted = positions.select("portfolio_id", "trade_date").distinct().join(targets, "trade_date")
    buys = wanted.join(held, ["portfolio_id", "trade_date", "security_id"], "left_anti").select(
        "portfolio_id", F.col("trade_date").alias("decision_date"), "security_id", F.lit("buy").alias("side"), F.lit(quantity).cast("bigint").alias("quantity"), F.lit("fixed_id_order_dummy_rebalance_buy").alias("reason"),
    )
    return sells.unionByName(buys)


