"""Market rules as visible rows: which price-limit rule an order's decision could know for its session.

A rule row holds for a board and a status flag from ``effective_from`` up to ``effective_to`` (null: until
further notice) and is known from ``available_at``. For a day and an as-of the rule in force is, of the rows
known by then whose interval holds the day, the one that took effect last, then the one known last. A rule that is
announced late is not used before it was known; the older one stays in force. Rules are a table of any size: they meet
the distinct (board, flag, day, as-of) by equality on time buckets.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import require_columns, union_all, violation
from tidemark.functions.pricing import LIMIT_RULES, LimitRule
from tidemark.functions.scalars import market_close_ts
from tidemark.operators.asof import asof_max
from tidemark.operators.calendar import SessionCalendar, prev_session
from tidemark.operators.intervals import day_bucket, pieces

RULE_COLUMNS = ("rule_id", "board", "status_flag", "effective_from", "effective_to", "available_at", "daily_rate", "new_listing_policy", "first_up", "first_down")
NORMAL, FLAGGED = "NORMAL", "ST"
#: Names that put a security under risk warning.
WARNING_FLAGS = ("ST", "*ST")
#: Daily limit of main-board securities under risk warning, by effective date.
FLAGGED_MAIN_RATES = ((dt.date(2015, 1, 1), Decimal("0.05")), (dt.date(2026, 7, 6), Decimal("0.10")))
MAIN_BOARD = "主板"
BUCKET_DAYS = 366


def rule_rows(spark: SparkSession, by_board: Mapping[str, Sequence[LimitRule]] = LIMIT_RULES, lead_days: int = 30, flagged_main: Sequence[tuple[dt.date, Decimal]] = FLAGGED_MAIN_RATES) -> DataFrame:
    """The dated parameters as a rule table, known ``lead_days`` before they take effect.

    Flagged securities have their board's rules, on the main board with the rate of ``flagged_main``.
    """
    rows = []
    for board, dated in by_board.items():
        rules = sorted(dated, key=lambda r: r.effective_date)
        rates = sorted(flagged_main) if board == MAIN_BOARD else []
        starts = {NORMAL: [r.effective_date for r in rules], FLAGGED: sorted({r.effective_date for r in rules} | {day for day, _ in rates if day >= rules[0].effective_date})}
        for flag, days in starts.items():
            for day in days:
                rule = [r for r in rules if r.effective_date <= day][-1]
                own = [rate for since, rate in rates if since <= day] if flag == FLAGGED else []
                numbers = (own[-1] if own else rule.daily_rate, rule.first_day_up, rule.first_day_down)
                rows.append((f"{board}-{flag}-{day}", board, flag, day, rule.new_listing_policy, *(None if x is None else str(x) for x in numbers)))
    table = spark.createDataFrame(rows, "rule_id string, board string, status_flag string, effective_from date, new_listing_policy string, daily_rate string, first_up string, first_down string")
    rates = {n: F.col(n).cast("decimal(6,4)") for n in ("daily_rate", "first_up", "first_down")}
    return table.withColumns({**rates, "effective_to": F.lit(None).cast("date"), "available_at": market_close_ts(F.date_sub("effective_from", lead_days))}).select(*RULE_COLUMNS)


def rule_violations(rules: DataFrame) -> DataFrame:
    """Rules without key, rate or stamps, empty intervals, and equally dated rules that say different things."""
    require_columns(rules, RULE_COLUMNS, "market_rule_pit")
    key = ["board", "status_flag", "effective_from", "rule_id"]
    missing = F.lit(False)
    for name in ("rule_id", "board", "status_flag", "effective_from", "available_at", "daily_rate", "new_listing_policy"):
        missing = missing | F.col(name).isNull()
    says = F.struct("effective_to", "daily_rate", "new_listing_policy", "first_up", "first_down")
    group = ["board", "status_flag", "effective_from", "available_at"]
    equal = rules.groupBy(*group).agg(F.min(says).alias("_lo"), F.max(says).alias("_hi"), F.count("*").alias("_n"))
    return union_all(
        [
            violation(rules, missing, "RULE_FIELD_MISSING", key),
            violation(rules, F.col("daily_rate") <= 0, "RATE_NOT_POSITIVE", key, F.col("daily_rate")),
            violation(rules, F.col("effective_to") <= F.col("effective_from"), "EMPTY_RULE", key, F.col("effective_to")),
            violation(equal, ~F.col("_lo").eqNullSafe(F.col("_hi")), "CONTRADICTORY_RULES", group, F.col("_n")),
        ]
    )


def rules_asof(rows: DataFrame, rules: DataFrame, day: str, asof: str, out: str = "rule", bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``rows`` (with board and status_flag) with the struct of the rule in force on ``day`` as known at ``asof``, null where there is none."""
    require_columns(rules, RULE_COLUMNS, "market_rule_pit")
    key = ["board", "status_flag", "_day", "_asof"]
    stamped = rows.withColumns({"_day": F.col(day), "_asof": F.col(asof)})
    asks = stamped.select(*key).where(" and ".join(f"{k} is not null" for k in key)).distinct()
    last = asks.agg(F.max("_day")).first()[0]
    stop = F.date_add(F.lit(last).cast("date"), 1)
    held = pieces(rules, F.col("effective_from"), F.least(F.coalesce("effective_to", stop), stop), bucket_days)
    met = asks.withColumn("_bucket", day_bucket(F.col("_day"), bucket_days)).join(held, ["board", "status_flag", "_bucket"])
    usable = met.where((F.col("_lo") <= F.col("_day")) & (F.col("_day") < F.col("_stop")) & (F.col("available_at") <= F.col("_asof")))
    best = usable.groupBy(*key).agg(F.max(F.struct("effective_from", "available_at", "rule_id", "daily_rate", F.col("new_listing_policy").alias("policy"), "first_up", "first_down")).alias(out))
    return stamped.join(best, key, "left").drop("_day", "_asof")


def status_by_session(events: DataFrame, cal: SessionCalendar) -> DataFrame:
    """(security_id, decision_date, status_flag) of every session, for securities with any status event.

    ``events``: security_id, effective_date, flag, available_at. A decision at a session's close looks at the next
    session, so an event counts for it once its effective date is no later than that session and it is known: from the
    later of its own stamp and the close before its effective date. Of those the one that took effect last holds, then the one known last.
    """
    before = prev_session(events, cal, "effective_date", out="_before")
    usable = before.withColumn("usable_from", F.greatest("available_at", market_close_ts("_before")))
    grid = events.select("security_id").distinct().select("security_id", F.explode(F.lit(list(cal.dates))).alias("decision_date")).withColumn("_close", market_close_ts("decision_date"))
    found = asof_max(grid, usable, ["security_id"], "_close", "usable_from", ["effective_date", "available_at", "flag"], [], bucket="year", out="_f")
    return found.select("security_id", "decision_date", F.when(F.col("_f.flag").isin(*WARNING_FLAGS), FLAGGED).otherwise(NORMAL).alias("status_flag"))


def with_status(orders: DataFrame, states: DataFrame, day: str = "decision_date") -> DataFrame:
    """Orders with the status flag known at their decision; a security without events is normal.

    States are a row per security and session that take few bytes on disk and many as a map: merged, never sent through the driver.
    """
    renamed = states.withColumnRenamed("decision_date", day) if day != "decision_date" else states
    return orders.join(renamed.hint("merge"), ["security_id", day], "left").withColumn("status_flag", F.coalesce("status_flag", F.lit(NORMAL)))
