"""Dated rules and the ex-right reference price."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.contracts import ContractViolation
from tidemark.functions.scalars import col, money

MAX_RULES = 1000

# Effective dates of the exchanges' ex-right pricing rules.
REFERENCE_PRICE_RULES = (
    (dt.date(2011, 2, 28), "cn_a_share_ex_right_reference_price_2011"),
    (dt.date(2013, 7, 29), "cn_a_share_ex_right_reference_price_2013"),
    (dt.date(2023, 2, 17), "cn_a_share_ex_right_reference_price_2023"),
    (dt.date(2026, 7, 6), "cn_a_share_ex_right_reference_price_2026"),
)


def effective_rule(day: Column | str, rules: Sequence[tuple[dt.date, object]]) -> Column:
    """Value of the latest rule with ``effective_date <= day``, null before the first.

    Rules are a handful of dated parameters, so they become one CASE expression
    inside the scan's codegen stage: no join, no broadcast, no shuffle.
    """
    if len(rules) > MAX_RULES:
        raise ContractViolation(f"{len(rules)} dated rules exceed {MAX_RULES}; join a rule table instead")
    target = col(day).cast("date")
    chosen: Column | None = None
    for effective, value in sorted(rules, key=lambda rule: rule[0], reverse=True):
        test = target >= F.lit(effective)
        literal = value if isinstance(value, Column) else F.lit(value)
        chosen = F.when(test, literal) if chosen is None else chosen.when(test, literal)
    if chosen is None:
        return F.lit(None)
    return chosen


def effective_rule_by_key(key: Column | str, day: Column | str, rules: dict[str, Sequence[tuple[dt.date, object]]]) -> Column:
    """As ``effective_rule`` with one rule list per key; null for an unknown key."""
    chosen: Column | None = None
    for name, dated in rules.items():
        value = effective_rule(day, dated)
        chosen = F.when(col(key) == name, value) if chosen is None else chosen.when(col(key) == name, value)
    return F.lit(None) if chosen is None else chosen


def required_rule(day: Column | str, rules: Sequence[tuple[dt.date, object]], name: str) -> Column:
    """As ``effective_rule`` but a date before the first rule fails the job."""
    value = effective_rule(day, rules)
    message = F.concat(F.lit(f"no known {name} for date "), col(day).cast("string"))
    return F.when(col(day).isNull(), F.lit(None)).otherwise(F.coalesce(value, F.raise_error(message)))


# -- ex-right reference price ----------------------------------------------------


@dataclass(frozen=True)
class ReferencePrice:
    """Numerator and denominator kept apart: the return is close*den/num with one division."""

    numerator: Column
    denominator: Column

    @property
    def price(self) -> Column:
        return self.numerator.cast("decimal(24,12)") / self.denominator

    def ratio_of(self, close: Column) -> Column:
        scaled = (close.cast("decimal(14,6)") * self.denominator).cast("decimal(20,10)")
        return scaled / self.numerator.cast("decimal(16,8)")

    def over_previous(self, previous_close: Column) -> Column:
        scaled = (previous_close.cast("decimal(14,6)") * self.denominator).cast("decimal(20,10)")
        return self.numerator.cast("decimal(18,8)") / scaled.cast("decimal(16,8)")


def reference_terms(day: Column | str, previous_close: Column, cash: Column, split: Column, rights_ratio: Column, rights_consideration: Column) -> ReferencePrice:
    """Ex-right reference price ``(prev - cash + rights paid) / (1 + split + rights)``.

    A non-positive denominator, or a date no exchange rule covers, fails the job.
    """
    total = F.lit(1).cast("decimal(8,6)") + split.cast("decimal(8,6)") + rights_ratio.cast("decimal(8,6)")
    known = F.lit(min(effective for effective, _ in REFERENCE_PRICE_RULES))
    denominator = (
        F.when(col(day).cast("date") < known, F.raise_error(F.concat(F.lit("no ex-right pricing rule for "), col(day).cast("string"))))
        .when(total <= 0, F.raise_error(F.lit("ex-right denominator <= 0")))
        .otherwise(total.cast("decimal(8,6)"))
    )
    numerator = previous_close.cast("decimal(18,6)") - cash.cast("decimal(18,6)") + rights_consideration.cast("decimal(18,8)")
    return ReferencePrice(numerator, denominator)


def reference_price(day: Column | str, previous_close: Column, cash: Column, split: Column, rights_ratio: Column, rights_price: Column) -> Column:
    paid = rights_price.cast("decimal(18,6)") * rights_ratio.cast("decimal(8,6)")
    return reference_terms(day, previous_close, cash, split, rights_ratio, paid).price


# -- fees ------------------------------------------------------------------------


@dataclass(frozen=True)
class FeeSchedule:
    """Commission is a broker setting; stamp duty and transfer fee follow dated rules."""

    commission_rate: Decimal | Column = Decimal("0.00025")
    commission_minimum: Decimal = Decimal("5.00")
    stamp_duty_rates: tuple[tuple[dt.date, Decimal], ...] = (
        (dt.date(2008, 9, 19), Decimal("0.001")),
        (dt.date(2023, 8, 28), Decimal("0.0005")),
    )
    transfer_fee_rates: tuple[tuple[dt.date, Decimal], ...] = (
        (dt.date(1900, 1, 1), Decimal("0.00002")),
        (dt.date(2022, 4, 29), Decimal("0.00001")),
    )

    def __post_init__(self) -> None:
        if not isinstance(self.commission_rate, Column) and self.commission_rate <= 0:
            raise ContractViolation("commission rate must be positive")
        if self.commission_minimum < 0:
            raise ContractViolation("commission minimum cannot be negative")

    def breakdown(self, side: Column, day: Column, price: Column, quantity: Column) -> dict[str, Column]:
        """Fee columns, each rounded to cents in the order the broker books them."""

        def rate(rules: tuple[tuple[dt.date, Decimal], ...], name: str) -> Column:
            typed = [(effective, F.lit(value).cast("decimal(8,6)")) for effective, value in rules]
            return required_rule(day, typed, name)

        # No price means nothing was traded, so no rate has to be known for the date.
        traded = price.isNotNull() & quantity.isNotNull()
        gross = money(price.cast("decimal(14,6)") * quantity.cast("decimal(16,0)"))
        commission = money(F.greatest(gross * F.lit(self.commission_rate).cast("decimal(8,6)"), F.lit(self.commission_minimum).cast("decimal(8,6)")))
        transfer = money(gross * F.when(traded, rate(self.transfer_fee_rates, "transfer fee rate")))
        zero = F.lit(0).cast("decimal(18,2)")
        stamp_rate = F.when(traded, rate(self.stamp_duty_rates, "stamp duty rate"))
        stamp = F.when(side == "sell", money(gross * stamp_rate)).when(stamp_rate.isNotNull(), zero)
        total = money(commission + transfer + stamp)
        net = F.when(side == "sell", money(gross - total)).otherwise(money(gross + total))
        return {
            "gross_amount": gross,
            "commission": F.when(traded, commission),
            "stamp_duty": stamp,
            "transfer_fee": transfer,
            "total_fee": total,
            "net_amount": net,
        }


# -- daily price limits ------------------------------------------------------------


@dataclass(frozen=True)
class LimitRule:
    effective_date: dt.date
    daily_rate: Decimal
    new_listing_policy: str = "DAILY_LIMIT_FROM_LISTING"
    first_day_up: Decimal | None = None
    first_day_down: Decimal | None = None


# Board limit rules by effective date.
LIMIT_RULES: dict[str, tuple[LimitRule, ...]] = {
    "主板": (
        LimitRule(dt.date(2015, 1, 1), Decimal("0.10"), "FIRST_DAY_ASYMMETRIC", Decimal("0.44"), Decimal("0.36")),
        LimitRule(dt.date(2023, 2, 17), Decimal("0.10"), "FIRST_FIVE_NO_LIMIT"),
    ),
    "创业板": (
        LimitRule(dt.date(2015, 1, 1), Decimal("0.10")),
        LimitRule(dt.date(2020, 8, 24), Decimal("0.20"), "FIRST_FIVE_NO_LIMIT"),
    ),
    "科创板": (LimitRule(dt.date(2019, 7, 22), Decimal("0.20"), "FIRST_FIVE_NO_LIMIT"),),
    "北交所": (LimitRule(dt.date(2021, 11, 15), Decimal("0.30"), "FIRST_DAY_NO_LIMIT"),),
}
LIMIT_RULE_VERSION = "limit_rule_table_v1"


@dataclass(frozen=True)
class LimitRules:
    by_board: dict[str, tuple[LimitRule, ...]] = field(default_factory=lambda: dict(LIMIT_RULES))
    version: str = LIMIT_RULE_VERSION

    def resolve(self, board: Column | str, day: Column | str) -> Column:
        """STRUCT of the board's rule on a day, null when no rule applies."""
        dated = {}
        for name, rules in self.by_board.items():
            dated[name] = [
                (
                    rule.effective_date,
                    F.struct(
                        F.lit(rule.daily_rate).cast("decimal(6,4)").alias("daily_rate"),
                        F.lit(rule.new_listing_policy).alias("policy"),
                        F.lit(rule.first_day_up).cast("decimal(6,4)").alias("first_up"),
                        F.lit(rule.first_day_down).cast("decimal(6,4)").alias("first_down"),
                    ),
                )
                for rule in rules
            ]
        return effective_rule_by_key(board, day, dated)
