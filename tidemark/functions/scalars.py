"""Scalar column expressions (identifiers, money, exchange clock, evidence text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(18,6)"
MONEY = "decimal(18,2)"
EXCHANGE_ZONE = "Asia/Shanghai"
UNKNOWN_LIST_DATE_TS = "1990-12-19 15:00:00"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# -- identifiers ---------------------------------------------------------------


def pad_id(value: Column | str, width: int = 6) -> Column:
    """Left-pad with zeros; unlike a bare ``lpad`` a longer id is never cut."""
    text = col(value).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def six_digit_code(value: Column | str) -> Column:
    """First run of six digits, null when there is none."""
    return F.nullif(F.regexp_extract(col(value).cast("string"), r"(\d{6})", 1), F.lit(""))


def exchange_symbol(security_id: Column | str) -> Column:
    code = col(security_id)
    return F.concat(F.when(code.startswith("6"), "sh").otherwise("sz"), code)


def board_from_id(security_id: Column | str) -> Column:
    code = col(security_id)
    return (
        F.when(F.substring(code, 1, 3).isin("688", "689"), "科创板")
        .when(F.substring(code, 1, 3).isin("300", "301"), "创业板")
        .when(F.substring(code, 1, 1).isin("8", "9", "4"), "北交所")
        .otherwise("主板")
    )


def _squeezed_name(name: Column | str) -> Column:
    return F.upper(F.regexp_replace(col(name), " ", ""))


def is_st_name(name: Column | str) -> Column:
    squeezed = _squeezed_name(name)
    return F.coalesce(squeezed.startswith("ST") | squeezed.startswith("*ST"), F.lit(False))


def is_delisted_name(name: Column | str) -> Column:
    return F.coalesce(F.contains(_squeezed_name(name), F.lit("退")), F.lit(False))


# -- numbers -------------------------------------------------------------------


def money(value: Column | str) -> Column:
    """Cents, half away from zero."""
    return F.round(col(value), 2).cast(MONEY)


def money_text(value: Column | str) -> Column:
    return money(value).cast("string")


def decimal_or_null(value: Column | str, dtype: str = PRICE) -> Column:
    return F.trim(col(value).cast("string")).try_cast(dtype)


def decimal_or_zero(value: Column | str, dtype: str = PRICE) -> Column:
    return F.coalesce(decimal_or_null(value, dtype), F.lit(0).cast(dtype))


def round_down_lot(quantity: Column | str, lot: int = 100) -> Column:
    """Whole lots towards zero; nothing for a non-positive quantity."""
    whole = col(quantity).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), whole - F.pmod(whole, F.lit(lot)))


def limit_prices(close: Column | str, up_rate: Column, down_rate: Column | None = None) -> tuple[Column, Column]:
    """Daily limit-up and limit-down prices on the one-cent tick."""
    base = col(close).cast("decimal(18,2)")
    down = up_rate if down_rate is None else down_rate
    one = F.lit(1).cast("decimal(6,4)")
    return (
        money(base * (one + up_rate.cast("decimal(6,4)"))),
        money(base * (one - down.cast("decimal(6,4)"))),
    )


# -- exchange clock ------------------------------------------------------------


def clock(day: Column | str, hours: int, minutes: int = 0) -> Column:
    """Exchange wall-clock at a time of day, as TIMESTAMP_NTZ."""
    return col(day).cast("date").cast("timestamp_ntz") + F.expr(f"INTERVAL '{hours:02d}:{minutes:02d}' HOUR TO MINUTE")


def market_open_ts(day: Column | str) -> Column:
    return clock(day, 9, 30)


def market_close_ts(day: Column | str) -> Column:
    return clock(day, 15)


def timestamp_literal(value: object) -> Column:
    """As-of literal in exchange wall-clock; accepts text, date-times or columns."""
    if isinstance(value, Column):
        return value
    text = str(value).replace("T", " ")
    if text.endswith("+08:00"):
        text = text[: -len("+08:00")]
    return F.lit(text).cast("timestamp_ntz")


def is_exchange_stamp(value: Column | str) -> Column:
    """True for text with an explicit +08:00 offset that parses; the offset is lost by a cast."""
    text = col(value).cast("string")
    return F.coalesce(text.rlike(r"\+08:00$") & parse_exchange_ts(text).isNotNull(), F.lit(False))


def parse_exchange_ts(value: Column | str) -> Column:
    """ISO text with +08:00 to exchange wall-clock; null for any other text."""
    text = col(value).cast("string")
    return F.when(
        text.rlike(r"\+08:00$"),
        F.regexp_replace(F.regexp_replace(text, r"\+08:00$", ""), "T", " ").try_cast("timestamp_ntz"),
    )


def close_ts_or_unknown(day: Column | str) -> Column:
    """15:00 of a date, or the fixed stamp of an unknown listing date."""
    return F.coalesce(market_close_ts(day), F.lit(UNKNOWN_LIST_DATE_TS).cast("timestamp_ntz"))


def snapshot_date(snapshot_id: Column | str) -> Column:
    head = F.split_part(col(snapshot_id).cast("string"), F.lit("_"), F.lit(1))
    return F.to_date(head, "yyyyMMdd")


def epoch_ms_to_local(epoch_ms: Column | str) -> Column:
    """Epoch milliseconds to exchange wall-clock, independent of the session zone."""
    seconds = col(epoch_ms).cast("bigint").cast("decimal(18,0)") / F.lit(1000).cast("decimal(4,0)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(EXCHANGE_ZONE), utc)


def minute_text(local_ts: Column | str) -> Column:
    return F.date_format(col(local_ts), "yyyy-MM-dd HH:mm")


def normalize_disclosure_ts(value: Column | str) -> Column:
    """The four accepted date-time spellings as ``yyyy-MM-dd HH:mm``; null for any other."""
    text = F.trim(col(value).cast("string"))
    pattern = r"^(\d{4})([/-])(\d{1,2})\2(\d{1,2})\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"

    def part(group: int) -> Column:
        found = F.regexp_extract(text, pattern, group)
        return F.when(found == "", "0").otherwise(found).cast("int")

    built = F.try_make_timestamp_ntz(part(1), part(3), part(4), part(5), part(6), part(7).cast("decimal(16,6)"))
    return F.when(text.rlike(pattern), minute_text(built))


# -- announcement and notice text ------------------------------------------------


def normalize_url(value: Column | str) -> Column:
    """Attachment path without host and leading slashes; empty text for null."""
    raw = F.trim(F.coalesce(col(value).cast("string"), F.lit("")))
    path = F.when(
        raw.startswith("http://") | raw.startswith("https://"),
        F.regexp_replace(raw, r"^.*?static\.cninfo\.com\.cn/", ""),
    ).otherwise(raw)
    return F.regexp_replace(path, "^/+", "")


def clean_fragment(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(value), r"(?U)\s+", " "))


def normalize_page_text(value: Column | str) -> Column:
    return clean_fragment(F.translate(F.coalesce(col(value), F.lit("")), "\uf06c\u00a0\u3000", "   "))


def compact_date(value: Column | str) -> Column:
    return F.translate(F.regexp_replace(col(value), r"(?U)\s+", ""), "./", "--")


def date_identity(value: Column | str) -> Column:
    """Year-month-day numbers without leading zeros, else the compacted text."""
    numbers = F.regexp_extract_all(col(value), F.lit(r"(\d+)"), F.lit(1))
    joined = F.concat_ws("|", F.transform(numbers, lambda n: n.cast("bigint").cast("string")))
    return F.when(F.size(numbers) == 3, joined).otherwise(compact_date(value))


def cash_identity(value: Column | str) -> Column:
    """Share unit and first amount of a cash phrase, comparable across spellings."""
    text = col(value)
    unit = F.when(text.rlike(r"每\s*10\s*股"), "10").otherwise("1")
    amount = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*元", 1), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(amount, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat_ws("|", unit, F.coalesce(plain, clean_fragment(text)))
