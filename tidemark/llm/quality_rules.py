"""Quality rules: a threshold table compiled into one projection, without user functions.

Counts are taken once per text with built-in functions; every rule compares two of them by a
percentage in whole numbers, so no rounding decides. The first failing comparison rejects.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, word_list

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this at from or an he she not have has but they you we his her which their were been will would there can all if one "
    "le la les de des du et en un une que qui dans pour par sur pas est ce il elle au aux avec sont plus se ne son sa ses ou mais nous vous "
    "der die das und ist von den mit für auf ein eine nicht sich dem des im zu auch es an als bei nach wie wird sie er aus sind oder einer "
    "el los las del y que por con para una no su al lo como más pero sus esta este entre cuando muy sin sobre también hay donde"
).split()
#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_exclaims", "n_echoes"]


@dataclass(frozen=True)
class Rule:
    """Fails where 100 * over is below ``least`` or above ``most`` times ``under``; rules on ``n_lines`` wait for ``from_lines``."""

    name: str
    over: str
    under: str
    least: int | None = None
    most: int | None = None
    from_lines: int = 0


#: The rules of the contract, and those of the method's own verdict.
BASE = (
    Rule("words", "n_words", "one", least=2000),
    Rule("repeated", "n_repeat_words", "n_words", most=30),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "word_chars", most=2),
    Rule("shouts", "n_exclaims", "n_words", most=20),
    Rule("echoes", "n_echoes", "n_words", most=20),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=40, from_lines=4),
)


def _repeated(words: Column, window: int) -> Column:
    """Words that lie in a window of ``window`` words that the text has twice or more."""
    hashed = F.transform(words, lambda x: F.xxhash64(x))
    windows = F.transform(
        F.array(hashed),
        lambda h: F.when(F.size(h) >= window, F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))),
    )[0]

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1), p + window) - p))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def twice(sorted_windows: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        found = F.filter(sorted_windows, lambda x, i: same(x, F.get(sorted_windows, i + 1)) | F.when(i > 0, same(x, F.get(sorted_windows, i - 1))).otherwise(False))
        return F.transform(F.array(F.array_sort(F.transform(found, lambda x: x["i"]))), covered)[0]

    def count(g: Column) -> Column:
        numbered = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(F.transform(F.array(numbered), twice)[0])

    return F.coalesce(F.transform(F.array(windows), count)[0], F.lit(0).cast("long"))


def _stop_words() -> str:
    edge = SPACE[:-1]
    return f"(?<!{edge.replace('[', '[^')})(?:{'|'.join(dict.fromkeys(STOP_WORDS))})(?!{edge.replace('[', '[^')})"


def _fails(rule: Rule, count: dict[str, Column]) -> Column:
    over, under = count[rule.over] * 100, count[rule.under]
    parts = [over < under * rule.least] if rule.least is not None else []
    parts += [over > under * rule.most] if rule.most is not None else []
    failed = reduce(lambda a, b: a | b, parts)
    return failed & (count["n_lines"] >= rule.from_lines) if rule.from_lines else failed


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, window: int = WINDOW, carry: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text), in its order: one projection, no shuffle.

    A null text has no words and fails the base rule on length, as do empty and blank texts; texts of any
    length are read whole; repeated rows are judged alike; other columns are not read. ``failed`` names the
    rules that reject, in table order. ``carry`` names the columns of ``docs`` to hand on instead of doc_id;
    ``only_kept`` leaves out rejected rows.
    """
    names = ["doc_id"] if carry is None else carry
    held = F.struct(*names).alias("_row")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(held, text.alias("_text"), word_list(F.col("text")).alias("_words"), F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"))
    number = lambda c: c.cast("long")
    counted = parts.select(
        "_row",
        number(F.size("_words")).alias("n_words"),
        number(F.length(F.array_join("_words", ""))).alias("word_chars"),
        number(F.regexp_count("_text", F.lit(SYMBOLS))).alias("n_symbols"),
        number(F.size("_lines")).alias("n_lines"),
        number(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _repeated(F.col("_words"), window).alias("n_repeat_words"),
        number(F.regexp_count(F.lower("_text"), F.lit(_stop_words()))).alias("n_stop_words"),
        number(F.regexp_count("_text", F.lit("!"))).alias("n_exclaims"),
        number(F.size(F.filter("_words", lambda x, i: F.when(i > 0, x == F.get("_words", i - 1)).otherwise(False)))).alias("n_echoes"),
    )
    count = {name: F.col(name) for name in counted.columns} | {"one": F.lit(1).cast("long")}
    base_failed = reduce(lambda a, b: a | b, [_fails(rule, count) for rule in base])
    failed = F.concat_ws(",", *[F.when(_fails(rule, count), rule.name) for rule in (*base, *rules)])
    judged = counted.withColumns({"base_failed": base_failed, "failed": failed}).withColumn("kept", F.col("failed") == "").select("_row.*", *COUNTS, "base_failed", "failed", "kept")
    if not only_kept:
        return judged
    # A plain filter would be pushed below the counts and repeat them for every comparison.
    return judged.select(F.inline(F.filter(F.array(F.struct(*judged.columns)), lambda r: r["kept"])))


def quality_sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, window: int = WINDOW) -> str:
    """The same as DuckDB SQL."""

    def fails(rule: Rule) -> str:
        under = "1" if rule.under == "one" else rule.under
        parts = [f"100 * {rule.over} < {rule.least} * {under}"] if rule.least is not None else []
        parts += [f"100 * {rule.over} > {rule.most} * {under}"] if rule.most is not None else []
        joined = "(" + " or ".join(parts) + ")"
        return f"({joined} and n_lines >= {rule.from_lines})" if rule.from_lines else joined

    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    named = ", ".join(f"case when {fails(r)} then '{r.name}' end" for r in (*base, *rules))
    return f"""
with texts as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
split as (select rid, doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from texts),
windows as (select rid, unnest(range(0, len(ws) - {window - 1})) as i, unnest(list_transform(range(0, len(ws) - {window - 1}), lambda i: array_to_string(ws[i + 1 : i + {window}], ' '))) as w from split where len(ws) >= {window}),
twice as (select rid, i from windows qualify count(*) over (partition by rid, w) > 1),
covered as (select rid, sum(c) as n from (select rid, least({window}, coalesce(lead(i) over (partition by rid order by i) - i, {window})) as c from twice) group by rid),
counted as (select s.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(len(regexp_extract_all(t, '{SYMBOLS}')) as bigint) as n_symbols,
  cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
  cast(len(list_filter(regexp_split_to_array(lower(t), '{SPACE}'), lambda x: x in ({stops}))) as bigint) as n_stop_words, cast(len(regexp_extract_all(t, '!')) as bigint) as n_exclaims,
  cast(len(list_filter(ws, lambda x, i: i > 1 and x = ws[i - 1])) as bigint) as n_echoes
  from split s left join covered c using (rid)),
judged as (select *, ({' or '.join(fails(r) for r in base)}) as base_failed, concat_ws(',', {named}) as failed from counted)
select *, failed = '' as kept from judged"""
