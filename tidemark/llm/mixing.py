"""Mixing sources to target weights by Pfair scheduling.

A source's texts, in a fixed pseudo-random order, are cut into blocks of equal size. A source of
weight u / period gets block k released at slot floor(k * period / u) and due at
ceil((k + 1) * period / u); every slot goes to the released block with the earliest deadline. At any
slot each source has then had less than one block more or less than its weight asks for.

Releases and deadlines repeat every ``period`` slots, so the schedule of one period, a table bounded by
ten slots a source where that is more, gives the slot of every block of any amount of data. Only running sizes are
computed over the data, in buckets of the order, so that a hot source is spread; equal rows are counted first and
take their places after each other, so that no number of copies is one bucket.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import running_sum
from tidemark.staging import stage

PERIOD, BLOCK, ALPHA = 1000, 20_000, 0.8
ROW_COLUMNS = ("doc_id", "source", "size", "block", "release", "deadline", "slot", "in_mix")


@dataclass(frozen=True)
class Mix:
    """``rows``: each text's block and slot; ``shares``: units of a period by source; ``horizon``: slots before a source runs out; ``period``: its slots."""

    rows: DataFrame
    shares: dict[str, int]
    horizon: int
    period: int = PERIOD


def units(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole units of a period, largest remainders first; every weight above 0 keeps one unit at least."""
    wanted = {k: w for k, w in weights.items() if w > 0}
    if len(wanted) > period:
        raise ValueError(f"{len(wanted)} sources do not fit a period of {period} slots: use a longer period or coarser sources")
    total = sum(wanted[k] for k in sorted(wanted))
    exact = {k: w / total * (period - len(wanted)) for k, w in wanted.items()}
    given = {k: 1 + int(x) for k, x in exact.items()}
    rest = period - sum(given.values())
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))[:rest]:
        given[k] += 1
    return given


def period_for(sources: int, period: int) -> int:
    """Slots of a period: ``period``, or ten a source if that is more, so that weights still differ."""
    return max(period, 10 * sources)


def one_period(shares: dict[str, int], period: int) -> list[tuple[str, int, int]]:
    """(source, block, slot) of a period: earliest deadline first among released blocks, ties by name."""
    waiting = [(0, k, 0) for k in sorted(shares)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period if shares else 0):
        while waiting and waiting[0][0] <= slot:
            _, k, n = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(n + 1) * period // shares[k]), k, n))
        due, k, n = heapq.heappop(ready)
        assert due > slot, "a deadline was missed"
        out.append((k, n, slot))
        if n + 1 < shares[k]:
            heapq.heappush(waiting, ((n + 1) * period // shares[k], k, n + 1))
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, period: int = PERIOD, block: int = BLOCK, carry: tuple[str, ...] = (), size: str | None = None, place: tuple[str, ...] = ()) -> Mix:
    """Schedule every row of ``docs`` (doc_id, source, text).

    Sizes are code points. Without ``weights`` a source's target is its size to the power ``alpha``.
    Columns of ``rows``: doc_id, source, size, block, release, deadline, slot, in_mix. A text belongs to the
    block in which it begins; one longer than a block uses up the following ones too. ``in_mix`` holds for the
    slots before the first source has no whole block left; there the mix is at its targets. Later texts still
    have their slots: a source that runs out leaves its slots empty, and the others go on in their own proportions.
    Null texts are empty, a null source is the source ''. The order is a hash of id and text; equal rows take places
    after each other. Sources without a positive weight have no slot and are not in the mix. The driver holds one period's
    schedule, ten slots a weighted source or ``period`` if that is more (``period_for``). An empty table gives no rows.
    ``size`` names a column of sizes, taken instead of the text, which then is not read. ``place`` names whole numbers or strings
    whose order, the last one within the others, is that of the rows: a source's texts are cut into blocks in that order instead.
    ``carry`` names small columns to hand through, under names that are not columns of ``rows`` (else ValueError); others
    are not read.
    """
    clash = sorted(set(carry) & set(ROW_COLUMNS))
    if clash:
        raise ValueError(f"carried columns have names of the result: {clash}")
    spark = docs.sparkSession
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = ["doc_id", F.coalesce("source", F.lit("")).alias("source"), (F.length(text) if size is None else F.col(size)).cast("long").alias("_one")]
    if place:
        placing = [F.col(c).alias(f"_place{k}") for k, c in enumerate(place)]
        each = docs.select(*named, *placing, carried.alias("_carried"), F.lit(1).cast("long").alias("_copies"))
        last = f"_place{len(place) - 1}"
        light = stage(each.withColumns({"size": F.col("_one"), "_chunk": F.expr(f"{last} div 4096")}), "sizes")
        bucket, within = [f"_place{k}" for k in range(len(place) - 1)] + ["_chunk"], [last]
    else:
        order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
        equal = docs.select(*named, order.alias("_order"), carried.alias("_carried")).groupBy("doc_id", "source", "_one", "_order", "_carried").agg(F.count("*").alias("_copies"))
        light = stage(equal.withColumns({"size": F.col("_one") * F.col("_copies"), "_bucket": F.substring("_order", 1, 3)}), "sizes")
        bucket, within = ["_bucket"], ["_order", "doc_id", "_carried"] if carry else ["_order", "doc_id"]
    weighted = None if weights is None else [k for k, w in weights.items() if w > 0]
    mixed = light.where("size > 0") if weighted is None else light.where(F.col("source").isin(weighted))
    totals = {r["source"]: r["size"] for r in mixed.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    wanted = {k: float(n) ** alpha for k, n in totals.items()} if weights is None else {k: weights[k] for k in totals}
    period = period_for(len(wanted), period)
    shares = units(wanted, period)
    slots = one_period(shares, period)

    whole = {(k, n): slot for k, n, slot in slots}
    ends = [(totals[k] // block // u) * period + whole[k, totals[k] // block % u] for k, u in shares.items()]
    horizon = min(ends, default=0)

    groups = running_sum(light, ["source"], bucket, within, "size", "_end")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    placed = groups.select("doc_id", "source", F.col("_one").alias("size"), "_carried", (F.col("_end") - F.col("size")).alias("_from"), copies.alias("_copy"))
    placed = placed.withColumn("_upto", F.col("_from") + F.col("size") * F.col("_copy")).drop("_from", "_copy")
    plan = spark.createDataFrame([(k, n, slot, shares[k]) for k, n, slot in slots], "source string, _nth bigint, _slot bigint, _units bigint")
    share = spark.createDataFrame(list(shares.items()), "source string, _units bigint")
    at = placed.join(share, "source", "left").withColumn("block", F.expr(f"(_upto - size) div {block}L"))
    at = at.withColumn("_nth", F.expr("block % _units")).join(plan.drop("_units"), ["source", "_nth"], "left")
    rows = at.select(
        "doc_id",
        "source",
        "size",
        "block",
        F.expr(f"(block * {period}L) div _units").alias("release"),
        F.expr(f"((block + 1) * {period}L + _units - 1) div _units").alias("deadline"),
        F.expr(f"(block div _units) * {period}L + _slot").alias("slot"),
        *[F.col(f"_carried.{c}").alias(c) for c in carry],
    )
    return Mix(rows.withColumn("in_mix", F.coalesce(F.col("slot") < F.lit(horizon), F.lit(False))), shares, horizon, period)


def mix_sql(alpha: float = ALPHA, period: int = PERIOD, block: int = BLOCK) -> str:
    """The same as DuckDB SQL: the schedule of one period by a recursive query."""
    return f"""
with recursive light as materialized (select doc_id, coalesce(source, '') as source, cast(length(coalesce(text, '')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as o from documents),
totals as materialized (select source, cast(sum(size) as bigint) as size from light group by source),
weighted as (select source, size, power(size, {alpha}) as w, greatest({period}, 10 * count(*) over ()) as p from totals where size > 0),
exact as (select source, size, p, w / sum(w) over () * (p - count(*) over ()) as x from weighted),
whole as (select source, size, p, x, 1 + cast(floor(x) as bigint) as given, p - sum(1 + cast(floor(x) as bigint)) over () as rest from exact),
shares as materialized (select source, size, p, given + case when row_number() over (order by floor(x) - x, source) <= rest then 1 else 0 end as u from whole),
listed as materialized (select list(source order by source) as s, list(u order by source) as u, count(*) as n, max(p) as p from shares),
slots as (
  select cast(0 as bigint) as slot, cast(null as bigint) as pick, list_transform(u, lambda x: cast(0 as bigint)) as done from listed
  union all
  select slot + 1, pick2, list_transform(done, lambda x, i: case when i = pick2 then x + 1 else x end)
  from (select slot, done, list_sort(list_transform(list_filter(range(1, n + 1), lambda i: done[i] < u[i] and (done[i] * p) // u[i] <= slot), lambda i: {{'d': ((done[i] + 1) * p + u[i] - 1) // u[i], 'i': i}}))[1].i as pick2 from slots, listed where slot < p)
),
plan as materialized (select s[pick] as source, done[pick] - 1 as nth, slot - 1 as slot from slots, listed where pick is not null),
horizon as (select min((h.size // {block} // h.u) * h.p + p.slot) as h from shares h join plan p on p.source = h.source and p.nth = (h.size // {block}) % h.u),
placed as (select doc_id, source, size, cast(sum(size) over (partition by source order by o, doc_id rows unbounded preceding) as bigint) as upto from light),
found as (select p.*, u, shares.p as per, (upto - p.size) // {block} as block from placed p left join shares using (source))
select doc_id, found.source, size, cast(block as bigint) as block, cast(block * per // u as bigint) as release, cast(((block + 1) * per + u - 1) // u as bigint) as deadline,
  cast((block // u) * per + plan.slot as bigint) as slot, coalesce((block // u) * per + plan.slot < (select h from horizon), false) as in_mix
from found left join plan on plan.source = found.source and plan.nth = block % u"""
