"""Conversations put back into ``system? (user assistant)+`` by the cheapest edits, the least audit among equals.

A row is kept (0, if its role may come next), given the role user or assistant (2) or deleted (3, which blank
and repeated rows must be); an empty row of user or assistant may go in anywhere (2); a row that stays though
its text breaks off costs 1 more. What has been read so far matters only by one of four states: nothing yet,
after system, after user, after assistant. The audit is the initials of the edits in order.

Hirschberg's division: costs run forward from the state a stretch is entered in to its middle and backward from
the state it is left in; a crossing is a state where both sums are least together, and each half is then solved
alone, so memory is the stretch and four numbers a side. With every forward cost goes the place of its audit
among the four. Audits of as many rows, written with insertions before their row, are never beginnings of one
another, so of several least crossings the one whose audit so far is least has the least audit as a whole.

The same division spreads a conversation over the cluster. Rows are sorted by ranges and cut into blocks of
1,024, a stretch of one conversation in a block is a table of costs and places from each state to each, and
stretches are put together in groups of 1,024 until one is left a conversation; its crossings go down again.
No task holds a conversation, and one with a third of all rows takes as many tasks as its rows need. Only a
digest of the whole, where it is asked for, reads a conversation in one task, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import stage

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
BLOCK_BITS = 10
WORD, SPACES = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: States: nothing yet, after system, after user, after assistant. The role that an inserted or re-roled row takes in each.
NEXT_ROLE = ("user", "user", "assistant", "user")
_AFTER = {"user": 2, "assistant": 3}
_MAY = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_LEGAL = ("su", "ua", "au")
#: What is inserted after the last row, by state.
TAIL = ("", "II", "I", "")

Vector = tuple[tuple[int, ...], tuple[int, ...]]
Element = tuple[Vector, ...]
UNREACHED = -1


def _row_choices(initial: str, must_go: bool, broken: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) of a row: the least (cost, edits)."""
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(before: int, after: int, cost: int, edits: str) -> None:
        best[before, after] = min(best.get((before, after), (cost, edits)), (cost, edits))

    for before in range(4):
        state, cost, edits = before, 0, ""
        for _ in range(3):
            offer(before, state, cost + DELETE, edits + "D")
            if not must_go:
                if state in _MAY.get(initial, {}):
                    offer(before, _MAY[initial][state], cost + KEEP + broken * BROKEN, edits + "K")
                offer(before, _AFTER[NEXT_ROLE[state]], cost + REROLE + broken * BROKEN, edits + "R")
            state, cost, edits = _AFTER[NEXT_ROLE[state]], cost + INSERT, edits + "I"
    return best


#: Rows differ only by kind: must go, or initial (s, u, a, other) and whether the text breaks off.
CHOICES = [_row_choices("", True, False)] + [_row_choices(i, False, b) for i in "sua?" for b in (False, True)]


def _element(choices: dict[tuple[int, int], tuple[int, str]]) -> Element:
    out = []
    for before in range(4):
        edits = sorted(e for (b, _), (_, e) in choices.items() if b == before)
        out.append((tuple(choices[before, x][0] if (before, x) in choices else UNREACHED for x in range(4)), tuple(edits.index(choices[before, x][1]) if (before, x) in choices else UNREACHED for x in range(4))))
    return tuple(out)


ROWS = [_element(c) for c in CHOICES]


def start(state: int) -> Vector:
    return tuple(0 if x == state else UNREACHED for x in range(4)), tuple(0 if x == state else UNREACHED for x in range(4))


@lru_cache(maxsize=1 << 16)
def _step(vector: Vector, element: Element) -> tuple[int, Vector]:
    costs, places = vector
    best = []
    for after in range(4):
        ways = [(costs[p] + element[p][0][after], places[p], element[p][1][after]) for p in range(4) if costs[p] != UNREACHED and element[p][0][after] != UNREACHED]
        best.append(min(ways) if ways else None)
    order = sorted(w[1:] for w in best if w)
    least = min(w[0] for w in best if w)
    return least, (tuple(w[0] - least if w else UNREACHED for w in best), tuple(order.index(w[1:]) if w else UNREACHED for w in best))


def forward(vector: Vector, elements: list[Element]) -> tuple[int, Vector]:
    """Costs and places after the elements; costs are the first number more than the vector's."""
    total = 0
    for element in elements:
        least, vector = _step(vector, element)
        total += least
    return total, vector


@lru_cache(maxsize=1 << 16)
def _back(costs: tuple[int, ...], element: Element) -> tuple[int, tuple[int, ...]]:
    best = []
    for before in range(4):
        ways = [element[before][0][x] + costs[x] for x in range(4) if costs[x] != UNREACHED and element[before][0][x] != UNREACHED]
        best.append(min(ways) if ways else None)
    least = min(w for w in best if w is not None)
    return least, tuple(w - least if w is not None else UNREACHED for w in best)


def backward(costs: tuple[int, ...], elements: list[Element]) -> tuple[int, ...]:
    """Costs from each state before the elements, less their least."""
    for element in reversed(elements):
        _, costs = _back(costs, element)
    return costs


def crossings(elements: list[Element], entry: int, leave: int) -> list[int]:
    """States between the elements, first and last included, of the least audit among the cheapest."""
    states = [entry] + [0] * (len(elements) - 1) + [leave]
    todo = [(0, len(elements))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        middle = (lo + hi) // 2
        _, (costs, places) = forward(start(states[lo]), elements[lo:middle])
        rest = backward(start(states[hi])[0], elements[middle:hi])
        states[middle] = min((costs[x] + rest[x], places[x], x) for x in range(4) if costs[x] != UNREACHED and rest[x] != UNREACHED)[2]
        todo += [(lo, middle), (middle, hi)]
    return states


@lru_cache(maxsize=1 << 14)
def _short(kinds: tuple[int, ...], entry: int, leave: int) -> tuple[int, ...]:
    return tuple(crossings([ROWS[k] for k in kinds], entry, leave))


def joined(elements: list[Element]) -> Element:
    out = []
    for entry in range(4):
        total, (costs, places) = forward(start(entry), elements)
        out.append((tuple(c + total if c != UNREACHED else c for c in costs), places))
    return tuple(out)


@lru_cache(maxsize=1 << 14)
def _short_joined(kinds: tuple[int, ...]) -> Element:
    return joined([ROWS[k] for k in kinds])


def best_leave(element: Element) -> tuple[int, int]:
    """(cost, state after the last row) of a whole conversation from its start, insertions after it included."""
    costs, places = element[0]
    cost, _, state = min((costs[x] + INSERT * len(TAIL[x]), places[x], x) for x in range(4) if costs[x] != UNREACHED)
    return cost, state


def _pack(element: Element) -> list[int]:
    return [v for vector in element for part in vector for v in part]


def _unpack(flat: list[int]) -> Element:
    return tuple((tuple(flat[8 * e : 8 * e + 4]), tuple(flat[8 * e + 4 : 8 * e + 8])) for e in range(4))


_STRETCH = "ck string, block bigint, element array<bigint>, first string, last string, illegal bigint"


def _stretches(rows: list[dict]) -> Iterator[tuple[int, int]]:
    lo = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i]["ck"] != rows[lo]["ck"]:
            yield lo, i
            lo = i


def block_stretches(table: pa.Table) -> pa.Table:
    """The stretch of each conversation in a block: its element, end initials and illegal neighbours."""
    rows = table.sort_by("at").to_pylist()
    out: dict[str, list] = {"ck": [], "block": [], "element": [], "first": [], "last": [], "illegal": []}
    for lo, hi in _stretches(rows):
        initials = [r["initial"] for r in rows[lo:hi]]
        for name, value in zip(out, (rows[lo]["ck"], rows[lo]["block"], _pack(_short_joined(tuple(r["kind"] for r in rows[lo:hi]))), initials[0], initials[-1], sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])))):
            out[name].append(value)
    return pa.table({"ck": pa.array(out["ck"], pa.string()), "block": pa.array(out["block"], pa.int64()), "element": pa.array(out["element"], pa.list_(pa.int64())), "first": pa.array(out["first"], pa.string()), "last": pa.array(out["last"], pa.string()), "illegal": pa.array(out["illegal"], pa.int64())})


def group_element(table: pa.Table) -> pa.Table:
    rows = table.sort_by("k").to_pylist()
    whole = joined([_unpack(r["element"]) for r in rows])
    return pa.table({"ck": pa.array([rows[0]["ck"]]), "k": pa.array([rows[0]["up"]], pa.int64()), "element": pa.array([_pack(whole)], pa.list_(pa.int64()))})


def group_crossings(table: pa.Table, state: pa.Table) -> pa.Table:
    """Entry and leaving states of the members of a group whose own are known."""
    rows = table.sort_by("k").to_pylist()
    known = state.to_pylist()
    states = crossings([_unpack(r["element"]) for r in rows], known[0]["entry"], known[0]["leave"]) if rows and known else []
    rows = rows if states else []
    return pa.table({"ck": pa.array([r["ck"] for r in rows], pa.string()), "k": pa.array([r["k"] for r in rows], pa.int64()), "entry": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32())})


def _spoken(kind: int, before: int, after: int) -> tuple[str, str, str | None]:
    """(edits, roles inserted as lines, role given) of a row."""
    edits = CHOICES[kind][before, after][1]
    lead, state = "", before
    for _ in range(edits.count("I")):
        lead += f"{NEXT_ROLE[state]}:\n"
        state = _AFTER[NEXT_ROLE[state]]
    return edits, lead, NEXT_ROLE[state] if edits[-1] == "R" else None


SPOKEN = [{key: _spoken(k, *key) for key in choices} for k, choices in enumerate(CHOICES)]


def block_edits(table: pa.Table, state: pa.Table) -> pa.Table:
    rows = table.sort_by("at").to_pylist()
    known = {r["ck"]: (r["entry"], r["leave"]) for r in state.to_pylist()}
    said: list[tuple[str, str, str | None]] = []
    for lo, hi in _stretches(rows):
        kinds = tuple(r["kind"] for r in rows[lo:hi])
        states = _short(kinds, *known[rows[lo]["ck"]])
        said += [SPOKEN[k][pair] for k, pair in zip(kinds, zip(states, states[1:]))]
    return pa.table({"ck": pa.array([r["ck"] for r in rows], pa.string()), "at": pa.array([r["at"] for r in rows], pa.int64()), "edits": pa.array([s[0] for s in said], pa.string()), "lead": pa.array([s[1] for s in said], pa.string()), "given": pa.array([s[2] for s in said], pa.string())})


@dataclass
class Repaired:
    """``rows``: one row per distinct input row with its edits and repaired lines; ``summary``: one per conversation."""

    rows: DataFrame
    summary: DataFrame


def _key(conv_id: Column) -> Column:
    """Text that tells conversations apart, a null one included."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def repair(turns: DataFrame) -> Repaired:
    """Repair every conversation of ``turns`` (conv_id, turn, role, text, and copies where a row stands for several).

    Rows are read by turn, nulls first, then by role and text; a null role or text is one space, a null conv_id a
    conversation of its own. Repeated rows count each, extra columns are not read, an empty table gives nothing.

    ``summary``: conv_id, ck, gaps, blank, duplicate, truncated, illegal, cost. ``rows``: conv_id, ck, at (their order),
    turn, copies, edits (of all copies; insertions come before their row), lines (repaired ``role:text``, insertions
    first, null if none), and one row per conversation (turn null, copies 0) with what is inserted after its end.
    """
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    named = turns.select(_key(F.col("conv_id")).alias("ck"), "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copies.cast("long").alias("copies"))
    distinct = stage(named.groupBy("ck", "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    order = ["ck", F.col("turn").asc_nulls_first(), "role", "text"]
    proof = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    blank = ~F.col("text").rlike(WORD)
    broken = ~F.col("text").rlike(rf"[.!?]{SPACES}*\z")
    placed = distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stage(placed.withColumns({"proof": proof, "blank": blank, "broken": broken, "initial": F.substring("role", 1, 1)}), "placed")

    # Repeats: all but the first row of a role and text.
    light = placed.select("ck", "at", "turn", "copies", "proof", "blank", "broken", "initial")
    firsts = light.groupBy("ck", "proof").agg(F.min("at").alias("_first"))
    again = F.col("at") != F.col("_first")
    class_ = F.when(F.col("blank") | again, 0).otherwise(F.when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 3).when(F.col("initial") == "a", 5).otherwise(7) + F.col("broken").cast("int"))
    kinds = stage(light.join(firsts, ["ck", "proof"]).select("ck", "at", F.shiftright("at", BLOCK_BITS).alias("block"), "turn", "copies", "initial", "blank", (again & ~F.col("blank")).alias("again"), (F.col("broken") & ~F.col("blank")).alias("broken"), class_.alias("kind")), "kinds")
    rest = F.col("copies") - 1
    counts = kinds.groupBy("ck").agg(
        (F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(rest + F.col("again").cast("long"))).alias("duplicate"),
        F.sum(F.when(F.col("broken") & ~F.col("again"), 1).otherwise(0)).alias("truncated"),
        F.sum(rest).alias("_rest"),
    )

    # Up: stretches of a block, then groups of stretches until one is left a conversation.
    compact = kinds.select("ck", "at", "block", "kind", "initial")
    stretches = stage(compact.groupBy("block").applyInArrow(block_stretches, _STRETCH), "stretches")
    along = Window.partitionBy("ck").orderBy("block")
    numbered = stage(stretches.select("ck", "block", "element", "first", "illegal", F.lag("last").over(along).alias("_before"), (F.row_number().over(along) - 1).cast("long").alias("k")), "numbered")
    border = F.when(F.col("_before").isNull() | F.concat("_before", "first").isin(*_LEGAL), 0).otherwise(1)
    illegal = numbered.groupBy("ck").agg(F.sum(F.col("illegal") + border).alias("_illegal"))
    levels = [numbered.select("ck", "k", "element")]
    while (levels[-1].agg(F.max("k")).first()[0] or 0) > 0:
        many, alone = _grouped(levels[-1])
        whole = many.groupBy("ck", "up").applyInArrow(group_element, "ck string, k bigint, element array<bigint>")
        levels.append(stage(whole.unionByName(alone.select("ck", F.col("up").alias("k"), "element")), "level"))

    # Down: the state that a whole conversation ends in, and the crossings inside.
    ends = stage(levels[-1].select("ck", "k", "element").mapInArrow(_ends, "ck string, k bigint, entry int, leave int, cost bigint"), "ends")
    states = ends.select("ck", "k", "entry", "leave")
    for level in reversed(levels[:-1]):
        many, alone = _grouped(level)
        above = states.withColumnRenamed("k", "up")
        inside = many.groupBy("ck", "up").cogroup(above.join(many.select("ck", "up").distinct(), ["ck", "up"], "left_semi").groupBy("ck", "up")).applyInArrow(group_crossings, "ck string, k bigint, entry int, leave int")
        states = stage(inside.unionByName(alone.join(above, ["ck", "up"]).select("ck", "k", "entry", "leave")), "crossings")
    by_block = numbered.select("ck", "k", "block").join(states, ["ck", "k"]).select("ck", "block", "entry", "leave")
    edits = compact.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(block_edits, "ck string, at bigint, edits string, lead string, given string")

    said = F.when(F.col("edits").endswith("D"), F.rtrim(F.col("lead"), F.lit("\n"))).otherwise(F.concat("lead", F.coalesce("given", "role"), F.lit(":"), "text"))
    rows = placed.join(edits, ["ck", "at"]).select("conv_id", "ck", "at", "turn", "copies", F.concat("edits", F.repeat(F.lit("D"), (F.col("copies") - 1).cast("int"))).alias("edits"), F.when(F.col("edits") != "D", said).alias("lines"))
    ids = stage(placed.groupBy("ck").agg(F.first("conv_id").alias("conv_id")), "ids")
    tails = ends.join(ids, "ck").select("conv_id", "ck", F.lit((1 << 63) - 1).alias("at"), F.lit(None).cast(dict(turns.dtypes)["turn"]).alias("turn"), F.lit(0).cast("long").alias("copies"), F.element_at(F.array(*[F.lit(t) for t in TAIL]), F.col("leave") + 1).alias("edits"), F.when(F.col("leave") == 1, "user:\nassistant:").when(F.col("leave") == 2, "assistant:").alias("lines"))
    summary = counts.join(illegal, "ck").join(ends.select("ck", "cost"), "ck").join(ids, "ck")
    summary = summary.select("conv_id", "ck", F.coalesce(F.col("gaps").cast("long"), F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", F.col("truncated").cast("long").alias("truncated"), (F.col("_illegal") + F.col("_rest")).cast("long").alias("illegal"), (F.col("cost") + F.col("_rest") * DELETE).alias("cost"))
    return Repaired(rows.unionByName(tails), summary)


def _grouped(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of groups of several, and those alone in theirs, which take part in it as they are."""
    counted = level.withColumn("up", F.shiftright("k", BLOCK_BITS)).withColumn("_n", F.count("*").over(Window.partitionBy("ck", "up")))
    return counted.where("_n > 1").drop("_n"), counted.where("_n = 1").drop("_n")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        best = [best_leave(_unpack(e)) for e in rows.column("element").to_pylist()]
        yield pa.RecordBatch.from_pydict({"ck": rows.column("ck"), "k": rows.column("k"), "entry": pa.array([0] * len(best), pa.int32()), "leave": pa.array([s for _, s in best], pa.int32()), "cost": pa.array([c for c, _ in best], pa.int64())})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ck, audit, sha256 of the lines) of rows sorted by conversation; texts are hashed as they pass."""
    key, audit, found, some = None, [], None, False
    for rows in batches:
        out: list[tuple[str, str, str]] = []
        for ck, edits, lines in zip(*(rows.column(c).to_pylist() for c in ("ck", "edits", "lines"))):
            if found is None or ck != key:
                if found is not None:
                    out.append((key, "".join(audit), found.hexdigest()))
                key, audit, found, some = ck, [], hashlib.sha256(), False
            audit.append(edits)
            if lines is not None:
                found.update((("\n" if some else "") + lines).encode())
                some = True
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("ck", "audit", "repaired_sha256"), (pa.array(x, pa.string()) for x in zip(*out)))))
    if found is not None:
        yield pa.RecordBatch.from_pydict({"ck": pa.array([key]), "audit": pa.array(["".join(audit)]), "repaired_sha256": pa.array([found.hexdigest()])})


def digests(repaired: Repaired) -> DataFrame:
    """(ck, audit, repaired_sha256): the edits' initials of a conversation and the hash of its repaired text.

    A hash of one text is a sequence by nature: a conversation passes through one task in order, a row at a time.
    """
    rows = repaired.rows.select("ck", "at", "edits", "lines").repartition("ck").sortWithinPartitions("ck", "at")
    return rows.mapInArrow(_digest, "ck string, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by the crc32 of ``conv_id:turn`` (nulls: one space) modulo 20.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it (copies 2), 4 makes its role user.
    """
    space = F.lit(" ")
    pick = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), pick.alias("_pick")).where("_pick <> 0")
    text = F.when(F.col("_pick") == 1, "").when(F.col("_pick") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_pick") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_pick") == 3, 2).otherwise(1).alias("copies"))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``, damaged and repaired: counts of faults, cost, audit and hash of the repaired text.

    A conversation that has lost all its rows has zeros, an empty audit and the hash of an empty text.
    """
    done = repair(damaged(conversations))
    every = conversations.select("conv_id", _key(F.col("conv_id")).alias("ck")).groupBy("ck").agg(F.first("conv_id").alias("conv_id"))
    found = every.join(done.summary.drop("conv_id"), "ck", "left").join(digests(done), "ck", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair_sql() -> str:
    """DuckDB SQL of :func:`repaired_conversations` over ``conversations``: the four least (cost and audit, text) row by row."""

    def plus(s: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{s}.t" if line is None else f"coalesce({s}.t || chr(10), '') || {line}"
        return f"{{'k': lpad(cast(cast({s}.k[1:9] as integer) + {cost} as varchar), 9, '0') || {s}.k[10:] || '{letter}', 't': {text}}}"

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda z: z.k is not null))[1]"

    gone, kept = "d.must", "(not d.must)"
    row, more = "d.role || ':' || d.text", f"{BROKEN} * cast(d.broken as integer)"

    def unless(condition: str, way: str) -> str:
        return f"case when {condition} then {way} end"

    one = {"f0": "e0", "f1": "e1", "f2": least("e2", *[plus(e, str(INSERT), "I", "'user:'") for e in ("e0", "e1", "e3")]), "f3": least("e3", plus("e2", str(INSERT), "I", "'assistant:'"))}
    two = {"f0": "f0", "f1": "f1", "f2": least("f2", plus("f3", str(INSERT), "I", "'user:'")), "f3": least("f3", plus("f2", str(INSERT), "I", "'assistant:'"))}
    new = {s: [plus(s, str(DELETE), "D")] for s in ("f0", "f1", "f2", "f3")}
    for before, after, initial in (("f0", "f1", "s"), ("f0", "f2", "u"), ("f1", "f2", "u"), ("f3", "f2", "u"), ("f2", "f3", "a")):
        new[after].append(unless(f"{kept} and d.role[1:1] = '{initial}'", plus(before, more, "K", row)))
    for before, after, role in (("f0", "f2", "user"), ("f1", "f2", "user"), ("f3", "f2", "user"), ("f2", "f3", "assistant")):
        new[after].append(unless(kept, plus(before, f"{REROLE} + {more}", "R", f"'{role}:' || d.text")))
    select = lambda exprs, prefix="": ", ".join(f"{e} as {prefix}{s}" for s, e in exprs.items())
    return rf"""
with recursive crc as materialized (select list(v order by i) as t from (select i, list_reduce(range(0, 8), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(0, 256) r(i))),
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
picked as (select n.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: cast(unicode(x) as bigint)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as pick from named n, crc),
broken as (select conv_id, turn, case when pick = 4 then 'user' else role end as role, case pick when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from picked join range(0, 2) r(c) on r.c < case when pick = 3 then 2 else 1 end where pick <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn from broken),
faults as materialized (select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by rn) > 1 as again, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as open_end,
  lag(role[1:1]) over (partition by conv_id order by rn) || role[1:1] as neighbours from numbered),
kinds as materialized (select conv_id, rn, role, text, blank or again as must, open_end and not blank and not again as broken from faults),
dp as (
  select conv_id, cast(0 as bigint) as rn, {{'k': '000000000', 't': cast(null as varchar)}} as e0, cast(null as struct(k varchar, t varchar)) as e1, cast(null as struct(k varchar, t varchar)) as e2, cast(null as struct(k varchar, t varchar)) as e3 from (select distinct conv_id from kinds)
  union all
  select conv_id, rn, {', '.join(f"{least(*new[f'f{s}'])} as e{s}" for s in range(4))}
  from (select conv_id, rn, role, text, must, broken, {select(two)} from (select d.conv_id, d.rn, d.role, d.text, d.must, d.broken, {select(one)} from dp join kinds d on d.conv_id is not distinct from dp.conv_id and d.rn = dp.rn + 1) one_more) d),
ended as (select conv_id, {least("e0", "e3", plus("e2", str(INSERT), "I", "'assistant:'"), plus("e1", str(2 * INSERT), "II", "'user:' || chr(10) || 'assistant:'"))} as best from dp qualify row_number() over (partition by conv_id order by rn desc) = 1),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate, count(*) filter (open_end and not blank and not again) as truncated,
  count(*) filter (neighbours not in ('su', 'ua', 'au')) as illegal from faults group by conv_id)
select i.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal,
  cast(coalesce(cast(best.k[1:9] as integer), 0) as bigint) as cost, coalesce(best.k[10:], '') as audit, sha256(coalesce(best.t, '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join counts c on c.conv_id is not distinct from i.conv_id left join ended e on e.conv_id is not distinct from i.conv_id"""
