r"""Substring dedup by hashing small units of text.

A text is cut after every line end, after the white space that follows . ! or ?, and before a
capitalised word that follows a blank: sentence-sized units, so that a passage is found wherever in
a line it stands. Units are compared without case and punctuation. Of equal units the earliest in
(doc_id, place) order stays. Others are removed where an unbroken run of them has ``min_words`` words,
so that short phrases which texts share by chance are left alone.

Only digests are grouped: 8 bytes a unit and the place, joined back so that Spark can split a unit
that a third of all texts hold. Places of removed units return to their texts by one join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, list_array
from tidemark.staging import stage

MIN_WORDS = 25
_MARK = "\x01"
_CUT = regex.compile(r"\n|[.!?][ \t]+|[ \t](?=\p{Lu}\p{Ll})")
_NOISE = regex.compile(r"[^\p{L}\p{N}\x01]+")
_EMPTY = np.zeros(0, np.int64)


def pieces(text: str) -> tuple[list[str], list[str]]:
    """Units of a text, which give the text when joined (U+0001 counts as a blank), and what is compared of each."""
    marked = _CUT.sub("\\g<0>" + _MARK, text.replace(_MARK, " "))
    return marked.split(_MARK), [x.strip() for x in _NOISE.sub(" ", marked.lower()).split(_MARK)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    for rows in batches:
        schema = schema or pa.schema([rows.schema.field("doc_id"), rows.schema.field("tkey"), ("units", pa.list_(pa.int64()))])
        found = []
        for text in rows.column("text"):
            found.append(np.array([xxhash.xxh3_64_intdigest(x) for x in pieces(text.as_py() or "")[1] if x], dtype=np.uint64).view(np.int64))
        yield batch(schema, doc_id=rows.column("doc_id"), tkey=rows.column("tkey"), units=list_array(np.concatenate(found or [_EMPTY]), np.array([len(x) for x in found], np.int64), pa.int64()))


def _cut(text: str, repeated: list[int] | None, min_words: int) -> tuple[str, list[dict[str, int]], int, int]:
    if not repeated:
        return text, [], 0, 0
    raw, normal = pieces(text)
    held = [i for i, x in enumerate(normal) if x]
    again = set(repeated)
    spans, gone, run, removed = [], set(), [], 0
    starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).tolist()
    for place in range(len(held) + 1):
        if place < len(held) and place in again:
            run.append(held[place])
        elif run:
            if sum(normal[i].count(" ") + 1 for i in run) >= min_words:
                spans.append({"start": starts[run[0]], "end": starts[run[-1] + 1]})
                gone.update(range(run[0], run[-1] + 1))
                removed += len(run)
            run = []
    return ("".join(x for i, x in enumerate(raw) if i not in gone) if gone else text), spans, len(again), removed


def _rewrite(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for rows in batches:
            keep = [f for f in rows.schema if f.name != "_again"]
            schema = schema or pa.schema([*keep, ("_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("_n_repeated", pa.int64()), ("_n_removed", pa.int64())])
            texts, again = rows.column("text"), rows.column("_again")
            if pc.all(pc.is_null(again)).as_py():
                done = [(None, [], 0, 0)] * len(rows)
                new = texts
            else:
                done = [_cut(t.as_py() or "", a.as_py(), min_words) for t, a in zip(texts, again, strict=True)]
                new = pc.if_else(pc.is_null(again), texts, pa.array([d[0] for d in done], texts.type))
            extra = {"_spans": [d[1] for d in done], "_n_repeated": [d[2] for d in done], "_n_removed": [d[3] for d in done]}
            yield batch(schema, **{f.name: new if f.name == "text" else rows.column(f.name) for f in keep}, **extra)

    return run


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with repeated runs cut out of ``text``.

    Adds ``_spans``: code point offsets [start, end) in the original text of what was removed, ``_n_repeated``:
    units that stand earlier elsewhere, and ``_n_removed``. Rows with the same doc_id and text are one document
    and are cut alike; null ids rank last. Null and empty texts have no units and stay as they are; a
    text may become empty. Columns of these three names, or _again and _tkey, are refused.
    """
    clash = {"_spans", "_n_repeated", "_n_removed", "_again", "_tkey"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = stage(docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(_digests, f"doc_id {kind}, tkey bigint, units array<bigint>"), "units")
    places = listed.select(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tkey").alias("_row"), F.posexplode("units").alias("_place", "_unit"))
    # Staged, so that the join below has two plain inputs: Spark can then split a hot unit, which it
    # cannot where one input is the aggregation by the same key.
    firsts = stage(places.groupBy("_unit").agg(F.count("*").alias("_times"), F.min(F.struct("_row", "_place")).alias("_first")).where("_times > 1").select("_unit", "_first"), "firsts")
    later = places.join(firsts, "_unit").where(F.struct("_row", "_place") != F.col("_first"))
    again = later.groupBy("_row").agg(F.collect_set("_place").alias("_again")).select(F.col("_row.doc_id").alias("_id"), F.col("_row.tkey").alias("_tk"), "_again")
    marked = docs.withColumn("_tkey", F.xxhash64("text"))
    joined = marked.join(again, (F.col("_tkey") == F.col("_tk")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(*docs.columns, "_again")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(_rewrite(min_words), f"{fields}, _spans array<struct<start: bigint, end: bigint>>, _n_repeated bigint, _n_removed bigint")


def dedup_units_sql(min_words: int = MIN_WORDS) -> str:
    """doc_id, n_repeated, n_removed, removed_chars, spans and clean_sha256 as DuckDB SQL."""
    return rf"""
with marked as (select doc_id, text, regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '(\n|[.!?][ \t]+)', '\1' || chr(1), 'g'), '([ \t])(\p{{Lu}}\p{{Ll}})', '\1' || chr(1) || '\2', 'g') as m from documents),
cut as (select doc_id, unnest(range(0, len(string_split(m, chr(1))))) as i, unnest(string_split(m, chr(1))) as raw, unnest(list_transform(string_split(regexp_replace(lower(m), '[^\p{{L}}\p{{N}}\x01]+', ' ', 'g'), chr(1)), lambda x: trim(x))) as normal from marked),
placed as (select *, coalesce(sum(length(raw)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as s from cut),
held as (select doc_id, i, raw, normal, s, row_number() over (partition by doc_id order by i) as place from placed where normal <> ''),
later as (select * from held qualify row_number() over (partition by normal order by doc_id, place) > 1),
islands as (select *, place - row_number() over (partition by doc_id order by place) as island, len(string_split(normal, ' ')) as nw from later),
runs as (select doc_id, island, min(i) as lo, max(i) as hi, count(*) as n, min(s) as s, max(s + length(raw)) as e from islands group by doc_id, island having sum(nw) >= {min_words}),
repeated as (select doc_id, count(*) as n from later group by doc_id),
removed as (select doc_id, sum(n) as n, sum(e - s) as chars, string_agg(s || '-' || e, ',' order by s) as spans from runs group by doc_id),
rest as (select p.doc_id, string_agg(p.raw, '' order by p.i) as t from placed p left join runs r on p.doc_id = r.doc_id and p.i between r.lo and r.hi where r.doc_id is null and p.doc_id in (select doc_id from removed) group by p.doc_id)
select d.doc_id, cast(coalesce(a.n, 0) as bigint) as n_repeated, cast(coalesce(r.n, 0) as bigint) as n_removed, cast(coalesce(r.chars, 0) as bigint) as removed_chars, coalesce(r.spans, '') as spans,
  case when r.doc_id is null then sha256(d.text) else sha256(coalesce(t.t, '')) end as clean_sha256
from documents d left join repeated a using (doc_id) left join removed r using (doc_id) left join rest t using (doc_id)"""
