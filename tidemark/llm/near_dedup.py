"""Near-duplicate documents: MinHash signatures joined through an inverted index of their coordinates.

A document is its set of distinct ``shingle``-word shingles. Two documents are linked when
100 * |A and B| >= percent * |A or B|; a component is what links connect.

1. *Signatures.* Texts with equal sets are one class. Each class has ``coordinates`` MinHash values;
   a coordinate and its value make one token, so a pair's collisions are the tokens it has in common.
2. *Posting lists, prefix and skip.* Tokens of one class only are skipped, and with them every class
   that has fewer than ``matches`` tokens left: it cannot collide ``matches`` times with any other.
   Classes that reach it post only their rarest tokens, all but ``matches - 1`` of them: a pair that
   collides often enough meets in one of these lists, and the long lists are passed over.
3. *Support.* Only shingles that occur in another candidate can be common to a pair. The full sets of
   the candidates are built again from their texts and those shingles counted; a class leaves when they
   are too few for any link, and a pair is passed over when they are too few for its two sizes.
4. *Leaders.* Each list is compared with two of its members instead of all pairs within it, the
   one with most tokens in common with others (the least edited copy) and one by hash. Collisions
   are counted on whole signatures, and links confirmed on full sets.
5. *The rest, exactly.* Lists whose members are now in one component are done. Members of the others
   are met again by prefixes of their full sets: a link has percent % of either set in common, so
   the pair shares one of the rarest shingles of both, all but percent % of the set. Shingles of one
   component alone cannot be shared across and come first, and what is left of both sets after a
   shared shingle must suffice, so copies with edits of their own do not meet in the common text. Only pairs of different components are compared.

No group is gathered in one task: lists are joined with staged tables, never with an aggregation by
the same key, so Spark can split a hot list. The chance that a link of exactly 0.85 has under 42 of 64 collisions
is about 2e-5, and falls fast above that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, list_array, mix, runs, words
from tidemark.staging import stage

SHINGLE, PERCENT, COORDINATES, MATCHES = 5, 85, 64, 42

_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row of a run."""
    w = words(offsets, data)
    n = len(w.hash)
    whole = np.zeros(0, np.uint64)
    if n >= size:
        whole = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            whole += w.hash[k : n - size + 1 + k] * _WEIGHTS[k]
        whole = mix(whole)
    for row in range(len(offsets) - 1):
        a, b = w.first[row], w.first[row + 1]
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        elif b > a:
            yield mix((w.hash[a:b] * _WEIGHTS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signature(values: np.ndarray, coordinates: int) -> np.ndarray:
    """Tokens: the least of each coordinate's permutation of the set, told apart by coordinate."""
    seed = np.arange(coordinates, dtype=np.uint64)
    a, b = mix(seed * np.uint64(2) + np.uint64(101)) | np.uint64(1), mix(seed + np.uint64(7001))
    least = np.full(coordinates, ~np.uint64(0))
    for lo in range(0, len(values), 4096):
        np.minimum(least, (values[lo : lo + 4096, None] * a + b).min(axis=0), out=least)
    return mix(least + b)


def _sign(size: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for rows in batches:
            schema = schema or pa.schema([rows.schema.field("doc_id"), ("tkey", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("proof", pa.int64()), ("tokens", pa.list_(pa.int64()))])
            for lo, hi, offsets, data in runs(rows.column("text")):
                n, cls, proof, tokens = [], [], [], []
                for values in shingle_sets(offsets, data, size):
                    raw = values.tobytes()
                    n.append(len(values))
                    cls.append(xxhash.xxh3_64_intdigest(raw, seed=1))
                    proof.append(xxhash.xxh3_64_intdigest(raw, seed=2))
                    tokens.append(signature(values, coordinates) if len(values) else values)
                yield batch(
                    schema,
                    doc_id=rows.column("doc_id").slice(lo, hi - lo),
                    tkey=rows.column("tkey").slice(lo, hi - lo),
                    n=n,
                    cls=np.array(cls, np.uint64).view(np.int64),
                    proof=np.array(proof, np.uint64).view(np.int64),
                    tokens=list_array(np.concatenate(tokens).view(np.int64), np.array([len(x) for x in tokens]), pa.int64()),
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cls", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for rows in batches:
            for lo, hi, offsets, data in runs(rows.column("text")):
                found = list(shingle_sets(offsets, data, size))
                yield batch(schema, cls=rows.column("cls").slice(lo, hi - lo), shingles=list_array(np.concatenate(found).view(np.int64), np.array([len(x) for x in found]), pa.int64()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (a, b) edges; the component is its least node.

    Every round takes the least label around a node and then follows that label's own label, so
    the number of rounds is logarithmic in practice. Rounds are staged, so a lost executor costs
    one round at most.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    labels = stage(labels, "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("component")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        nearest = stage(labels.join(around, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_mid")), "nearest")
        jumped = nearest.join(nearest.select(F.col("node").alias("_mid"), F.col("_mid").alias("_far")), "_mid").select("node", F.least("_mid", "_far").alias("component"), "_old")
        jumped = stage(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where("component <> _old").isEmpty():
            return labels


def _confirm(pairs: DataFrame, held: DataFrame, percent: int, matches: int) -> DataFrame:
    """Pairs with enough collisions whose full sets are similar enough."""
    left = held.select(F.col("cls").alias("a"), F.col("tokens").alias("_ta"), F.col("shingles").alias("_sa"))
    right = held.select(F.col("cls").alias("b"), F.col("tokens").alias("_tb"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    enough = both * (100 + percent) >= F.lit(percent) * (F.size("_sa") + F.size("_sb"))
    linked = F.when(F.size(F.array_intersect("_ta", "_tb")) >= matches, enough).otherwise(False)
    return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b")


def _may_link(x: Column, y: Column, percent: int) -> Column:
    """Whether two classes, given as structs of n and support, can be similar enough: no more than either's support is common."""
    most = F.least(x["support"], y["support"])
    return most * (100 + percent) >= (x["n"] + y["n"]) * percent


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, keys: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that links reach, ``kept`` tells whether it is the row's own.
    Empty and null texts have no shingles and are alone. Rows with equal sets are one class, so repeated
    rows share their answer. A null doc_id is never a component's id if another row has one; a component
    of null ids only has a null id and is kept. With ``keys`` a row also has ``text_key``, the xxhash64 of its text,
    and ``class_id``, which rows with equal sets share. Other columns are not read.
    """
    source = docs.select("doc_id", "text").withColumn("tkey", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stage(source.mapInArrow(_sign(shingle, coordinates), f"doc_id {kind}, tkey bigint, n bigint, cls bigint, proof bigint, tokens array<bigint>"), "signed")
    full = signed.where("n > 0")
    nodes = stage(
        full.groupBy("cls").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "tkey")).alias("_where"), F.first("tokens").alias("tokens"), F.min("proof").alias("_p"), F.max("proof").alias("_q")),
        "classes",
    )
    if not nodes.where("_p <> _q").isEmpty():
        raise ValueError("two shingle sets share a 64-bit class id")

    # Lists of two classes or more; classes that keep enough of their tokens in them.
    posts = nodes.select("cls", "n", F.explode("tokens").alias("token"))
    lists = stage(posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "lists")
    shared = posts.join(lists, "token").groupBy("cls").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("_posts")).where(F.size("_posts") >= matches)
    able = stage(shared.select("cls", "n", "_posts"), "able")

    # Full sets of the candidates, from one text of each class.
    wanted = able.join(nodes.select("cls", "_where", "tokens"), "cls").select("cls", "tokens", F.col("_where.doc_id").alias("_id"), F.col("_where.tkey").alias("_key"))
    texts = wanted.join(source, F.col("_key").eqNullSafe(F.col("tkey")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("cls", "text")
    sets = texts.mapInArrow(_sets(shingle), "cls bigint, shingles array<bigint>").dropDuplicates(["cls"])
    held = stage(sets.join(wanted.select("cls", "tokens"), "cls"), "sets")

    # Support: shingles that two candidates have.
    each = held.select("cls", F.explode("shingles").alias("_s"))
    common = stage(each.groupBy("_s").agg(F.count("*").alias("_df")).where("_df > 1").select("_s"), "common")
    support = each.join(common, "_s").groupBy("cls").agg(F.count("*").alias("_common"))
    lasting = able.join(support, "cls").where(F.col("_common") * 100 >= F.col("n") * percent)
    prefix = F.expr(f"slice(_posts, 1, size(_posts) - {matches - 1})")
    posted = stage(lasting.select("cls", F.struct("n", F.col("_common").alias("support")).alias("size"), F.size("_posts").alias("_weight"), F.explode(F.transform(prefix, lambda x: x["token"])).alias("token")), "posted")

    # Each list beside two of its members.
    leading = posted.groupBy("token").agg(F.max(F.struct("_weight", F.xxhash64("cls"), "cls", "size")).alias("_x"), F.max(F.struct(F.xxhash64("cls"), "cls", "size")).alias("_y"))
    leading = stage(leading.select("token", F.explode(F.array_distinct(F.array(F.struct("_x.cls", "_x.size"), F.struct("_y.cls", "_y.size")))).alias("_l")), "leading")
    beside = posted.join(leading, "token").where((F.col("cls") != F.col("_l.cls")) & _may_link(F.col("size"), F.col("_l.size"), percent))
    tried = stage(_ordered(beside, F.col("cls"), F.col("_l.cls")), "tried")
    links = stage(_confirm(tried, held, percent, matches), "found")
    labels = components(links)

    # Members of lists that still hold several components: pairs across them that share one of the
    # rarest shingles of either, as many as a link cannot do without, but for those tried.
    placed = posted.join(labels, posted["cls"] == labels["node"], "left").select("token", "cls", "size", F.coalesce("component", "cls").alias("component"))
    split = stage(placed.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("token"), "split")
    unsettled = stage(placed.join(split, "token").groupBy("cls").agg(F.first("component").alias("component")), "open")
    each = held.join(unsettled, "cls").select("cls", "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("_s"))
    across = each.groupBy("_s").agg(F.count("*").alias("_df"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("_s", "_df")
    across = stage(across, "across")
    ranked = each.join(across, "_s").groupBy("cls").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("_df", "_s"))).alias("_ranked"))
    ranked = ranked.withColumn("_reach", F.expr(f"size(_ranked) - (n * {percent} + 99) div 100 + 1")).where("_reach > 0")
    first = ranked.select("cls", "component", "n", F.size("_ranked").alias("_all"), F.posexplode(F.expr("transform(slice(_ranked, 1, int(_reach)), x -> x._s)")).alias("_at", "_s"))
    # From its first common shingle on, a pair has no more in common than either has left.
    first = stage(first.select("cls", "component", "_s", F.struct("n", (F.col("_all") - F.col("_at")).cast("long").alias("support")).alias("size")), "rarest")
    other = first.select("_s", F.col("cls").alias("_c"), F.col("size").alias("_size"), F.col("component").alias("_k"))
    across = first.join(other, "_s").where((F.col("cls") < F.col("_c")) & (F.col("component") != F.col("_k")) & _may_link(F.col("size"), F.col("_size"), percent))
    untried = _ordered(across, F.col("cls"), F.col("_c")).join(tried, ["a", "b"], "left_anti")
    late = stage(_confirm(untried, held, percent, matches), "found")
    if not late.isEmpty():
        labels = components(links.union(late))

    # Back to rows: the least doc_id of each component.
    rows = signed.select("doc_id", "n", "cls", "tkey").join(labels, F.col("cls") == F.col("node"), "left").select("doc_id", "n", "cls", "tkey", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("_component"))
    least = stage(rows.where("n > 0").groupBy("_component").agg(F.min("doc_id").alias("_least")), "least")
    out = rows.join(least, "_component", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *([F.col("tkey").alias("text_key"), F.col("cls").alias("class_id")] if keys else []))


def _ordered(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
