"""Near-duplicate vectors: all pairs within a label above a cosine, by dual traversal of a cover tree.

Of unit vectors a cosine is a distance, and a distance has triangles: two nodes whose centres are further
apart than the distance looked for and both covering radii have no pair between them, and two nodes that
lie wholly within it are linked each with each. The first are dropped and the second counted as wholes, so
only what straddles the threshold is compared vector by vector, by cosine in double precision.

1. *Vectors.* Equal vectors of a label are one class with a count.
2. *Top of the tree.* A cell with more classes than a task should hold is split round by round: every
   member joins the nearest of a few of its cell's members, and the cell's covering radius is measured.
   Cells that no longer split (near copies in thousands) are dealt out by hash under the same centre.
3. *Blocks.* A cell that is small enough is a block, and gets the rest of the tree in one task: nested
   levels of centres with halving radii, kept as one list of centres per vector.
4. *Traversal.* Pairs of cells go down the top of the tree round by round, pruned by the bounds. The pairs
   of blocks that are left are spread over the cluster, and each goes on down the levels of its two trees.

A task gives one count and one link to a representative per vector, never its pairs, so a group of many
copies costs its members, not their pairs. Vectors of which no bound holds are compared all with all of
their label, as any exact join must where nothing is near or far enough, but in blocks and in matrices.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.near_dedup import components
from tidemark.staging import stage

COSINE, BLOCK, FAN = 0.93, 1024, 32
#: Radii of the nested levels below a block, halved from one to the next.
RADII = tuple(2.0**-k for k in range(6))
#: Bounds hold with this much room for rounding; what lies closer is compared itself.
ROOM = 1e-6


def _matrix(table: pa.Table) -> np.ndarray:
    """Vectors as rows of doubles, scaled by powers of two, which changes no cosine and keeps squares finite."""
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(table.num_rows, -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ v.T)))


def to_nearest(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """Rows of a cell, each in the child of its nearest anchor, with the distance."""
    kept = rows.select(["key", "m", "vector", "root"])
    apart = _distances(_unit(_matrix(rows)), _unit(_matrix(anchors))) if rows.num_rows else np.zeros((0, 1))
    near = apart.argmin(axis=1) if rows.num_rows else np.zeros(0, np.int64)
    cell = rows.column("cell").to_pylist()
    names = anchors.column("child").to_pylist()
    return kept.append_column("parent", pa.array(cell, pa.string())).append_column("cell", pa.array([names[i] for i in near], pa.string())).append_column("apart", pa.array(apart[np.arange(rows.num_rows), near], pa.float64()))


def cover_levels(u: np.ndarray) -> np.ndarray:
    """(vectors, levels): the centre of each vector on every level; centres of a level are centres of all below it."""
    n = len(u)
    apart = _distances(u, u)
    path = np.zeros((n, len(RADII)), np.int32)
    above = np.zeros(n, np.int64)
    for level, radius in enumerate(RADII):
        order = np.argsort(above, kind="stable")
        heads = np.flatnonzero(np.append(True, above[order][1:] != above[order][:-1]))
        for members in np.split(order, heads[1:]):
            centre, open_ = above[members[0]], members
            while len(open_):
                inside = apart[centre, open_] <= radius
                inside |= open_ == centre
                path[open_[inside], level] = centre
                open_ = open_[~inside]
                centre = open_[0] if len(open_) else centre
        above = path[:, level].astype(np.int64)
    return path


def block_tree(rows: pa.Table) -> pa.Table:
    path = cover_levels(_unit(_matrix(rows)))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(path) + 1, dtype=np.int32) * len(RADII)), pa.array(path.ravel(), pa.int32()))
    return rows.select(["key", "m", "vector", "cell"]).append_column("at", pa.array(np.arange(len(path)), pa.int32())).append_column("path", lists)


class _Side:
    """The tree of a block inside a traversal."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("at")
        self.keys = rows.column("key").to_pylist()
        self.x, self.m = _matrix(rows), rows.column("m").to_numpy()
        self.u, n = _unit(self.x), rows.num_rows
        path = rows.column("path").combine_chunks().flatten().to_numpy().reshape(n, -1)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.levels = []
        for level in range(path.shape[1]):
            centres, node = np.unique(path[:, level], return_inverse=True)
            reach, weight = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
            gap = self.u - self.u[path[:, level]]
            np.maximum.at(reach, node, np.sqrt((gap * gap).sum(axis=1)))
            np.add.at(weight, node, self.m)
            self.levels.append((centres, node, reach, weight))
        # Children of a node: nodes of the next level, and at the end the vectors.
        self.children = []
        for level, (centres, node, _, _) in enumerate(self.levels):
            below = self.levels[level + 1][0] if level + 1 < len(self.levels) else np.arange(n)
            parent = node[below]
            order = np.argsort(parent, kind="stable")
            self.children.append((order, np.searchsorted(parent[order], np.arange(len(centres) + 1))))


def _product(left: tuple, right: tuple, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (child of p, child of q) of node pairs."""
    (lo, ls), (ro, rs) = left, right
    nl, nr = ls[p + 1] - ls[p], rs[q + 1] - rs[q]
    size = nl * nr
    pair = np.repeat(np.arange(len(p)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return lo[ls[p][pair] + k // nr[pair]], ro[rs[q][pair] + k % nr[pair]]


def _least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def traverse(rows: pa.Table, others: pa.Table, cosine: float) -> pa.Table:
    """(key, links, leader) of the vectors of two blocks that have links between them; no others means with itself."""
    a = _Side(rows)
    same = others.num_rows == 0
    b = a if same else _Side(others)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    na, nb = len(a.keys), 0 if same else len(b.keys)
    links_a, links_b = np.zeros(na, np.int64), np.zeros(len(b.keys), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    virtual = na + nb  # one more vertex for every node that is linked as a whole
    p, q = (z.ravel() for z in np.meshgrid(np.arange(len(a.levels[0][0])), np.arange(len(b.levels[0][0])), indexing="ij"))
    for level in range(len(RADII)):
        (ca, node_a, ra, wa), (cb, node_b, rb, wb) = a.levels[level], b.levels[level]
        apart = _distances(a.u[ca], b.u[cb])[p, q]
        bound = ra[p] + rb[q]
        whole = apart + bound <= reach - ROOM
        part = ~whole & (apart - bound <= reach + ROOM)
        if whole.any():
            wp, wq = p[whole], q[whole]
            to_a, to_b = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64)
            np.add.at(to_a, wp, wb[wq])
            np.add.at(to_b, wq, wa[wp])
            links_a += to_a[node_a]
            links_b += to_b[node_b]
            in_a, in_b = to_a[node_a] > 0, to_b[node_b] > 0
            edges.append((np.flatnonzero(in_a), virtual + node_a[in_a]))
            edges.append(((0 if same else na) + np.flatnonzero(in_b), virtual + len(ca) + node_b[in_b]))
            edges.append((virtual + wp, virtual + len(ca) + wq))
            virtual += len(ca) + len(cb)
        p, q = _product(a.children[level], b.children[level], p[part], q[part])
    for lo in range(0, len(p), 1 << 16):
        i, j = p[lo : lo + (1 << 16)], q[lo : lo + (1 << 16)]
        linked = (a.x[i] * b.x[j]).sum(axis=1) / (a.norm[i] * b.norm[j]) >= cosine
        i, j = i[linked], j[linked]
        np.add.at(links_a, i, b.m[j])
        np.add.at(links_b, j, a.m[i])
        edges.append((i, (0 if same else na) + j))
    if same:
        links_a, keys = links_a - a.m, a.keys  # each vector met itself once
    else:
        links_a, keys = np.concatenate([links_a, links_b]), a.keys + b.keys
    i, j = (np.concatenate(z) for z in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
    label = _least_labels(virtual, i, j)[: na + nb]
    some = np.flatnonzero(links_a > 0)
    return pa.table({"key": pa.array([keys[k] for k in some], pa.string()), "links": pa.array(links_a[some], pa.int64()), "leader": pa.array([keys[k] for k in label[some]], pa.string())})


def _top_of_tree(classes: DataFrame, block: int, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """Classes with the cell each ends in, and per round the cells made: (cell, parent, root, centre, radius)."""
    done: list[DataFrame] = []
    made: list[DataFrame] = []
    open_ = classes.withColumn("cell", F.col("root")).withColumn("parent", F.lit("")).withColumn("apart", F.lit(2.0))
    parents = classes.groupBy(F.col("root").alias("cell")).agg(F.count("*").alias("n")).withColumns({"was": F.col("n") + 1, "radius": F.lit(2.0)})
    while True:
        # Cells that fit are blocks. Those that did not split, or are too tight to, are dealt out by hash.
        fits, stuck = F.col("n") <= block, (F.col("n") == F.col("was")) | (F.col("radius") <= RADII[-1])
        state = stage(parents.select("cell", "n", fits.alias("fits"), (~fits & stuck).alias("stuck")), "cells")
        rows = open_.join(state, "cell")
        piece = F.concat_ws("#", "cell", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / block)).cast("string"))
        columns = ["key", "m", "vector", "root"]
        done.append(rows.where("fits").select(*columns, "cell"))
        done.append(rows.where("stuck").select(*columns, piece.alias("cell")))
        if made:
            pieces = made[-1].join(state.where("stuck"), "cell").select(F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1), lambda i: F.concat_ws("#", "cell", i.cast("string")))).alias("_piece"), "cell", "root", "centre", "radius")
            made.append(stage(pieces.select(F.col("_piece").alias("cell"), F.col("cell").alias("parent"), "root", "centre", "radius"), "pieces"))
        large = rows.where("not fits and not stuck")
        wide = stage(large.select(*columns, "cell", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / (4 * block))).alias("salt"), "n"), "wide")
        if wide.isEmpty():
            return _union(done), made
        # A few members by hash: of four times as many expected, the least.
        draw = F.xxhash64("key", "cell")
        few = F.least(F.lit(fan), F.ceil(2 * F.col("n") / block))
        sample = wide.where(F.pmod(draw, F.col("n")) < 4 * fan).groupBy("cell").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.slice(F.array_sort(F.collect_list(F.struct(draw.alias("_d"), "key", "vector"))), 1, fan).alias("_all"))
        anchors = stage(sample.select("cell", "n", "root", F.posexplode(F.slice("_all", F.lit(1), few.cast("int"))).alias("_i", "_anchor")).select("cell", "n", "root", F.concat_ws(".", "cell", F.col("_i").cast("string")).alias("child"), F.col("_anchor.vector").alias("vector")), "anchors")
        spread = anchors.select("cell", "child", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / (4 * block)) - 1)).alias("salt"))
        kinds = dict(wide.dtypes)
        assigned = wide.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInArrow(to_nearest, f"key string, m bigint, vector {kinds['vector']}, root string, parent string, cell string, apart double")
        open_ = stage(assigned, "assigned")
        sizes = wide.groupBy(F.col("cell").alias("parent")).agg(F.first("n").alias("was"))
        parents = stage(open_.groupBy("cell", "parent").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).join(sizes, "parent"), "children")
        made.append(stage(parents.join(anchors.select(F.col("child").alias("cell"), "root", F.col("vector").alias("centre")), "cell").select("cell", "parent", "root", "centre", "radius"), "nodes"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _may_meet(a: Column, b: Column, reach: float) -> Column:
    """Whether two cells can have a pair between them; a root has no centre and always can."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    va, vb = (F.transform(c["centre"], lambda x: x.cast("double")) for c in (a, b))
    cosine = F.aggregate(F.zip_with(va, vb, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x) / (length(va) * length(vb))
    apart = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * cosine))
    return F.coalesce(apart <= a["radius"] + b["radius"] + (reach + ROOM), F.lit(True))


def _block_pairs(roots: DataFrame, made: list[DataFrame], reach: float) -> DataFrame:
    """(a, b) of blocks, each pair once, after going down the top of the tree."""
    if not made:
        return roots.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    kind = dict(made[0].dtypes)["centre"]
    nodes = _union([roots.select("cell", F.lit("").alias("parent"), F.lit(None).cast(kind).alias("centre"), F.lit(2.0).alias("radius"))] + [x.select("cell", "parent", "centre", "radius") for x in made])
    inner = nodes.select(F.col("parent").alias("cell")).distinct()
    leaves = nodes.join(inner, "cell", "left_anti")
    kids = stage(nodes.where("parent <> ''").select("parent", "cell", F.struct("centre", "radius").alias("ball")).unionByName(leaves.select(F.col("cell").alias("parent"), "cell", F.struct("centre", "radius").alias("ball"))), "kids")
    pairs = roots.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    for _ in made:
        left = kids.select(F.col("parent").alias("a"), F.col("cell").alias("_a"), F.col("ball").alias("_x"))
        right = kids.select(F.col("parent").alias("b"), F.col("cell").alias("_b"), F.col("ball").alias("_y"))
        down = pairs.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("_a") <= F.col("_b")))
        pairs = stage(down.where(_may_meet(F.col("_x"), F.col("_y"), reach)).select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")), "cellpairs")
    return pairs


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows of equal label and dimension with a cosine of at least ``cosine``,
    ``component_id`` is the least vec_id that links reach, ``kept`` whether it is the row's own. Rows with a
    null label, and vectors that are null, empty, zero or hold a null or non-finite component, have no links.
    Repeated rows are rows of their own and linked; a null vec_id is a component's id only if it has no other.
    Other columns are not read, an empty table gives no rows.
    """
    value = F.col("embedding")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))
    root = F.concat_ws("|", F.col("label").cast("string"), F.size(value).cast("string"))
    key = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), "label", "embedding")), 16, "0") for seed in (1, 2)])
    rows = stage(vectors.select("vec_id", F.when(able, key).alias("key"), root.alias("root"), F.col("embedding").alias("vector")), "vectors")
    classes = stage(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("m"), F.first("vector").alias("vector"), F.first("root").alias("root")), "vclasses")
    roots = stage(classes.select(F.col("root").alias("cell")).distinct(), "roots")
    placed, made = _top_of_tree(classes, block, fan)
    kind = dict(classes.dtypes)["vector"]
    blocks = stage(placed.select("key", "m", "vector", "cell").groupBy("cell").applyInArrow(block_tree, f"key string, m bigint, vector {kind}, cell string, at int, path array<int>"), "blocks")
    pairs = stage(_block_pairs(roots, made, math.sqrt(max(0.0, 2.0 - 2.0 * cosine))), "blockpairs")
    left = pairs.join(blocks, pairs["a"] == blocks["cell"]).drop("cell")
    other = pairs.where("a <> b").join(blocks, F.col("b") == F.col("cell")).drop("cell")
    right = other.select(*[F.col(c).alias(c) for c in left.columns])  # columns of its own, so that the two sides can be told apart
    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(partial(traverse, cosine=cosine), "key string, links bigint, leader string")
    found = stage(met, "vlinks")
    counts = found.groupBy("key").agg(F.sum("links").alias("_links"))
    labels = components(found.where("key <> leader").select(F.col("key").alias("a"), F.col("leader").alias("b")))
    known = classes.select("key", "m").join(counts, "key", "left").join(labels.select(F.col("node").alias("key"), F.col("component")), "key", "left")
    known = known.select("key", (F.col("m") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("component"))
    joined = rows.select("vec_id", "key").join(known, "key", "left")
    least = stage(joined.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("_least")), "least")
    out = joined.join(least, "component", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("key").isNotNull(), F.col("_least")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def near_vectors_sql(cosine: float = COSINE) -> str:
    """DuckDB SQL of :func:`near_vectors` over ``embeddings``: all pairs of a label, then what links reach."""
    return f"""
with recursive able as materialized (select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from able a join able b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {cosine}),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a),
counted as (select a, count(*) as n from links group by a)
select v.vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, v.vec_id = component_id as kept from embeddings v join least on least.a = v.vec_id left join counted on counted.a = v.vec_id"""
