"""Embedding near-duplicates by a random-projection tree forest.

Equal vectors are one class from here on. Each tree splits recursively at the median of a random
projection; vectors near a split go to both sides, so that close pairs stay together. The upper splits
are fitted on a bounded sample; leaves that hold too many vectors afterwards are split further by a
distributed quantile of the next projection, until none is too large. Every vector is compared within
its leaves, in double precision, and links are joined into components by alternating large-star and
small-star. A pair that meets in several leaves counts in the first of them only.

A dense group would be cut at random by every tree. So groups that show in the sample get centres first:
vectors linked with a centre are its core and leave the forest, and each is compared with all vectors within
twice the threshold's angle of the centre, which none of its links can lie outside, block against block.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, materialize
from .components import connected_components


def direction(seed: int, tree: int, node: int, dim: int) -> np.ndarray:
    """The projection at a node, drawn anew wherever it is needed."""
    return np.random.default_rng([seed, tree, node & 0x7FFFFFFF, node >> 31, dim]).standard_normal(dim)


class Tree:
    """Splits of one tree over vectors of one dimension: node -> (low, high) ends of its overlap."""

    def __init__(self, seed: int, tree: int, dim: int):
        self.seed, self.tree, self.dim = seed, tree, dim
        self.splits: dict[int, tuple[float, float]] = {}

    def fit(self, sample: np.ndarray, share: float, leaf: int, spill: float) -> Tree:
        """share: sample rows per row of the whole; a node expected to hold over `leaf` rows is split."""
        todo = [(1, np.arange(len(sample)))]
        while todo:
            node, own = todo.pop()
            if len(own) <= leaf * share or len(own) < 32:
                continue
            x = sample[own] @ direction(self.seed, self.tree, node, self.dim)
            low, high = np.quantile(x, [0.5 - spill, 0.5 + spill])
            if low == high:
                continue
            self.splits[node] = (float(low), float(high))
            todo += [(2 * node, own[x <= high]), (2 * node + 1, own[x >= low])]
        return self

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf node) for each leaf that a row falls into."""
        rows, nodes = [], []
        todo = [(1, np.arange(len(vectors)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node not in self.splits:
                rows.append(own), nodes.append(np.full(len(own), node, np.int64))
                continue
            low, high = self.splits[node]
            x = vectors[own] @ direction(self.seed, self.tree, node, self.dim)
            todo += [(2 * node, own[x <= high]), (2 * node + 1, own[x >= low])]
        return np.concatenate(rows), np.concatenate(nodes)


def link_leaf(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """Links within one leaf: per vector how many it has that no smaller leaf has found, and a spanning star."""
    ids, weight = table["vec_id"].to_numpy(), table["weight"].to_numpy()
    leaf = table["leaf"][0].as_py()
    x = np.array(table["unit"].to_pylist())
    n = len(ids)
    earlier = [[k for k in own if k < leaf] for own in table["leaves"].to_pylist()]
    places = {k: i for i, k in enumerate(sorted({k for own in earlier for k in own}))}
    seen = np.zeros((n, max(1, len(places))), np.float32)
    for i, own in enumerate(earlier):
        seen[i, [places[k] for k in own]] = 1
    count, root = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, n, 1024):
        near = x[at : at + 1024] @ x.T >= threshold
        own = np.arange(at, min(n, at + 1024))
        near[own - at, own] = False
        fresh = near & (seen[at : at + 1024] @ seen.T == 0)
        count[own] += fresh @ weight
        for i in own[near.any(axis=1)]:
            linked = np.unique(root[np.append(np.flatnonzero(near[i - at]), i)])
            if len(linked) > 1:
                root[np.isin(root, linked)] = linked[0]
    order = np.argsort(ids, kind="stable")
    least = np.full(n, -1, np.int64)
    least[root[order[::-1]]] = ids[order[::-1]]
    some = (count > 0) | (root != np.arange(n)) | np.isin(np.arange(n), root[root != np.arange(n)])
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(least[root[some]])], ["vec_id", "links", "root"])


def dense_centres(sample: np.ndarray, need: float, threshold: float) -> np.ndarray:
    """Sample rows that at least `need` rows not linked with an earlier centre are linked with, greedily by count."""
    left = np.ones(len(sample), bool)
    count = np.zeros(len(sample), np.int64)
    for at in range(0, len(sample), 1024):
        count[at : at + 1024] = (sample[at : at + 1024] @ sample.T >= threshold).sum(axis=1)
    centres = []
    while len(sample):
        best = int(np.where(left, count, -1).argmax())
        if not left[best] or count[best] < need:
            break
        centres.append(best)
        gone = np.flatnonzero(left & (sample @ sample[best] >= threshold))
        left[best] = left[gone] = False
        for at in range(0, len(gone), 1024):
            count -= (sample @ sample[gone[at : at + 1024]].T >= threshold).sum(axis=1)
    return np.array(centres, np.int64)


def link_block(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """Links between a block of one core (probe) and a block of its cell. Members that are a core's count their own links there."""
    probe = table["probe"].to_numpy(zero_copy_only=False).astype(bool)
    ids, own, weight, core = (table[c].to_numpy() for c in ("vec_id", "own", "weight", "core"))
    x, root = np.array(table["unit"].to_pylist()), table["centre"][0].as_py()
    p, m = np.flatnonzero(probe), np.flatnonzero(~probe)
    count = np.zeros(len(ids), np.int64)
    for at in range(0, len(p), 1024):
        part = p[at : at + 1024]
        near = x[part] @ x[m].T >= threshold
        near &= (ids[part, None] != ids[m]) | (own[part, None] != own[m])
        count[part] += near @ weight[m]
        count[m] += weight[part] @ near
    some = probe | (count > 0)
    count[~probe & (core >= 0)] = 0
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(np.full(some.sum(), root, np.int64))], ["vec_id", "links", "root"])


def _core_links(dense: DataFrame, block: int, threshold: float) -> DataFrame:
    """dense: rows that lie in cells. Each core block meets each block of its cell in a task of its own."""
    rows = dense.select("dim", F.explode("cells").alias("in"), "vec_id", "own", "weight", "core", "unit").select("dim", "in.cell", "in.centre", "vec_id", "own", "weight", "core", "unit")
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = rows.groupBy("dim", "cell").agg(blocks(F.count("*")).alias("across"), blocks(F.sum((F.col("core") == F.col("cell")).cast("int"))).alias("down")).where("down > 0")
    rows = rows.join(F.broadcast(sizes), ["dim", "cell"])
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "own"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["centre", "vec_id", "own", "weight", "core", "unit"]
    probes = rows.where("core = cell").select("dim", "cell", dealt(F.col("down")).alias("i"), every("across").alias("j"), F.lit(True).alias("probe"), *rest)
    members = rows.select("dim", "cell", every("down").alias("i"), dealt(F.col("across")).alias("j"), F.lit(False).alias("probe"), *rest)
    return by_group(probes.union(members), ["dim", "cell", "i", "j"], functools.partial(link_block, threshold=threshold), "vec_id long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, trees: int = 14, leaf: int = 1000, leaf_most: int = 4000, spill: float = 0.05, sample: int = 20_000, seed: int = 11) -> DataFrame:
    """Vectors linked by cosine similarity >= threshold, in double precision.

    Returns one row per input row: vec_id, n_links (other rows linked directly), component_id (smallest
    id reachable), kept (vec_id = component_id). Vectors that are null, empty or zero, or hold a null or
    non-finite component, link with nothing, nor do rows with a null id (component_id null, kept true).
    Only vectors of equal length are compared. Rows that repeat an id and vector count as further rows
    of one class. Other columns are ignored; an empty table gives an empty result. `sample` bounds the
    rows that the driver sees to fit the upper splits and to find dense groups (of `leaf` rows, and eight of the
    sample); every row is indexed and compared, and all links of the dense groups' vectors are found.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    usable = F.coalesce((F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("x", lambda c: c != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    v = v.select("vec_id", "x", usable.alias("usable"))
    v = v.withColumn("key", F.when(F.col("usable"), F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit(seed), "x").alias("b"), F.size("x").alias("dim"))))
    classes = v.where("usable").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = materialize(classes, "classes")
    # One row of each class brings the vector; rows that repeat an id and vector are equal.
    reps = v.where("usable").join(classes.select("key", F.col("rep").alias("vec_id"), "weight"), ["key", "vec_id"]).dropDuplicates(["key", "vec_id"])
    largest = F.array_max(F.transform("x", F.abs))
    scaled = reps.withColumn("s", F.transform("x", lambda c: c / largest))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, c: a + c * c))
    reps = materialize(scaled.withColumn("norm", norm).select("vec_id", "weight", F.transform("s", lambda c: c / F.col("norm")).alias("unit"), F.col("key.a").alias("own")), "units")

    total = reps.count()
    drawn = reps.select("vec_id", "unit").orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(len(r["unit"]), []).append((r["unit"], r["vec_id"]))
    share = len(drawn) / max(total, 1)
    forest, cells = {}, {}
    for d, rows in by_dim.items():
        x, ids = np.array([u for u, _ in rows]), np.array([i for _, i in rows])
        at = dense_centres(x, max(8, leaf * share), threshold)
        cells[d] = x[at], ids[at]
        others = x[(x @ x[at].T < threshold).all(axis=1)]
        forest[d] = [Tree(seed, t, d).fit(others, share, leaf, spill) for t in range(trees)]
    # Cosine of twice the threshold's angle.
    wide = 2 * threshold * threshold - 1 - 1e-9 if threshold > 0 else -2.0

    def place(batches):
        for batch in batches:
            units = batch.column(0).to_pylist()
            dims = np.array([len(u) for u in units])
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = np.array([units[i] for i in own])
                at, found = [], []
                for tree in forest.get(int(d)) or [Tree(seed, t, int(d)) for t in range(trees)]:
                    rows, nodes = tree.leaves(x)
                    at.append(rows), found.append(nodes * trees + tree.tree)
                at, found = np.concatenate(at), np.concatenate(found)
                centres, names = cells.get(int(d)) or (np.empty((0, d)), np.empty(0, np.int64))
                core, within = np.full(len(own), -1, np.int32), [[] for _ in own]
                if len(centres):
                    cosine = x @ centres.T
                    core = np.where(cosine.max(axis=1) >= threshold, cosine.argmax(axis=1), -1).astype(np.int32)
                    within = [[{"cell": k, "centre": names[k]} for k in np.flatnonzero(row >= wide)] for row in cosine]
                    outside = core[at] < 0
                    at, found = at[outside], found[outside]
                order = np.lexsort((found, at))
                ends = np.cumsum(np.bincount(at, minlength=len(own)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found[order]))
                picked = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([picked.column(1), picked.column(2), picked.column(0), pa.array(np.full(len(own), d, np.int32)), lists, picked.column(3), pa.array(core), pa.array(within, pa.list_(pa.struct([("cell", pa.int32()), ("centre", pa.int64())])))], ["vec_id", "weight", "unit", "dim", "leaves", "own", "core", "cells"])

    schema = "vec_id long, weight long, unit array<double>, dim int, leaves array<long>, own long, core int, cells array<struct<cell int, centre long>>"
    everything = materialize(reps.select("unit", "vec_id", "weight", "own").mapInArrow(place, schema), "placed")
    placed = everything.where("core < 0").select("vec_id", "weight", "unit", "dim", "leaves")
    placed = _refine(placed, trees, leaf_most, spill, seed)
    entries = placed.select("dim", F.explode("leaves").alias("leaf"), "vec_id", "weight", "unit", "leaves")
    found = by_group(entries, ["dim", "leaf"], functools.partial(link_leaf, threshold=threshold), "vec_id long, links long, root long")
    if any(len(names) for _, names in cells.values()):
        found = found.union(_core_links(everything.where("size(cells) > 0"), leaf_most, threshold))
    found = materialize(found, "found")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))

    of_class = classes.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = v.select("vec_id", "key").join(of_class, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _refine(placed: DataFrame, trees: int, most: int, spill: float, seed: int, rounds: int = 24) -> DataFrame:
    """Split leaves of over `most` vectors at distributed quantiles of their next projection."""

    def project(batches):
        for batch in batches:
            out = []
            for leaf, unit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.append(float(np.dot(unit, direction(seed, leaf % trees, leaf // trees, len(unit)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out, pa.float64())], ["leaf", "vec_id", "dim", "p"])

    for _ in range(rounds):
        entries = placed.select(F.explode("leaves").alias("leaf"), "vec_id", "dim", "unit")
        wide = entries.groupBy("dim", "leaf").count().where(F.col("count") > most).select("dim", "leaf")
        wide = materialize(wide, "wide")
        if not wide.take(1):
            return placed
        moved = entries.join(wide, ["dim", "leaf"]).select("leaf", "unit", "vec_id", "dim").mapInArrow(project, "leaf long, vec_id long, dim int, p double")
        moved = materialize(moved, "projected")
        ends = moved.groupBy("dim", "leaf").agg(F.percentile_approx("p", [0.5 - spill, 0.5 + spill], 10_000).alias("q"))
        ends = ends.where("q[0] < q[1]")
        t, node = F.pmod("leaf", F.lit(trees)), F.floor(F.col("leaf") / trees)
        sides = F.array_compact(F.array(F.when(F.col("p") <= F.col("q")[1], 2 * node * trees + t), F.when(F.col("p") >= F.col("q")[0], (2 * node + 1) * trees + t)))
        split = moved.join(ends, ["dim", "leaf"]).select("vec_id", "dim", "leaf", sides.alias("into"))
        changes = split.groupBy("vec_id", "dim").agg(F.collect_list("leaf").alias("gone"), F.flatten(F.collect_list("into")).alias("into"))
        if not changes.take(1):
            return placed
        after = placed.join(changes, ["vec_id", "dim"], "left")
        kept = F.array_sort(F.concat(F.array_except("leaves", F.coalesce("gone", F.array().cast("array<long>"))), F.coalesce("into", F.array().cast("array<long>"))))
        placed = materialize(after.select("vec_id", "weight", "unit", "dim", kept.alias("leaves")), "placed")
    return placed
