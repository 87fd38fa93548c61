"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are integers floor(scale * component). For a split of the dimensions into segments, with the
mean m and deviation s of each segment of length n,

    |x - q|^2 >= sum n * ((m_x - m_q)^2 + (s_x - s_q)^2),   so   <x, q> <= sum n * (m_x m_q + s_x s_q):

one small matrix product bounds the scores of a block of queries against a block of candidates. Blocks
go from few segments to many; what cannot reach a query's k-th best score so far is dropped, and the
survivors are scored exactly. Queries travel in blocks of bounded size; each task keeps k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEVELS = (4, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations, each times the root of the segment's length, so that products need no weights."""
    out = []
    for part in np.array_split(x.astype(np.float64), min(segments, x.shape[1]), axis=1):
        root = part.shape[1] ** 0.5
        out += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(out, axis=1)


class Queries:
    """A block of queries with their statistics and the k-th best score known so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.real = x.astype(np.float64)
        self.levels = [statistics(x, n) for n in LEVELS]
        self.floor = np.full(len(ids), -np.inf)
        self.scores: list[np.ndarray] = [np.empty(0, np.int64) for _ in ids]
        self.found: list[np.ndarray] = [np.empty(0, np.int64) for _ in ids]

    def offer(self, ids: np.ndarray, x: np.ndarray) -> tuple[int, int]:
        """Take in a block of candidates; how many pairs there were and how many were scored."""
        slack = 1e-6 * (1 + np.abs(self.levels[0]).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1])
        levels = [statistics(x, n) for n in LEVELS]
        alive = self.levels[0] @ levels[0].T >= self.floor[:, None] - slack
        scored = 0
        for i in np.flatnonzero(alive.any(axis=1)):
            own = np.flatnonzero(alive[i])
            for mine, theirs in zip(self.levels[1:], levels[1:]):
                own = own[theirs[own] @ mine[i] >= self.floor[i] - slack]
            own = own[ids[own] != self.ids[i]]
            if not len(own):
                continue
            scored += len(own)
            s = np.concatenate([self.scores[i], x[own] @ self.x[i]])
            v = np.concatenate([self.found[i], ids[own]])
            best = np.lexsort((v, -s))[: self.k]
            self.scores[i], self.found[i] = s[best], v[best]
            if len(best) == self.k:
                self.floor[i] = s[best[-1]]
        return alive.size, scored


RESULT = "query_id long, vec_id long, score long"


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def exact_top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, query_block: int = 4096, seed_rows: int = 4096, candidate_block: int = 4096) -> DataFrame:
    """The k candidates with the highest integer inner product for each query, ties to smaller ids.

    `is_query` is a condition on the columns of `vectors`; candidates are all rows but those with the
    query's own id. Vectors become floor(scale * component) with the component as double. Returns
    query_id, rank (from 1), vec_id, score: all candidates, if fewer than k. Vectors that are null, empty
    or hold a null or non-finite component, and rows with a null id, take no part; only vectors of equal
    length meet. Rows that repeat an id are candidates once for each row with another id's query, ranked
    by id, then score. Vectors whose inner products could reach 2^62 are an error, whatever their pairs. Other columns are ignored. An empty table gives an empty result. The driver sees
    `query_block` queries and `seed_rows` candidates (whose exact scores give the first floors) at a time.
    """
    marked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False)) & F.col("id").isNotNull()
    whole = F.transform("v", lambda c: F.floor(c * scale).cast("long"))
    rows = materialize(marked.where(fine).select("id", "asked", F.size("v").alias("dim"), whole.alias("x")), "vectors")
    asked = rows.where("asked")
    counts = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}
    widest = rows.groupBy("dim").agg(F.max(F.array_max(F.transform("x", F.abs))).alias("widest"))
    for r in widest.collect():
        if r["dim"] * r["widest"] ** 2 >= 1 << 62:
            raise ValueError(f"vectors of {r['dim']} components up to {r['widest']} have inner products beyond 62 bits")
    parts = []
    for dim, n in sorted(counts.items()):
        blocks = -(-n // (query_block // 2 or 1)) if n > query_block else 1
        own = rows.where(F.col("dim") == dim)
        seeds = own.orderBy(F.xxhash64("id")).limit(seed_rows).select("id", "x").toArrow()
        seed_ids, seed_x = seeds["id"].to_numpy(), _integers(seeds["x"].combine_chunks(), dim)
        for b in range(blocks):
            mine = asked.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)) == b).select("id", "x").distinct().toArrow()
            if not mine.num_rows:
                continue
            ids, x = mine["id"].to_numpy(), _integers(mine["x"].combine_chunks(), dim)
            first = Queries(ids, x, k)
            for at in range(0, len(seed_ids), candidate_block):
                first.offer(seed_ids[at : at + candidate_block], seed_x[at : at + candidate_block])
            parts.append(own.select("id", "x").mapInArrow(_search(ids, x, first.floor, dim, k, candidate_block), RESULT))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(ids: np.ndarray, x: np.ndarray, floor: np.ndarray, dim: int, k: int, block: int):
    def run(batches):
        q = Queries(ids, x, k)
        q.floor = floor.copy()
        for batch in batches:
            own_ids, own = batch.column(0).to_numpy(), _integers(batch.column(1), dim)
            for at in range(0, len(own_ids), block):
                q.offer(own_ids[at : at + block], own[at : at + block])
        n = [len(s) for s in q.scores]
        for at in range(0, len(n), 512):
            cut = slice(at, at + 512)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[cut], n[cut])), pa.array(np.concatenate(q.found[cut])), pa.array(np.concatenate(q.scores[cut]))], ["query_id", "vec_id", "score"])

    return run
