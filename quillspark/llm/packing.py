"""Best-fit packing of documents into sequences under token, document-count and attention-cost capacities.

Pieces of the same length are interchangeable, so the plan needs only how many pieces of each length
there are: at most `capacity` numbers, whatever the corpus. The driver packs those counts by vector
best fit, longest first: groups of equal bins are scored by the weighted norm of what would be left in
each capacity (or by the weighted dot product of demand and residual), and as many pieces as fit go to
the best group at once. Each piece then finds its bin from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import public_path, slices, text_encoder
from .common import materialize

SALTS = 64


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds: tokens, documents and attention cost (the sum of squared piece lengths)."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2


@dataclass
class Bins:
    """`count` equal bins: what is left of each capacity, and the lengths they hold, in order."""

    count: int
    left: tuple[int, int, int]
    lengths: tuple[int, ...]


def plan_bins(counts: dict[int, int], capacities: Capacities, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), by: str = "norm") -> list[Bins]:
    """Pack `counts` pieces of each length. by: "norm" (least residual norm) or "dot" (largest dot product)."""
    full = capacities.vector()
    open_bins: dict[tuple[int, int, int], list[Bins]] = {}
    closed: list[Bins] = []

    def demand(s: int) -> tuple[int, int, int]:
        return s, 1, s * s

    def fits(s: int, left) -> int:
        return min(a // b for a, b in zip(left, demand(s)))

    def score(s: int, left) -> float:
        d = demand(s)
        if by == "dot":
            return -sum(w * a * b / c / c for w, a, b, c in zip(weights, left, d, full))
        return sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(weights, left, d, full))

    def put(bins: Bins, s: int, k: int, count: int, smallest: int) -> None:
        d = demand(s)
        left = tuple(a - k * b for a, b in zip(bins.left, d))
        made = Bins(count, left, bins.lengths + (s,) * k)
        if fits(smallest, left):
            open_bins.setdefault(left, []).append(made)
        else:
            closed.append(made)

    sizes = sorted((s for s, n in counts.items() if n), reverse=True)
    smallest = sizes[-1] if sizes else 0
    for s in sizes:
        remaining = counts[s]
        if not fits(s, full):
            raise ValueError(f"a piece of {s} tokens fits no sequence")
        while remaining:
            best = min((left for left in open_bins if fits(s, left)), key=lambda left: (score(s, left), left), default=None)
            if best is None:
                bins = Bins(-(-remaining // fits(s, full)), full, ())
            else:
                bins = open_bins[best].pop()
                if not open_bins[best]:
                    del open_bins[best]
            k = min(fits(s, bins.left), remaining)
            whole = min(bins.count, remaining // k)
            put(bins, s, k, whole, smallest)
            remaining -= whole * k
            rest = bins.count - whole
            if rest and best is None:
                put(Bins(1, full, ()), s, remaining, 1, smallest) if remaining else None
                remaining = 0
            elif rest:
                open_bins.setdefault(bins.left, []).append(Bins(rest, bins.left, bins.lengths))
    return closed + [b for group in open_bins.values() for b in group]


def spans(bins: list[Bins]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, and for each the sequence of its first rank and the offset in it."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for b in bins:
        offset = 0
        for s in b.lengths:
            out.setdefault(s, []).append((used.get(s, 0), first, offset))
            used[s] = used.get(s, 0) + b.count
            offset += s
        first += b.count
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in out.items()}


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Token ids of each document with its end id, cut into pieces of `capacity`; a rest comes first."""

    def run(batches):
        encoder, end = text_encoder(path), np.array([end_id], np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode_many(part.column(1).to_pylist())):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    rows += [(key, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, PIECE)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, capacities: Capacities = Capacities(), weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), by: str = "norm") -> DataFrame:
    """Pack whole documents into sequences; only documents longer than a sequence are cut.

    Returns one row per piece: doc_id, piece (from 0), start (place among the document's ids), length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit numbers), sequence_id, offset (gapless from
    0), and the sequence's totals n_docs and attention_cost. A null or empty text is its end id alone.
    Null ids and repeated rows are packed like others; other columns are ignored; an empty table gives
    an empty result. The driver gets counts by length and salt, at most 64 * `capacities.tokens` numbers.
    """
    path = path or public_path("byte_bpe_50k.json")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = materialize(cut(docs, path, end_id, capacities.tokens), "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counted = salted.groupBy("length", "salt").count().collect()
    base = np.zeros((capacities.tokens + 1, SALTS + 1), np.int64)
    for r in counted:
        base[r["length"], r["salt"] + 1] = r["count"]
    base = base.cumsum(axis=1)
    where = spans(plan := plan_bins({s: int(n) for s, n in enumerate(base[:, -1]) if n}, capacities, weights, by))
    firsts = np.cumsum([0, *(b.count for b in plan)]).tolist()
    totals = np.array([(len(b.lengths), sum(s * s for s in b.lengths)) for b in plan], np.int64).reshape(-1, 2)

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n != "doc_id"}
            rank = base[col["length"], col["salt"]] + col["nth"] - 1
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(col["length"]):
                own = np.flatnonzero(col["length"] == s)
                lo, seq, off = where[int(s)]
                k = np.searchsorted(lo, rank[own], side="right") - 1
                sequence[own], offset[own] = seq[k] + rank[own] - lo[k], off[k]
            pattern = np.searchsorted(firsts, sequence, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset), pa.array(totals[pattern, 0]), pa.array(totals[pattern, 1])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_docs", "attention_cost"])

    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return salted.withColumn("nth", nth.cast("long")).mapInArrow(run, PIECE + ", sequence_id long, offset long, n_docs long, attention_cost long")
