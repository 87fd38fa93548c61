"""MinHash near-duplicate detection.

1. Each document's shingle set gives a 128-bit digest, the minima under many universal hashes
   (a*x + b mod 2^64, odd a), the band keys over `rows` minima each, and a one-byte signature per hash.
   Documents with the same set are one class from here on; its smallest id stands for it.
2. Representatives that share a band key form a bucket. Buckets with the same members are kept once.
   Within a bucket the signatures are compared (in one task, streaming, no pairs leave it) and the
   members that may be similar are joined into stars: soft groups, from which no link leads outside.
   A bucket too large for one task becomes a star as it is, which only makes the soft group coarser.
3. Within a soft group, pairs in the order of their estimated similarity are confirmed on the full
   shingle sets unless already connected, so the work inside a group is close to linear and only
   spanning links leave the task. A soft group too large for one task is dealt into blocks with shared
   pivots; afterwards the documents outside its largest component are compared with all of its blocks.
4. Alternating large-star and small-star turn the links into components.

A pair at similarity s shares a band with probability 1 - (1 - s^rows)^bands: with 36 bands of 7 rows,
one in a million pairs at 0.85 is not looked at; 5 rows do the same at 0.8. Rows follow from the threshold.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, ascii_words, by_group, discard, materialize, mix, shingles
from .components import connected_components

SOFT_BYTES = 64


class Sketcher:
    def __init__(self, size: int, bands: int, rows: int, seed: int = 7):
        self.size, self.bands, self.rows = size, bands, rows
        draw = np.random.default_rng(seed)
        k = bands * rows
        self.a = draw.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, k, dtype=np.uint64)
        self.c = draw.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.cache = WordHashes()

    def sets(self, text: str | None) -> np.ndarray:
        return shingles(ascii_words(text), self.size, self.cache)

    def minima(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), 256):
            np.minimum(out, (x[i : i + 256, None] * self.a + self.b).min(axis=0), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        return mix((mix(minima) * self.c).reshape(self.bands, self.rows).sum(axis=1, dtype=np.uint64)).view(np.int64)

    @staticmethod
    def signature(minima: np.ndarray) -> np.ndarray:
        return (mix(minima) >> np.uint64(56)).astype(np.uint8)


@functools.cache
def sketcher(size: int, bands: int, rows: int) -> Sketcher:
    return Sketcher(size, bands, rows)


def estimate(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity; a 256th of unequal minima share a byte."""
    same = (others == sig).mean(axis=1)
    return (same - 1 / 256) * (256 / 255)


def margin(threshold: float, n: int, sigmas: float = 5.5) -> float:
    return threshold - sigmas * (threshold * (1 - threshold) / n) ** 0.5 - 0.5 / n


def band_rows(percent: int, bands: int, missed: float = 1e-6) -> int:
    """The most rows of a band with which a pair at the threshold is missed by at most this chance."""
    rows = 1
    while rows < 64 and (1 - (percent / 100) ** (rows + 1)) ** bands <= missed:
        rows += 1
    return rows


SKETCH = "doc_id long, n_shingles long, fp binary, bands array<long>, sig binary"


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """docs: (doc_id, text). One row per document; no words: n_shingles 0 and nulls."""

    def run(batches):
        s = sketcher(size, bands, rows)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 500):
                n, fp, keys, sig = [], [], [], []
                for t in texts.slice(at, 500):
                    x = s.sets(t.as_py())
                    n.append(len(x))
                    if not len(x):
                        fp.append(None), keys.append(None), sig.append(None)
                        continue
                    m = s.minima(x)
                    fp.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    keys.append(s.keys(m))
                    sig.append(s.signature(m).tobytes())
                yield pa.RecordBatch.from_arrays([ids.slice(at, 500).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "fp", "bands", "sig"])

    return docs.mapInArrow(run, SKETCH)


def _edges(ids: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    moved = ids != roots
    return pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(roots[moved], pa.int64())], ["u", "v"])


def soft_stars(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """Members of one bucket joined where their short signatures allow the similarity."""
    ids = table["doc_id"].to_numpy()
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, sig = ids[order], sig[order]
    least = margin(threshold, sig.shape[1])
    root = np.full(len(ids), -1)
    for start in range(len(ids)):
        if root[start] >= 0:
            continue
        root[start], queue = start, [start]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(root < 0)
            if not len(rest):
                break
            near = rest[estimate(sig[i], sig[rest]) >= least]
            root[near] = start
            queue.extend(near.tolist())
    return _edges(ids, ids[root])


def hard_links(table: pa.Table, size: int, bands: int, rows: int, percent: int) -> pa.RecordBatch:
    """Spanning links of one block of a soft group, each confirmed on full sets.

    With labels, only rows marked `probe` are compared, and only across labels."""
    s = sketcher(size, bands, rows)
    ids = table["doc_id"].to_numpy()
    n = len(ids)
    sets = [s.sets(t.as_py()) for t in table["text"]]
    sig = np.stack([s.signature(s.minima(x)) for x in sets])
    sizes = np.array([len(x) for x in sets])
    least = margin(percent / 100, sig.shape[1])
    labels = table["label"].to_numpy(zero_copy_only=False)
    group = np.unique(labels, return_inverse=True)[1] if table["label"].null_count == 0 else np.arange(n)
    probe = table["probe"].to_numpy(zero_copy_only=False).astype(bool)
    u, v = [], []
    for i in np.flatnonzero(probe) if not probe.all() else range(1, n):
        others = np.arange(i) if probe.all() else np.arange(n)
        others = others[(group[others] != group[i]) & (sizes[others] * 100 >= percent * sizes[i]) & (sizes[i] * 100 >= percent * sizes[others])]
        if not len(others):
            continue
        est = estimate(sig[i], sig[others])
        others, est = others[est >= least], est[est >= least]
        for j in others[np.argsort(-est, kind="stable")]:
            if group[i] == group[j]:
                continue
            common = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                u.append(ids[i]), v.append(ids[j])
                group[group == group[j]] = group[i]
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = 36, rows: int | None = None, bucket_most: int = 4096, block_shingles: int = 1_000_000) -> DataFrame:
    """Near-duplicate components of documents.

    Words are runs of characters other than U+0020 and U+0009-U+000D with A-Z lower-cased. A document's
    set holds its distinct shingles of `size` words; fewer words give one shingle of all of them. Two
    documents are linked when 100 * |intersection| >= percent * |union|.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id reachable), kept
    (doc_id = component_id). Null, empty or blank texts have n_shingles 0 and link with nothing. Rows
    that repeat an id are one node. A null id never links: component_id null and kept true. Other
    columns of `docs` are ignored, whatever their names. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows or band_rows(percent, bands)
    sk = materialize(sketches(docs, size, bands, rows), "sketches")
    usable = sk.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    reps = materialize(usable.join(classes.select(F.col("rep").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id", "fp"]).select("doc_id", "n_shingles", "bands", "sig"), "reps")

    entries = reps.select(F.explode("bands").alias("key"), "doc_id")
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.bit_xor(F.xxhash64("doc_id")).alias("x")).where("n > 1")
    buckets = materialize(buckets.groupBy("n", "lo", "x").agg(F.min("key").alias("key")), "buckets")
    members = materialize(entries.join(buckets.select("key", "n", "lo"), "key"), "members")
    wide = members.where(F.col("n") > bucket_most).select(F.col("doc_id").alias("u"), F.col("lo").alias("v"))
    fine = members.where(F.col("n") <= bucket_most).select("key", "doc_id").join(reps.select("doc_id", F.substring("sig", 1, SOFT_BYTES).alias("sig")), "doc_id")
    stars = by_group(fine, ["key"], functools.partial(soft_stars, threshold=percent / 100), "u long, v long")
    soft = connected_components(stars.union(wide))
    soft = materialize(soft.union(soft.select(F.col("component").alias("node"), "component").distinct()), "soft")

    # Sizes in shingles decide how many blocks a soft group needs.
    sized = soft.join(reps.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
    plan = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("blocks"), *[F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), F.col("node").alias("p"))).alias(f"p{i}") for i in range(4)])
    plan = plan.select("component", "blocks", F.array(*[F.col(f"p{i}.p") for i in range(4)]).alias("pivots"))
    placed = soft.join(plan, "component")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.array(F.pmod(F.xxhash64(F.lit(99), "node"), F.col("blocks")).cast("int"))
    placed = placed.select("node", "component", "blocks", F.when(F.array_contains("pivots", F.col("node")), everywhere).otherwise(own).alias("where"))
    placed = materialize(placed, "placed")
    texts = docs.join(placed.withColumnRenamed("node", "doc_id"), "doc_id")
    linking = functools.partial(hard_links, size=size, bands=bands, rows=rows, percent=percent)
    blocks = texts.select("component", F.explode("where").alias("block"), "doc_id", "text", F.lit(None).cast("long").alias("label"), F.lit(True).alias("probe"))
    links = materialize(by_group(blocks, ["component", "block"], linking, "u long, v long"), "links")
    found = connected_components(links)

    # Soft groups of several blocks: what is outside the largest component meets every block.
    split = placed.where("blocks > 1").join(found, "node", "left").select("node", placed["component"], "blocks", F.coalesce(found["component"], "node").alias("label"))
    split = materialize(split, "split")
    if split.take(1):
        largest = split.groupBy("component", "label").count().groupBy("component").agg(F.max(F.struct("count", "label")).alias("top")).select("component", F.col("top.label").alias("main"))
        split = split.join(largest, "component")
        home = F.pmod(F.xxhash64(F.lit(99), "node"), F.col("blocks")).cast("int")
        strangers = split.where("label <> main")
        again = split.select("component", home.alias("block"), F.col("node").alias("doc_id"), "label", F.lit(False).alias("probe"))
        again = again.union(strangers.select("component", F.explode(everywhere).alias("block"), F.col("node").alias("doc_id"), "label", F.lit(True).alias("probe")))
        again = again.join(docs, "doc_id").select("component", "block", "doc_id", "text", "label", "probe")
        more = by_group(again, ["component", "block"], linking, "u long, v long")
        found = connected_components(links.union(more))

    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = sk.select("doc_id", "n_shingles", "fp").join(of_class, "fp", "left")
    of_row = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    discard(members), discard(reps), discard(buckets), discard(placed), discard(soft)
    return out.select("doc_id", "n_shingles", of_row.alias("component_id"), F.coalesce(F.col("doc_id") == of_row, F.lit(True)).alias("kept"))
