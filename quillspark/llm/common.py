"""Helpers shared by the corpus operators: scratch tables, word hashing, grouped Arrow streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

MASK64 = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        own = tempfile.mkdtemp(prefix="quill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.sparkContext.setCheckpointDir(named)
    return qualified(spark, named)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, which is the session's default one where it names none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all of them when it holds `limit`, so its memory is bounded."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def ascii_words(text: str | None) -> list[bytes]:
    """Maximal runs of other characters than space and U+0009..U+000D, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & MASK64 for i in range(64)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes], size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words; of all words together where there are fewer."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = mix(total * _PLACES[1] + hashed[i : n - width + 1 + i] + _PLACES[i % 64])
    return np.unique(total)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 62) -> Iterator[pa.Table]:
    """Whole groups out of a stream that is sorted by `keys`, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run `work` on each group; groups stream through a task one after another and only one is held at a time."""

    def run(batches):
        for table in groups(batches, keys):
            out = work(table)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
