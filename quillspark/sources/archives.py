"""Source archives: gates, member listing and version bookkeeping."""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import is_gzip
from ..operators.versions import MAX_VERSIONS, existing_prefix

#: An archive below this many bytes is not a source archive.
LEAST_BYTES = 1024
WANTED = (".tex", ".bib")
MOST_MEMBERS, MOST_MEMBER_BYTES = 20_000, 256 << 20
#: Members leave a task together, up to so many bytes (and the member that goes beyond them) or rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
MEMBERS = "path string, name string, size long, content binary"


def landed_archives(spark: SparkSession, path: str, glob: str = "*.tar.gz") -> DataFrame:
    """Archives anywhere below `path`. Select `length` alone and the contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def is_tar(content: Column) -> Column:
    """Whether compressed bytes hold a tar archive; made when it is used, as a worker has no session."""

    @F.pandas_udf("boolean")
    def test(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: c is not None and opened(c) is not None)

    return test(content)


def gated(archives: DataFrame) -> DataFrame:
    """Add `status`: too_small, not_gzip, not_tar or ok; a test runs only where the cheaper ones have passed."""
    small, zipped = F.col("length") < LEAST_BYTES, is_gzip(F.col("content"))
    return archives.withColumn("status", F.when(small, "too_small").when(~zipped, "not_gzip").when(~is_tar(F.when(~small & zipped, F.col("content"))), "not_tar").otherwise("ok"))


def safe_name(name: str) -> str | None:
    """The member's place below its folder, or None for absolute and climbing paths."""
    clean = posixpath.normpath(name)
    return None if clean.startswith(("/", "..")) or clean == "." else clean


def opened(content: bytes) -> tarfile.TarFile | None:
    """The archive, of which the first header has been read, or None where there is none."""
    try:
        tar = tarfile.open(fileobj=io.BytesIO(content), mode="r:gz")
        tar.next()
        return tar
    except (tarfile.TarError, OSError, EOFError):
        return None


def members_of(content: bytes) -> Iterator[tuple[str, int, bytes]]:
    """Wanted files of an archive: no links, no unsafe paths. A wanted member or a number of members beyond the limits is an error."""
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
        yield from _wanted(tar)


def _wanted(tar: tarfile.TarFile) -> Iterator[tuple[str, int, bytes]]:
    for n, member in enumerate(tar):
        if n >= MOST_MEMBERS:
            raise tarfile.TarError(f"over {MOST_MEMBERS} members")
        name = safe_name(member.name)
        if member.isfile() and name and name.lower().endswith(WANTED):
            if member.size > MOST_MEMBER_BYTES:
                raise tarfile.TarError(f"a member of over {MOST_MEMBER_BYTES} bytes")
            yield name, member.size, tar.extractfile(member).read()


def archive_members(archives: DataFrame) -> DataFrame:
    """Members of the archives that pass the gates: path (of the archive), name, size, content.

    An archive without wanted members gives no rows and has still been unpacked; one that breaks off
    gives the rows before the break and a row with the error as name and no size. Each archive is opened once,
    for the last gate and its members; members leave together, in batches of about BATCH_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            made = [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.binary()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, ["path", "name", "size", "content"])

        for given in batches:
            for path, content in zip(given.column(0), given.column(1)):
                path, tar = path.as_py(), opened(content.as_py())
                if tar is None:
                    continue
                try:
                    with tar:
                        for name, size, data in _wanted(tar):
                            rows.append((path, name, size, data))
                            held += size
                            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                                yield batch()
                                held = 0
                except (tarfile.TarError, OSError, EOFError) as e:
                    rows.append((path, f"error: {type(e).__name__}", None, None))
        if rows:
            yield batch()

    # The gates that need no Python; the last one is opened().
    zipped = archives.where((F.col("length") >= LEAST_BYTES) & is_gzip(F.col("content")))
    return zipped.select("path", "content").mapInArrow(run, MEMBERS)


def unpacked_versions(versions: DataFrame, archives: DataFrame, members: DataFrame, most: int = MAX_VERSIONS) -> DataFrame:
    """Sizes of each paper's unpacked versions: base_id, versions, original_size, extracted_size.

    versions: base_id, version, probe. archives: base_id, version, path, length, status. members: path, size."""
    sizes = members.groupBy("path").agg(F.sum("size").alias("extracted"), F.max(F.col("size").isNull()).alias("broken"))
    tried = archives.join(sizes, "path", "left").select("base_id", "version", "length", "extracted", (F.col("status") == "ok").alias("fine"), F.coalesce("broken", F.lit(False)).alias("broken"))
    joined = versions.join(tried, ["base_id", "version"], "left")
    ok = (F.col("probe") == "exists") & F.coalesce("fine", F.lit(False)) & ~F.coalesce("broken", F.lit(False))
    kept = existing_prefix(joined, "base_id", "version", "probe", ok, most)
    return kept.groupBy("base_id").agg(F.count("*").cast("int").alias("versions"), F.sum(F.coalesce("length", F.lit(0))).alias("original_size"), F.sum(F.coalesce("extracted", F.lit(0))).alias("extracted_size"))
