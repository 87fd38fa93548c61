"""Version prefixes: which versions of a paper count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_VERSIONS = 50


def contiguous_prefix(versions: DataFrame, key: str, version: str, good: Column, most: int = MAX_VERSIONS) -> DataFrame:
    """Good versions 1..k of each key, up to the first that is missing or not good.

    A version is its own rank among the good ones exactly as long as none before it is missing. One
    shuffle on the key. Of good rows that repeat a version, the first by the other columns counts."""
    kept = versions.where(good & F.col(version).between(1, most))
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(version))
    return _first_of_version(kept.withColumn("__rank", rank).where(F.col("__rank") == F.col(version)).drop("__rank"), key, version)


def _first_of_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row of each version of a key, the first by the other columns (maps as JSON, as they have no order)."""
    others = [c for c in rows.columns if c not in (key, version)]
    order = [F.to_json(F.struct(c)) if "map<" in rows.schema[c].dataType.simpleString() else F.col(c) for c in others]
    nth = F.row_number().over(Window.partitionBy(key, version).orderBy(*order or [F.col(version)]))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def existing_prefix(versions: DataFrame, key: str, version: str, probe: str, ok: Column, most: int = MAX_VERSIONS) -> DataFrame:
    """Ok versions before the first that does not exist; versions that failed are skipped.

    `probe` is exists, missing or error; a version without a row is missing, and an error does not stop
    the scan. Of ok rows that repeat a version, the first by the other columns counts. The first gap comes from the set of a key's versions, at most `most` numbers, so nothing is
    multiplied by `most` to make gaps visible."""
    numbered = versions.where(F.col(version).between(1, most))
    present = F.collect_set(F.when(F.col(probe) != "missing", F.col(version).cast("int"))).over(Window.partitionBy(key))
    gap = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(most + 1)), present))
    return _first_of_version(numbered.withColumn("__gap", gap).where((F.col(version) < F.col("__gap")) & ok).drop("__gap"), key, version)
