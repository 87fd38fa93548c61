"""The run ledger: what is left to do, one result a paper, statistics and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio, seconds_between


def todo(ids: DataFrame, done: DataFrame, key: str = "base_id") -> DataFrame:
    """Keys that are not done. An anti-join on keys, never a cursor: nothing is lost when work ends out of order."""
    return ids.join(done.select(key), key, "left_anti")


def succeeded(ledger: DataFrame) -> DataFrame:
    """The processed set: failed papers are tried again."""
    return ledger.where("success").select("base_id").distinct()


def assemble(ids: DataFrame, metadata: DataFrame, references: DataFrame, sources: DataFrame) -> DataFrame:
    """One result row a key: metadata are required, citations and sources optional, failures are rows.

    metadata: base_id. references: base_id, references. sources: base_id, versions, original_size,
    extracted_size. All three hold one row a key at most, so no join multiplies rows."""
    out = ids.join(metadata.select("base_id", F.lit(True).alias("found")), "base_id", "left")
    out = out.join(references, "base_id", "left").join(sources, "base_id", "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind)
    found = F.coalesce("found", F.lit(False))
    return out.select(
        "base_id",
        found.alias("success"),
        F.when(found, zero("versions", "int")).otherwise(0).alias("versions"),
        F.when(found, zero("references", "int")).otherwise(0).alias("references"),
        F.when(~found, "no metadata").alias("error"),
        F.when(found & (zero("versions", "int") == 0), "no sources").when(found, "ok").otherwise("no metadata").alias("status"),
        F.when(found, zero("original_size", "long")).otherwise(0).alias("original_size"),
        F.when(found, zero("extracted_size", "long")).otherwise(0).alias("extracted_size"),
    )


def run_statistics(ledger: DataFrame) -> DataFrame:
    """One row of counters, zero-guarded means and memory figures over a ledger."""
    good, refs = F.col("success"), F.col("references")
    totals = ledger.agg(
        F.count("*").alias("attempted"),
        F.count_if(good).alias("successful_papers"),
        F.count_if(~good).alias("failed_papers"),
        F.coalesce(F.sum(F.when(good, F.col("versions"))), F.lit(0)).alias("total_versions"),
        F.coalesce(F.sum(F.when(good, refs)), F.lit(0)).alias("total_references"),
        F.count_if(good & (refs > 0)).alias("papers_with_references"),
        F.coalesce(F.sum("original_size"), F.lit(0)).alias("total_original_size"),
        F.coalesce(F.sum("extracted_size"), F.lit(0)).alias("total_extracted_size"),
        F.coalesce(F.avg("rss_bytes"), F.lit(0.0)).alias("avg_memory"),
        F.coalesce(F.max("rss_bytes"), F.lit(0)).alias("max_memory"),
        F.coalesce(seconds_between(F.min("finished_at"), F.max("finished_at")), F.lit(0.0)).alias("total_time"),
    )
    of = lambda a, b: ratio(F.col(a), F.col(b))
    return totals.select(
        "*",
        of("successful_papers", "attempted").alias("overall_success_rate"),
        of("papers_with_references", "successful_papers").alias("reference_success_rate"),
        of("total_references", "successful_papers").alias("avg_refs"),
        of("total_original_size", "successful_papers").alias("avg_original"),
        of("total_extracted_size", "successful_papers").alias("avg_extracted"),
        of("total_time", "attempted").alias("avg_time"),
    )


def state_document(statistics: DataFrame, processed: DataFrame, disk_usage: Column, saved_at: Column) -> DataFrame:
    """The checkpoint as one JSON document with the names that readers of it know."""
    ids = processed.agg(F.sort_array(F.collect_set("base_id")).alias("processed_papers"))
    s = statistics.crossJoin(ids)  # one row each
    return s.select(
        F.to_json(
            F.struct(
                F.col("attempted").alias("current_index"), "total_time", "successful_papers", F.col("overall_success_rate").alias("overall success rate"), "failed_papers", "total_versions", "total_references", "reference_success_rate",
                "processed_papers", "avg_refs", "avg_memory", "max_memory", "total_original_size", "total_extracted_size", "avg_original", "avg_extracted", disk_usage.alias("disk_usage"), saved_at.alias("last_save"),
            )
        ).alias("document")
    )


def running_totals(rows: DataFrame, bucket: Column, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Add `seq` (from 1) and a running sum for each of `totals`, in the order of `order`.

    `bucket` must not fall as `order` rises (an hour, an id divided by a million): sums run within each
    bucket in parallel, and only one row a bucket meets in one place for the offsets."""
    named = {"seq": F.lit(1).cast("long")} | totals
    held = rows.withColumn("__bucket", bucket)
    sums = held.groupBy("__bucket").agg(*[F.sum(c).alias(f"__{n}") for n, c in named.items()])
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__bucket", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in named])
    within = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.select("*", *[F.sum(c).over(within).alias(n) for n, c in named.items()]).join(offsets, held["__bucket"].eqNullSafe(offsets["__bucket"]))
    return out.select(*[held[c] for c in rows.columns], *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in named])


def at_checkpoints(rows: DataFrame, every: int, seq: str = "seq") -> DataFrame:
    """The rows at which a checkpoint falls due."""
    if every < 1:
        raise ValueError("a checkpoint interval is at least 1")
    return rows.where(F.col(seq) % every == 0)


def slice_ids(ids: DataFrame, key: str, start: int = 0, count: int | None = None) -> DataFrame:
    """`count` keys from place `start` on, by key; None or 0: all the rest."""
    out = ids.orderBy(key).offset(start)
    return out.limit(count) if count else out
