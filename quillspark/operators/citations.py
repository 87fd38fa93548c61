"""Cited works: keep those with an arXiv id, one row a key, the last one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import first_truthy, folder_key, strip_version, strip_version_at_first_v


def route_status(citations: DataFrame) -> DataFrame:
    """Add `status`: ok, retry (429) or failed."""
    code = F.col("http_status")
    return citations.withColumn("status", F.when(code == 200, "ok").when(code == 429, "retry").otherwise("failed"))


def extract_citations(citations: DataFrame, compat_keys: bool = False) -> DataFrame:
    """citations: rows of CITATIONS. Returns base_id, ref_key, position (of its first occurrence), paper_title,
    authors, submission_date, semantic_scholar_id.

    Null arrays and null elements give nothing, null authors an empty list. Only the fields used are
    carried through the explode, so that a columnar scan reads no others."""
    usable = route_status(citations).where("status = 'ok'")
    each = usable.select("base_id", F.posexplode("references").alias("pos", "r")).where("r is not null")
    found = first_truthy(F.col("r.externalIds")["ArXiv"], F.col("r.externalIds")["arXiv"])
    strip = strip_version_at_first_v if compat_keys else strip_version
    keyed = each.withColumn("found", found).where("found is not null")
    work = F.struct(
        F.col("r.title").alias("paper_title"),
        F.coalesce(F.transform("r.authors", lambda a: a["name"]), F.array().cast("array<string>")).alias("authors"),
        F.col("r.publicationDate").alias("submission_date"),
        F.col("r.paperId").alias("semantic_scholar_id"),
    )
    rows = keyed.select("base_id", folder_key(strip(F.col("found"))).alias("ref_key"), "pos", work.alias("work"))
    last = rows.groupBy("base_id", "ref_key").agg(F.min("pos").alias("position"), F.max_by("work", "pos").alias("work"))
    return last.select("base_id", "ref_key", "position", "work.*")


def last_wins(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row for each key with the values of its last row by `order`, and how many rows there were."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("__last"), F.count("*").alias("n_raw")).select(*keys, "__last.*", "n_raw")


def count_citations(references: DataFrame) -> DataFrame:
    """Distinct cited keys of each paper."""
    return references.groupBy("base_id").agg(F.count("ref_key").cast("int").alias("references"))


def reference_documents(references: DataFrame) -> DataFrame:
    """base_id and its JSON document: cited key to record, for papers that cite anything."""
    record = F.struct("paper_title", "authors", "submission_date", "semantic_scholar_id")
    entries = F.array_sort(F.collect_list(F.struct("position", "ref_key", record.alias("record"))))
    pairs = F.transform(entries, lambda e: F.struct(e["ref_key"].alias("key"), e["record"].alias("value")))
    return references.groupBy("base_id").agg(F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"}).alias("document"))
