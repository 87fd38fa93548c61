"""One current metadata record for each paper out of its versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import iso_time, truthy
from .versions import MAX_VERSIONS, contiguous_prefix


def fold_metadata(versions: DataFrame, most: int = MAX_VERSIONS) -> DataFrame:
    """versions: rows of PAPER_VERSIONS. Papers without version 1 have no record.

    Title and authors are the last version's, the submission date is the first one's (empty if unknown),
    revised dates are all known dates in order, and the venue is the last that is not empty."""
    kept = contiguous_prefix(versions, "base_id", "version", F.coalesce(F.col("probe") == "exists", F.lit(True)), most)
    dates = F.array_sort(F.collect_list(F.struct("version", F.coalesce(iso_time(F.col("updated")), F.lit("")).alias("at"))))
    return kept.groupBy("base_id").agg(
        F.coalesce(F.max_by("title", "version"), F.lit("")).alias("paper_title"),
        F.coalesce(F.max_by("authors", "version"), F.array().cast("array<string>")).alias("authors"),
        F.coalesce(F.min_by(iso_time(F.col("published")), "version"), F.lit("")).alias("submission_date"),
        F.filter(F.transform(dates, lambda x: x["at"]), lambda x: x != "").alias("revised_dates"),
        F.max_by("journal_ref", F.when(truthy(F.col("journal_ref")).isNotNull(), F.col("version"))).alias("publication_venue"),
        F.count("*").cast("int").alias("versions"),
    )


def metadata_documents(metadata: DataFrame) -> DataFrame:
    """base_id and its JSON document; a null venue is written, not left out."""
    fields = ("paper_title", "authors", "submission_date", "revised_dates", "publication_venue")
    return metadata.select("base_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))
