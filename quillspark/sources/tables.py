"""Key ranges and landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import base_id


def key_range(spark: SparkSession, start: int, end: int, prefix: str) -> DataFrame:
    """Paper keys from start to end, both included."""
    return spark.range(start, end + 1).select(base_id(F.col("id"), prefix).alias("base_id"))


def paper_versions(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).schema(schemas.PAPER_VERSIONS).load(path)


def citation_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one JSON object a line; broken lines become rows of nulls, not failures."""
    return spark.read.schema(schemas.CITATIONS).option("mode", "PERMISSIVE").json(path)


def run_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LEDGER).parquet(path)


def run_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The state document at `path`, or None if there is none; a corrupt one is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    schema = "current_index long, total_time double, successful_papers long, `overall success rate` double, failed_papers long, total_versions long, total_references long, reference_success_rate double, processed_papers array<string>, avg_refs double, avg_memory double, max_memory long, total_original_size long, total_extracted_size long, avg_original double, avg_extracted double, disk_usage long, last_save string"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and number of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
