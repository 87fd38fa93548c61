"""Session settings and what Python workers need to import this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(master: str | None = None, name: str = "quillspark", **conf: str) -> SparkSession:
    """A session with the settings that the queries assume; anything can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(name).config(map=settings)
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers find this package where it is a folder that they can see.

    Elsewhere pass it with --py-files; setting the path then does no harm. Arrow batches are cut down from
    the default of 64 MB, which a worker may hold several times over, unless the session sets a size."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, root])
    if spark.conf.get(BATCH) == "67108864b":
        spark.conf.set(BATCH, "8m")
