"""Resumable runs: a checkpointed stream over landed files, each batch once, keys never twice.

The stream's offset log is the cursor, its state the processed set; a restart goes on where the last
batch was committed. A batch that is repeated after a crash overwrites its own partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_keys(spark: SparkSession, path: str, schema: StructType | str, key: str, files_per_batch: int = 10, within: tuple[str, str] | None = None) -> DataFrame:
    """A stream of rows whose key has not been seen. `within`: a time column and how long keys are remembered;
    without it they are remembered for ever."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    if within is None:
        return rows.dropDuplicates([key])
    column, delay = within
    # Event times without a zone cannot carry a watermark.
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> int:
    """Work on all that has landed, then stop. Results of batch n go to out/batch=n. Returns the number of batches."""

    def each(batch: DataFrame, n: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])
