"""Min-interval throttles and retries, as analysis over logs of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import backoff_seconds


def throttle_schedule(requests: DataFrame, arrived: str, bucket: Column, order: list[str], interval_us: int, service: str | None = None) -> DataFrame:
    """Add `granted`, when a throttle of one grant each `interval_us` lets each request through.

    granted_i = max(arrived_i, granted_(i-1) + d) is i*d + the running maximum of arrived_j - j*d. Numbers
    and maxima run within each bucket (see running_totals) and are offset by one row a bucket; with
    `service`, each service has its own throttle."""
    own = [service] if service else []
    held = requests.withColumn("__bucket", bucket)
    counts = held.groupBy(*own, "__bucket").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*own).orderBy("__bucket") if own else Window.orderBy("__bucket")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*own, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*own, "__bucket").orderBy(*order)
    numbered = held.withColumn("__i", F.row_number().over(within).cast("long")).join(counts, [*own, "__bucket"])
    numbered = numbered.withColumn("__i", F.col("__i") + F.col("__before")).withColumn("__slack", F.col(arrived) - F.col("__i") * F.lit(interval_us).cast("long"))
    tops = numbered.groupBy(*own, "__bucket").agg(F.max("__slack").alias("__top"))
    tops = tops.select(*own, "__bucket", F.max("__top").over(before).alias("__top"))
    running = F.max("__slack").over(within.rowsBetween(Window.unboundedPreceding, 0))
    out = numbered.withColumn("__run", running).join(tops, [*own, "__bucket"])
    return out.select(*requests.columns, (F.greatest("__run", "__top") + F.col("__i") * F.lit(interval_us).cast("long")).alias("granted"))


def attempt_ledger(requests: DataFrame, key: str, order: list[str], failed: Column, most: int = 4) -> DataFrame:
    """Number the requests of each key as attempts; those up to `most` that failed wait 2^attempt seconds."""
    attempt = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    out = requests.withColumn("attempt", attempt).where(F.col("attempt") <= most)
    return out.withColumn("backoff_s", F.when(failed, backoff_seconds(F.col("attempt"))).otherwise(0))
