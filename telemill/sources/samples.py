"""Sample tables on storage: one folder per metric and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Write samples as ``metric=/date=`` folders.

    The rebalance hint groups each folder's rows into few files and still splits a metric or a day
    that holds a large share of all rows, which a plain repartition would send to one task.
    """
    dated = samples.withColumn("date", F.to_date("ts"))
    dated.hint("rebalance", "metric", "date").write.mode(mode).partitionBy("metric", "date").parquet(path)


def read_samples(spark: SparkSession, path: str, metric: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Samples of one metric; metric and day limit the folders that are listed and read."""
    rows = spark.read.parquet(path).where(F.col("metric") == metric)
    if since:
        rows = rows.where(F.col("date") >= F.lit(since).cast("date"))
    if until:
        rows = rows.where(F.col("date") <= F.lit(until).cast("date"))
    return rows
