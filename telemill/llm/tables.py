"""Reading the given tables, and intermediate results in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.session import scratch_dir


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again: lineage ends there, lost executors lose nothing."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids that are sent to all executors at most (8 bytes each, some 50 MB as a hash table).
BROADCAST_IDS = 2_000_000


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``: without a shuffle of ``df`` while the ids are few enough to broadcast."""
    return df.join(small(ids.select(key).distinct()), key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids``."""
    return df.join(small(ids.select(key).distinct()), key, "left_anti")


def small(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """``df`` written down, and marked for broadcast if it has at most so many rows."""
    df = stored(df, "small")
    return F.broadcast(df) if df.count() <= rows else df
