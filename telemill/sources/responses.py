"""Landed JSON answers of a metrics server, one body per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the answer's layout. [number, "text"] pairs are read as two texts.
BODY = (
    "status string, data struct<resultType:string, result:array<struct<"
    "metric:map<string,string>, value:array<string>, values:array<array<string>>>>>"
)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Files with one JSON answer per line."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def _series(df: DataFrame, body: str, kind: str) -> DataFrame:
    parsed = df.withColumn("_answer", F.from_json(F.col(body), BODY))
    wanted = (F.col("_answer.status") == "success") & (F.col("_answer.data.resultType") == kind)
    return parsed.where(wanted).select(
        *[c for c in df.columns if c != body], F.explode("_answer.data.result").alias("_series")
    )


def _stamp(pair: Column) -> Column:
    # decimal keeps the microseconds of an epoch written with a fraction; a stamp that is no number becomes NULL
    return F.timestamp_seconds(pair[0].try_cast("decimal(20,6)"))


def parse_instant(df: DataFrame, body: str = "body") -> DataFrame:
    """Instant-vector answers as rows ``(labels, ts, v)`` next to the input's other columns; other answers give none."""
    value = F.col("_series.value")
    kept = [c for c in df.columns if c != body]
    return _series(df, body, "vector").select(
        *kept, F.col("_series.metric").alias("labels"), _stamp(value).alias("ts"), value[1].try_cast("double").alias("v")
    )


def parse_range(df: DataFrame, body: str = "body") -> DataFrame:
    """Matrix answers as rows ``(labels, ts, v)``, one per sample; other answers give none."""
    kept = [c for c in df.columns if c != body]
    points = _series(df, body, "matrix").select(*kept, F.col("_series.metric").alias("labels"), F.explode("_series.values").alias("_point"))
    point = F.col("_point")
    return points.select(*kept, "labels", _stamp(point).alias("ts"), point[1].try_cast("double").alias("v"))


def failed_responses(df: DataFrame, body: str = "body") -> DataFrame:
    """Answers that are no JSON or report no success."""
    status = F.from_json(F.col(body), BODY)["status"]
    return df.where(status.isNull() | (status != "success"))
