"""Landed JSON answers of any kind, read in one pass; whatever cannot be read is kept with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: result types of an answer, and where its parts lie
VECTOR, MATRIX, SCALAR = "vector", "matrix", "scalar"
STATUS, KIND, RESULT, ERROR = "$.status", "$.data.resultType", "$.data.result", "$.errorType"
LABELS, POINT, POINTS = "$.metric", "$.value", "$.values"

NO_JSON, NO_RESULT, UNKNOWN, NO_LABELS, NO_SAMPLES = "no JSON", "no result", "unknown result type", "series without labels", "series without samples"
BAD_TIME, BAD_VALUE = "time is no number", "value is no number"


def parse_answers(df: DataFrame, body: str = "body") -> DataFrame:
    """The input's other columns with ``(kind, labels, ts, v, reason)``: a row per sample, and one per part that cannot be read.

    Instant vectors, ranges and scalars may be mixed; a scalar has no labels. ``reason`` is NULL for a sample. Otherwise it says
    what is wrong with a whole body, one series or one point, and the parts beside it are read all the same. A body that reports an
    error has the reason ``error`` with its type; a successful one without series gives no row. NULL is no JSON.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != body]
    read = df.select(F.struct(*kept).alias("own") if kept else F.lit(0).alias("own"), F.try_parse_json(F.col(f"`{body}`")).alias("answer"))
    kind = _text(F.col("answer"), KIND)
    read = read.select("own", kind.alias("kind"), F.explode(_series(F.col("answer"), kind)).alias("series"))
    points = F.when(F.size("series.points") > 0, F.col("series.points"))
    read = read.select("own", "kind", "series.labels", "series.reason", F.explode_outer(points).alias("point"))
    # decimal keeps the microseconds of an epoch written with a fraction
    ts = F.timestamp_seconds(_text(F.col("point"), "$[0]").try_cast("decimal(20,6)"))
    read = read.select("own", "kind", "labels", ts.alias("ts"), _text(F.col("point"), "$[1]").try_cast("double").alias("v"), "reason")
    wrong = F.when(F.col("ts").isNull(), BAD_TIME).when(F.col("v").isNull(), BAD_VALUE)
    return read.select(*(["own.*"] if kept else []), "kind", "labels", "ts", "v", F.coalesce("reason", wrong).alias("reason"))


def good(parsed: DataFrame) -> DataFrame:
    """Samples of ``parse_answers``."""
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejected(parsed: DataFrame) -> DataFrame:
    """How many bodies, series and points could not be read ``(kind, reason, rejects)``."""
    return parsed.where(F.col("reason").isNotNull()).groupBy("kind", "reason").agg(F.count("*").alias("rejects"))


def _text(part: Column, path: str) -> Column:
    return F.try_variant_get(part, path, "string")


def _list(part: Column, path: str) -> Column:
    return F.try_variant_get(part, path, "array<variant>")


def _one(labels: Column | None = None, points: Column | None = None, reason: Column | None = None) -> Column:
    def or_null(c: Column | None, kind: str) -> Column:
        return (F.lit(None) if c is None else c).cast(kind)

    return F.struct(
        or_null(labels, "map<string,string>").alias("labels"), or_null(points, "array<variant>").alias("points"), or_null(reason, "string").alias("reason")
    )


def _series(answer: Column, kind: Column) -> Column:
    """A struct per series of the answer, or one that says why there is none."""

    def of(one: Column) -> Column:
        labels = F.try_variant_get(one, LABELS, "map<string,string>")
        single = F.try_variant_get(one, POINT, "variant")
        points = F.when(kind == VECTOR, F.when(single.isNotNull(), F.array(single))).otherwise(_list(one, POINTS))
        wrong = F.when(labels.isNull(), NO_LABELS).when(F.coalesce(F.size(points), F.lit(0)) <= 0, NO_SAMPLES)
        return _one(labels, F.when(wrong.isNull(), points), wrong)

    result, status = _list(answer, RESULT), _text(answer, STATUS)
    failed = F.concat(F.lit("error "), F.coalesce(_text(answer, ERROR), F.lit("")))
    body = (
        F.when(answer.isNull(), NO_JSON)
        .when(F.coalesce(status != "success", F.lit(True)), F.rtrim(failed))
        .when(~F.coalesce(kind.isin(VECTOR, MATRIX, SCALAR), F.lit(False)), UNKNOWN)
        .when(result.isNull(), NO_RESULT)
    )
    scalar = F.array(_one(F.create_map().cast("map<string,string>"), F.array(F.try_variant_get(answer, RESULT, "variant"))))
    return F.when(body.isNotNull(), F.array(_one(reason=body))).when(kind == SCALAR, scalar).otherwise(F.transform(result, of))
