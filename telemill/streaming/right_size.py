"""Right-sizing on streams: the batch job's steps as chained window aggregates in append mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.timegrid import micros
from telemill.operators.rangefn import present
from telemill.operators.sizing import right_size
from telemill.streaming.rates import interval, stream_rate, with_event_time


def stream_rate_over_time(
    df: DataFrame, key: Sequence[str], d, outer, step, delay: str = "5 minutes", ts: str = "ts", value: str = "v", grain=None
) -> DataFrame:
    """Highest and mean rate over every closed outer range ``(at, key, max_cpu, avg_cpu)``."""
    rates = stream_rate(df, key, d, step, delay, ts, value, grain)
    over = rates.groupBy(F.window("at", interval(micros(outer)), interval(micros(step))), *key).agg(
        F.max("rate").alias("max_cpu"), F.avg("rate").alias("avg_cpu")
    )
    return over.select(F.window_time("window").alias("at"), *key, "max_cpu", "avg_cpu")


def stream_over_time(
    df: DataFrame, key: Sequence[str], outer, step, delay: str = "5 minutes", ts: str = "ts", value: str = "v"
) -> DataFrame:
    """Highest and mean gauge value over every closed range ``(at, key, max_mem, avg_mem)``.

    Samples are summed up per grid cell first, so a sample is not repeated over the ranges it is in.
    """
    timed = present(with_event_time(df, delay, ts), value)
    cells = timed.groupBy(F.window("ev", interval(micros(step))), *key).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("high")
    )
    cells = cells.select(F.window_time("window").alias("at"), *key, "n", "total", "high")
    over = cells.groupBy(F.window("at", interval(micros(outer)), interval(micros(step))), *key).agg(
        F.max("high").alias("max_mem"), (F.sum("total").cast("double") / F.sum("n")).alias("avg_mem")
    )
    return over.select(F.window_time("window").alias("at"), *key, "max_mem", "avg_mem")


def stream_right_size(
    cpu: DataFrame, mem: DataFrame, cpu_key: Sequence[str], mem_key: Sequence[str],
    d="2 minutes", outer="3 hours", step="1 minute", delay: str = "5 minutes", request_cpu: str = "avg", grain=None,
) -> DataFrame:
    """Requests and limits per pod for every closed grid time, each emitted once."""
    cpu_use = stream_rate_over_time(cpu, cpu_key, d, outer, step, delay, grain=grain)
    mem_use = stream_over_time(mem, mem_key, outer, step, delay)
    metrics = ["max_cpu", "avg_cpu", "max_mem", "avg_mem"]

    def widened(df: DataFrame) -> DataFrame:
        return df.select("at", "pod", *[(F.col(m) if m in df.columns else F.lit(None)).cast("double").alias(m) for m in metrics])

    stacked = widened(cpu_use).unionByName(widened(mem_use))
    per_pod = stacked.groupBy(F.window("at", interval(micros(step))), "pod").agg(*[F.sum(m).alias(m) for m in metrics])
    return right_size(per_pod.select(F.col("window.end").alias("t"), "pod", *metrics), request_cpu)
