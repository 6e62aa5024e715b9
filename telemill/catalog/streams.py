"""Registered streaming queries.

Each writes its input, derived from the test tables, to the shared scratch folder, streams it once
and returns what the sink holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.catalog import adapters as ad
from telemill.catalog.adapters import OUTER_D, RATE_D, SERIES, STEP
from telemill.catalog.batch import shown
from telemill.operators import config, sizing
from telemill.session import scratch_dir
from telemill.streaming import rates, right_size, sinks, transitions

QUERIES: dict = {}
DELAY = "1 hour"
SPREAD = "15 days"
GAP, SHORT_GAP = "40 days", "3 days"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def landed(spark: SparkSession, df: DataFrame, path: str | None = None) -> str:
    """Write a stream's input with a timestamp that watermarks accept."""
    path = path or scratch_dir(spark, "landed")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(path)
    return path


def stream_of(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(path)


def run(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Stream into a parquet folder until the input is used up and read the folder."""
    out = scratch_dir(spark, "out")
    query = sinks.start(df, scratch_dir(spark, "checkpoint"), out, mode, available_now=True)
    query.awaitTermination()
    return spark.read.parquet(out)


@query
def stream_increase(spark, d):
    path = landed(spark, ad.counters(spark, d))
    return shown(run(spark, rates.stream_rate(stream_of(spark, path), SERIES, RATE_D, STEP, DELAY)).select(*SERIES, "t", "inc"))


@query
def stream_rate(spark, d):
    path = landed(spark, ad.counters(spark, d, "rx", "tx"))
    return shown(run(spark, rates.stream_rate(stream_of(spark, path), SERIES, RATE_D, STEP, DELAY)).select(*SERIES, "t", "rate"))


def _sizes(spark, d, pods: str = ""):
    """Sizes of the pods whose name holds ``pods``; other pods are left out before the watermark."""
    wanted = F.col("pod").contains(pods)
    cpu, mem = landed(spark, ad.counters(spark, d, "cpu")), landed(spark, ad.gauges(spark, d))
    return right_size.stream_right_size(
        stream_of(spark, cpu).where(wanted), stream_of(spark, mem).where(wanted), SERIES, ["pod", "container"],
        RATE_D, OUTER_D, STEP, DELAY,
    )


@query
def stream_right_size(spark, d):
    return shown(run(spark, _sizes(spark, d)))


@query
def stream_actions(spark, d):
    """One actions folder per cycle, from the sizes of the access pods."""
    out = scratch_dir(spark, "actions")
    actions = sizing.as_actions(_sizes(spark, d, "amf"), "amf")
    sinks.start(actions, scratch_dir(spark, "checkpoint"), sinks.batch_folder(out), available_now=True).awaitTermination()
    rows = sinks.read_batches(spark, out)
    return shown(rows.select(
        "t", "pod", "target_pod", F.col("requests.memory").alias("request_memory"), F.col("requests.cpu").alias("request_cpu"),
        F.col("limits.memory").alias("limit_memory"), F.col("limits.cpu").alias("limit_cpu"),
    ))


def _config_log(spark, d):
    """Updates of the config documents arrive in three deliveries, the later ones made from old versions."""
    configs = ad.configs(spark, d)
    limits = config.as_updates(config.patch_limits(configs, ad.limit_actions(spark, d), "amf"), F.col("cfg_id") * 2)
    groups = config.as_updates(config.patch_nodegroup(configs, ad.nodegroup_actions(spark, d), "upf"), F.col("cfg_id") * 2 + 1)
    path, log, checkpoint = scratch_dir(spark, "updates"), scratch_dir(spark, "versions"), scratch_dir(spark, "checkpoint")
    even = F.col("cfg_id") % 2 == 0
    for delivery in (limits.where(even), groups, limits.where(~even)):
        delivery.write.mode("append").parquet(path)
        sinks.start(stream_of(spark, path), checkpoint, sinks.config_updates(configs, log), available_now=True).awaitTermination()
    return configs, log


@query
def stream_config_updates(spark, d):
    return sinks.current_versions(*_config_log(spark, d))


@query
def stream_rejected_updates(spark, d):
    """Updates that were made from a version that another update had replaced."""
    _, log = _config_log(spark, d)
    return sinks.read_batches(spark, f"{log}/rejected").select("cfg_id", "seq", "base_sha")


def _transitions(spark, d):
    path = landed(spark, ad.steps(spark, d, with_ts=True))
    return transitions.stream_transitions(stream_of(spark, path), ["seq", "throughput", "action"], GAP, DELAY)


@query
def stream_transitions(spark, d):
    with sinks.rocksdb(spark):
        return shown(run(spark, _transitions(spark, d).drop("ts")))


@query
def stream_unpaired_steps(spark, d):
    """Steps whose successor came more than three days later or not at all."""
    path = landed(spark, ad.steps(spark, d, with_ts=True).select("episode", "step", "seq", "ts"))
    waiting = transitions.stream_unpaired_steps(stream_of(spark, path), SHORT_GAP, DELAY)
    with sinks.rocksdb(spark):
        return run(spark, waiting.drop("ts"))


@query
def replay_stream(spark, d):
    """Every transition appended to the replay table."""
    out = scratch_dir(spark, "replay")
    with sinks.rocksdb(spark):
        query = sinks.start(_transitions(spark, d), scratch_dir(spark, "checkpoint"), sinks.batch_folder(out), available_now=True)
        query.awaitTermination()
    return shown(sinks.read_batches(spark, out).select("episode", "step", "seq", "action", "next_seq", "next_throughput"))


@query
def stream_step_counter(spark, d):
    path = landed(spark, ad.steps(spark, d, with_ts=True))
    counts, out = transitions.stream_step_counts(stream_of(spark, path), DELAY), scratch_dir(spark, "counts")
    sinks.start(counts, scratch_dir(spark, "checkpoint"), sinks.batch_folder(out), "update", available_now=True).awaitTermination()
    return shown(sinks.latest_counts(sinks.read_batches(spark, out)))


@query
def late_samples(spark, d):
    """The month's first half arrives last: rows kept, and rows dropped as late.

    A stream drops late rows by the watermark of the batch before, hence three deliveries.
    """
    rows, day = ad.gauges(spark, d), F.dayofmonth("ts")
    path = landed(spark, rows.where(day > 20))
    landed(spark, rows.where((day > 15) & (day <= 20)), path)
    landed(spark, rows.where(day <= 15), path)
    out = scratch_dir(spark, "kept")
    kept = sinks.without_repeats(stream_of(spark, path, maxFilesPerTrigger=1), ["event_id"], SPREAD)
    late = sinks.record_late(spark, scratch_dir(spark, "late"))
    query = sinks.start(kept, scratch_dir(spark, "checkpoint"), out, available_now=True)
    query.awaitTermination()
    late.finish(query)
    spark.streams.removeListener(late)
    mine = sinks.late_rows(spark, late.path).where(F.col("query") == str(query.id))
    counts = spark.read.parquet(out).select(F.lit(1).alias("kept"), F.lit(0).alias("late")).unionByName(mine.select(F.lit(0).alias("kept"), "late"))
    return counts.agg(F.sum("kept").cast("bigint").alias("kept"), F.sum("late").alias("late"))
