"""Starting streams and writing their batches so that a repeated batch does no harm."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from telemill.operators.config import apply_updates


def start(
    df: DataFrame, checkpoint: str, sink: str | Callable[[DataFrame, int], None],
    mode: str = "append", available_now: bool = False, every: str | None = None,
) -> StreamingQuery:
    """Start a stream into a parquet folder or a batch function.

    ``available_now`` works off what is there and stops; ``every`` sets the cycle of a running job.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(sink) if callable(sink) else writer.format("parquet").option("path", sink)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state with timers needs; the session's own choice comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Batch function that writes each batch to its own folder; a repeated batch replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def latest_counts(batches: DataFrame) -> DataFrame:
    """Steps per episode from the batches of an update-mode stream of counts: the newest count of every width of time, added up."""
    widths = batches.groupBy("episode", "since").agg(F.max("steps").alias("steps"))
    return widths.groupBy("episode").agg(F.sum("steps").alias("steps"))


def config_updates(configs: DataFrame, path: str, every: int = 20) -> Callable[[DataFrame, int], None]:
    """Batch function that applies config updates by compare-and-set, once per batch; updates may be built on each other.

    Accepted updates are written to ``path/batch=<id>``, rejected ones to ``path/rejected/batch=<id>``. A batch compares with the versions that the
    batches before it left behind, never with its own output, so it can be repeated. Every ``every`` batches all
    versions are written to one of two snapshot folders in turn; a batch reads the newest snapshot and the batches since then, so its cost
    does not grow with the number of batches. ``every`` must not change while a log is in use.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        now = versions_before(configs, path, batch_id, every)
        accepted, rejected = apply_updates(now, batch.select("cfg_id", "seq", "base_sha", "body"), chains=True)
        rejected.write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
        accepted.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            # the other slot holds the snapshot before, which a repetition of this batch starts from
            versions_before(configs, path, batch_id + 1, every, snapshots=batch_id // every).write.mode("overwrite").parquet(
                f"{path}/snapshot/slot={batch_id // every % 2}"
            )

    return apply


def versions_before(configs: DataFrame, path: str, batch_id: int, every: int, snapshots: int | None = None) -> DataFrame:
    """Version hash of every config ``(cfg_id, sha)`` as the batches before ``batch_id`` left it, from the last of ``snapshots`` and what came since."""
    snapshots = batch_id // every if snapshots is None else snapshots
    spark, since = configs.sparkSession, snapshots * every
    given = configs.select("cfg_id", "sha")
    if snapshots:
        known = spark.read.schema(given.schema).parquet(f"{path}/snapshot/slot={(snapshots - 1) % 2}")
        # configs that were added since have no version in the snapshot yet
        given = given.join(known.withColumnRenamed("sha", "_sha"), "cfg_id", "left").select("cfg_id", F.coalesce("_sha", "sha").alias("sha"))
    tail = [f"{path}/batch={b}" for b in range(since, batch_id)]
    if not tail:
        return given
    return _newest(given, spark.read.option("basePath", path).parquet(*tail))


def _newest(given: DataFrame, log: DataFrame) -> DataFrame:
    order = F.struct(F.col("batch").cast("bigint"), "seq")
    last = log.groupBy("cfg_id").agg(F.max_by("sha", order).alias("_sha"))
    return given.join(last, "cfg_id", "left").select("cfg_id", F.coalesce("_sha", "sha").alias("sha"))


def current_versions(configs: DataFrame, path: str) -> DataFrame:
    """Version hash of every config after all batches of the log ``(cfg_id, sha)``."""
    return _newest(configs.select("cfg_id", "sha"), read_batches(configs.sparkSession, path))


class LateRows(StreamingQueryListener):
    """Writes how many rows each batch dropped as older than the watermark to a shared folder.

    The count is of any number of batches and outlives restarts; a batch that is reported again counts once.
    Aggregates count rows after partial combination; a deduplicating step counts input rows. Attach with
    ``record_late`` before the streams start; all streams of the session are recorded.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(state.numRowsDroppedByWatermark for state in event.progress.stateOperators)
        if late:
            self._write(str(event.progress.id), event.progress.batchId, late)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def _write(self, query: str, batch: int, late: int, rows: int = 1) -> None:
        values = F.lit(query).alias("query"), F.lit(batch).cast("bigint").alias("batch"), F.lit(late).cast("bigint").alias("late")
        self._spark.range(0, rows, 1, 1).select(*values).write.mode("append").parquet(self.path)

    def finish(self, query: StreamingQuery, seconds: float = 600) -> None:
        """Wait until all reports of a stopped stream are written: they arrive after the stream has ended."""
        with self._changed:
            if not self._changed.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError("the stream's last reports have not arrived")


def record_late(spark: SparkSession, path: str) -> LateRows:
    """Attach a recorder of late rows; ``spark.streams.removeListener`` detaches it."""
    recorder = LateRows(spark, path)
    recorder._write("", 0, 0, rows=0)  # a folder without rows can be read
    spark.streams.addListener(recorder)
    return recorder


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Late rows per stream and batch ``(query, batch, late)``."""
    return spark.read.parquet(path).groupBy("query", "batch").agg(F.max("late").alias("late"))


def without_repeats(df: DataFrame, ids: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """Samples delivered more than once are kept once; samples later than the delay are dropped."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(ids)
