"""A replay table on storage that keeps the newest rows: bounded when it is written, not when it is read.

Rows lie in one folder per range of sequence numbers. An append writes those of its rows that its own newest rows reach, counts the
ranges that are there, and deletes the folders that the newest rows cannot reach any more, so the table never holds many more rows than asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemill.operators.chunked import range_start
from telemill.operators.replay import retain_latest

RANGE = "seq_range"


def append(rows: DataFrame, path: str, batch_id: int, n: int, seq: str = "seq", width: int = 10_000) -> None:
    """Add rows with unique, non-NULL BIGINT ``seq`` as a batch; afterwards whole ranges below the newest ``n`` rows are gone.

    At most ``n`` rows and those of one range of ``width`` numbers stay. A batch that is repeated replaces what it wrote before; an
    append that was stopped leaves at most some folders too many, which the next one deletes. One writer at a time. Rows
    that are older than everything kept are dropped again, and an empty batch changes nothing. ``n`` must not grow from one append to the next,
    for what is gone does not come back. ``rows`` are read twice: their ranges are counted first, so that no folder is written to be deleted at once.
    """
    spark = rows.sparkSession
    placed = rows.withColumn(RANGE, range_start(seq, width)).withColumn("batch", F.lit(batch_id))
    reached = _oldest_range(placed.select(RANGE), n)
    if reached is not None:
        placed = placed.where(F.col(RANGE).isNull() | (F.col(RANGE) >= reached))
    # few files a folder; a range with most of a batch's rows is still split
    placed = placed.hint("rebalance", RANGE)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE, "batch").parquet(path)
    oldest = _oldest_kept(spark, path, n)
    if oldest is not None:
        _drop_below(spark, path, oldest)


def kept(spark: SparkSession, path: str, n: int, seq: str = "seq") -> DataFrame:
    """The newest ``n`` rows of the table, newest first."""
    return retain_latest(spark.read.parquet(path).drop(RANGE, "batch"), n, seq)


def replay_folder(path: str, n: int, seq: str = "seq", width: int = 10_000) -> Callable[[DataFrame, int], None]:
    """Batch function of a stream that appends each batch to the table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read twice
        try:
            append(batch, path, batch_id, n, seq, width)
        finally:
            batch.unpersist()

    return write


def _oldest_kept(spark: SparkSession, path: str, n: int) -> int | None:
    """The lowest range of the table that holds one of the newest ``n`` rows. Rows are counted from the files' footers."""
    counts = _rows(spark, path)
    return None if counts is None else _oldest_range(counts, n)


def _oldest_range(ranges: DataFrame, n: int) -> int | None:
    """The lowest range that holds one of the newest ``n`` rows, of which ``ranges`` has the range each.

    A range has a row at least, so the newest ``n`` ranges suffice, and the window sorts no more of them.
    """
    newest = ranges.groupBy(RANGE).agg(F.count("*").alias("rows")).orderBy(F.desc(RANGE)).limit(max(n, 1))
    newer = F.coalesce(F.sum("rows").over(Window.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return newest.withColumn("newer", newer).where(F.col("newer") < max(n, 1)).agg(F.min(RANGE)).first()[0]


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The range of every row; None for a table that has no folder yet."""
    if not _ranges(spark, path):
        return None
    return spark.read.parquet(path).select(F.col(RANGE).cast("bigint").alias(RANGE))


def _ranges(spark: SparkSession, path: str) -> list[tuple[int, object]]:
    """Folders of the table by range: as many as ranges are kept, and those of one batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder)]
    return [(int(p.getName().split("=")[1]), p) for p in found if p.getName().startswith(f"{RANGE}=") and not p.getName().endswith("__")]


def _drop_below(spark: SparkSession, path: str, oldest: int) -> None:
    for start, folder in _ranges(spark, path):
        if start < oldest:
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
