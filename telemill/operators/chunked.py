"""Ordered work on long groups, cut into chunks.

A window over a whole series or episode puts all its rows into one task. The helpers here cut each
group into chunks of bounded size, work inside the chunks, and carry only one summary row per chunk
(or a few rows of the next chunk) across the cut. Results are the same as without the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.session import written


def running_total(
    df: DataFrame, key: Sequence[str], chunk: str, order: Sequence[str], value: Column, out: str, reset: Column | None = None
) -> DataFrame:
    """Running sum of ``value`` per ``key`` in ``order``; it starts again at rows where ``reset`` holds.

    ``chunk`` must not decrease along ``order``; ``value`` is a BIGINT, and keys are not NULL. Rows are
    shuffled by (key, chunk), so a key with a large share of the rows is spread over its chunks. The
    carried totals have one row per chunk.
    """
    reset = F.lit(False) if reset is None else reset
    local = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        df.withColumn("_value", value)
        .withColumn("_reset", reset)
        .withColumn("_sum", F.sum("_value").over(local))
        .withColumn("_base", F.last(F.when(F.col("_reset"), F.col("_sum") - F.col("_value")), ignorenulls=True).over(local))
        .withColumn("_local", F.col("_sum") - F.coalesce("_base", F.lit(0)))
    )
    chunks = rows.groupBy(*key, chunk).agg(
        F.max_by("_local", F.struct(*order)).alias("_tail"), F.max(F.col("_base").isNotNull().cast("int")).alias("_cut")
    )
    along = Window.partitionBy(*key).orderBy(chunk)
    carried = (
        chunks.withColumn("_run", F.sum("_cut").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn(
            "_end",
            F.sum("_tail").over(
                Window.partitionBy(*key, "_run").orderBy(chunk).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("_carry", F.lag("_end").over(along))
        .select(*key, chunk, "_carry")
    )
    total = F.col("_local") + F.when(F.col("_base").isNull(), F.coalesce("_carry", F.lit(0))).otherwise(F.lit(0))
    return (
        rows.join(carried, [*key, chunk])
        .withColumn(out, total.cast("bigint"))
        .drop("_value", "_reset", "_sum", "_base", "_local", "_carry")
    )


def number_rows(df: DataFrame, key: Sequence[str], chunk: str, order: Sequence[str], out: str) -> DataFrame:
    """Position of each row in its key, counted from 1."""
    return running_total(df, key, chunk, order, F.lit(1).cast("bigint"), out)


def with_rows_ahead(df: DataFrame, position: str, size: int, ahead: int) -> DataFrame:
    """Cut positions into chunks of ``size`` (column ``_chunk``, the chunk's first position) and copy
    the first ``ahead`` rows of each chunk into the chunk before it, marked ``_guest``.

    A window by (key, ``_chunk``) then sees ``ahead`` following rows of every row that is no guest.
    """
    if not 0 < ahead <= size:
        raise ValueError("ahead must be between 1 and the chunk size")
    inside = F.pmod(F.col(position), F.lit(size))
    home = F.col(position) - inside
    copies = F.when(inside < ahead, F.array(home, home - size)).otherwise(F.array(home))
    return df.withColumn("_chunk", F.explode(copies)).withColumn("_guest", F.col("_chunk") != home)


def range_start(seq: str, width: int) -> Column:
    """First number of the range of ``width`` numbers that holds ``seq``."""
    return F.col(seq) - F.pmod(F.col(seq), F.lit(width))


def dense_index(df: DataFrame, seq: str, out: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2, ... by the unique BIGINT ``seq``, however sparse it is.

    Rows are dealt into ranges of equal size and sorted there once; a range's rows count on from the
    rows of the ranges before it, of which there are as many as the shuffle has partitions.
    """
    # the place inside a range is in the low 33 bits, the range above them; written down, so that both uses see the same ranges
    dealt = df.repartitionByRange(F.col(seq)).sortWithinPartitions(seq).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "dealt").withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.count("*").alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(out, (F.col("_offset") + place).cast("bigint")).drop("_range", "_at", "_offset")
