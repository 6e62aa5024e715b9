"""As-of joins at arbitrary times, for keys of any size.

Both sides are merged by (key, block of time). Inside a block a running maximum finds the newest earlier row; across
blocks one carry row per block stands for all rows before it. Carries are found level by level, 1,024 blocks at a time,
so no task holds a key's rows nor all of its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.timegrid import epoch_us, micros

FAN = 1_024
LEFT, RIGHT, CARRY = 1, 0, -1


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, columns: Sequence[str], right_on: str | None = None,
    width: str | int = "1 hour", direction: str = "backward", exact: bool = True, within: str | int | None = None, levels: int = 3,
) -> DataFrame:
    """``left`` with ``columns`` of the newest row of ``right`` whose ``right_on`` is not after ``on``.

    Times may be timestamps (``width`` and ``within`` are durations) or BIGINT numbers (plain numbers). ``direction="forward"``
    takes the earliest row not before ``on``; ``exact=False`` leaves rows of the same time out; ``within`` bounds the distance. Of
    right rows with the same key and time the one with the greatest ``columns`` is taken. NULL keys equal each other; a NULL
    time finds nothing and is found by nothing. Rows of ``left`` without a match have NULLs; names of working columns may occur in either side.

    ``width`` should hold no more rows of a key than one task takes; a key's last level has its range over ``width`` * 1024^(levels-1) rows.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction!r}")
    right_on = right_on or on
    sign = 1 if direction == "backward" else -1
    size = width if isinstance(width, int) else micros(width)
    place = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]

    def timed(df: DataFrame, c: str, packed: Column) -> DataFrame:
        time = _number(df, c) * F.lit(sign)
        return df.select(*place, time.alias("at"), packed).withColumn("block", F.expr(f"(at - pmod(at, {size}L)) div {size}L"))

    mine = timed(left, on, F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
    found = F.struct(F.lit(True).alias("hit"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
    theirs = timed(right, right_on, found.alias("found")).where("at is not null").select(
        *names, "block", "at", F.struct("at", "found").alias("best")
    )
    lasts = theirs.groupBy(*names, "block").agg(F.max("best").alias("best"), F.lit(False).alias("asked"))
    asked = mine.where("at is not null").select(*names, "block").distinct().select(*names, "block", F.lit(None).cast(lasts.schema["best"].dataType).alias("best"), F.lit(True).alias("asked"))
    carries = _carries(lasts.unionByName(asked).groupBy(*names, "block").agg(F.max("best").alias("best"), F.max("asked").alias("asked")), names, levels)
    kind = F.lit(LEFT if exact else RIGHT)
    merged = mine.withColumn("kind", kind).unionByName(
        theirs.withColumn("kind", F.lit(RIGHT if exact else LEFT)), allowMissingColumns=True
    ).unionByName(carries.where("asked and best is not null").select(*names, "block", "best", F.lit(CARRY).alias("kind")), allowMissingColumns=True)
    # carries come first in their block, then rows by time; of equal times the right ones where they count
    ahead = Window.partitionBy(*names, "block").orderBy(F.col("kind") != CARRY, "at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = merged.withColumn("newest", F.max("best").over(ahead)).where(F.col("row").isNotNull())
    hit = F.col("at").isNotNull() & F.col("newest").isNotNull()
    if within is not None:
        reach = within if isinstance(within, int) else micros(within)
        hit &= F.col("at") - F.col("newest.at") <= F.lit(reach)
    return seen.select("row.*", *[F.when(hit, F.col(f"newest.found.v{i}")).alias(c) for i, c in enumerate(columns)])


def _number(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return epoch_us(c) if kind.startswith("timestamp") or kind == "date" else F.col(f"`{c}`").cast("bigint")


def _carries(blocks: DataFrame, names: Sequence[str], levels: int) -> DataFrame:
    """``blocks`` (key, block, best, asked) with ``best`` replaced by the greatest of all earlier blocks of the key."""
    if levels <= 1:
        before = Window.partitionBy(*names).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return blocks.withColumn("best", F.max("best").over(before))
    upper = blocks.withColumn("upper", F.expr(f"(block - pmod(block, {FAN}L)) div {FAN}L"))
    above = upper.groupBy(*names, F.col("upper").alias("block")).agg(F.max("best").alias("best"), F.lit(True).alias("asked"))
    above = _carries(above, names, levels - 1).where("best is not null")
    entered = above.select(*names, F.col("block").alias("upper"), F.lit(None).cast("bigint").alias("block"), "best", F.lit(False).alias("asked"))
    before = Window.partitionBy(*names, "upper").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return upper.unionByName(entered).withColumn("best", F.max("best").over(before)).where("block is not null").drop("upper")
