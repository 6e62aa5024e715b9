"""Range functions over counters and gauges, evaluated at every grid time at once.

Samples are first reduced to cells: one summary row per series and grid cell. Cells are shuffled by
(series, block of time) together with those of the block before that still matter, so each block
finds all its windows by itself and no series has to fit in one task. Inside a block there are two
ways to the same result:

* Short ranges: each cell is repeated over the grid times that see it and hashed by time.
* Long ranges: with blocks as wide as the range, any window ``(t - d, t]`` is a running sum to the end
  of the block before plus one from the start of the own block. The cost per grid time then does not
  depend on how many cells the range holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.timegrid import at, block_of, ceil_to, epoch_us, grid, micros

# Grid times per cell up to which repeating is the faster way (measured on 4 million cells).
REPEAT_COUNTERS, REPEAT_GAUGES = 24, 64
# Width of a block of repeated cells in ranges; one part in this many is copied to the next block.
BLOCK_RANGES = 8


def present(df: DataFrame, value: str) -> DataFrame:
    """Rows with a usable value; NULL and NaN samples mark gaps."""
    df = df.where(F.col(value).isNotNull())
    return df.where(~F.isnan(value)) if dict(df.dtypes)[value] in ("double", "float") else df


def widths(d, step, grain=None) -> tuple[int, int, int, int]:
    """Range, step, cell and grain in microseconds; without a grain the grain is the cell."""
    d, step = micros(d), micros(step)
    cell = gcd(d, step)
    fine = micros(grain) if grain else cell
    if cell % fine:
        raise ValueError("the grain must divide both the range and the step")
    return d, step, cell, fine


def counter_cells(samples: DataFrame, key: Sequence[str], cell: int, ts: str = "ts", value: str = "v") -> DataFrame:
    """First and last sample, sample count and the drops inside each cell.

    The rows are shuffled once, by (series, cell), so even a single series is spread over its cells.
    """
    v = F.col("_v")
    rows = present(samples, value).select(*key, epoch_us(ts).alias("_e"), F.col(value).alias("_v"))
    rows = rows.withColumn("_cell", ceil_to(F.col("_e"), cell))
    before = F.lag("_v").over(Window.partitionBy(*key, "_cell").orderBy("_e", "_v"))
    drop = F.when(v < before, before).otherwise(v - v)
    return (
        rows.withColumn("_drop", drop)
        .groupBy(*key, "_cell")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("_e", "_v")).alias("_first"),
            F.max(F.struct("_e", "_v")).alias("_last"),
            F.sum("_drop").alias("adj"),
        )
        .select(
            *key, "_cell", "n", "adj",
            F.col("_first._e").alias("ft"), F.col("_first._v").alias("fv"),
            F.col("_last._e").alias("lt"), F.col("_last._v").alias("lv"),
        )
    )


def merge_counter_cells(fine: DataFrame, key: Sequence[str], cell: int) -> DataFrame:
    """Counter cells joined to wider ones; the drops between neighbours are added to those inside."""
    rows = fine.withColumn("_cell", ceil_to(F.col("_cell"), cell))
    before = F.lag("lv").over(Window.partitionBy(*key, "_cell").orderBy("ft"))
    between = F.when(F.col("fv") < before, before).otherwise(F.col("fv") - F.col("fv"))
    return (
        rows.withColumn("adj", F.col("adj") + between)
        .groupBy(*key, "_cell")
        .agg(
            F.sum("n").alias("n"), F.sum("adj").alias("adj"),
            F.min("ft").alias("ft"), F.min_by("fv", "ft").alias("fv"), F.max("lt").alias("lt"), F.max_by("lv", "lt").alias("lv"),
        )
    )


def gauge_cells(samples: DataFrame, key: Sequence[str], cell: int, ts: str = "ts", value: str = "v") -> DataFrame:
    """Count, sum, largest and smallest value of each cell, combined before the shuffle."""
    rows = present(samples, value).select(*key, ceil_to(epoch_us(ts), cell).alias("_cell"), F.col(value).alias("_v"))
    return rows.groupBy(*key, "_cell").agg(
        F.count("*").alias("n"), F.sum("_v").alias("total"), F.max("_v").alias("high"), F.min("_v").alias("low")
    )


def _in_both_roles(cells: DataFrame, key: Sequence[str], d: int) -> DataFrame:
    own = block_of(F.col("_cell"), d)
    roles = F.array(F.struct(own.alias("b"), F.lit(0).alias("o")), F.struct((own + 1).alias("b"), F.lit(1).alias("o")))
    return (
        cells.withColumn("_role", F.explode(roles))
        .withColumn("_block", F.col("_role.b"))
        .withColumn("_old", F.col("_role.o"))
        # cells of the own block are met in time order, those of the block before in reverse
        .withColumn("_pos", F.when(F.col("_old") == 0, F.col("_cell")).otherwise(-F.col("_cell")))
        .drop("_role")
        # one shuffle by (series, block) serves the running sums and the merge after them
        .repartition(*key, "_block")
    )


def _served(following: Column, d: int, step: int, cell: int) -> Column:
    """Grid times for which a running value is the right one: until the next cell met takes over."""
    start, here = F.col("_block") * F.lit(d), F.col("_cell")
    as_own = grid(here, F.coalesce(following - cell, start + d), step)
    as_old = grid(F.coalesce(following + d, start + cell), here + (d - cell), step)
    return F.when(F.col("_old") == 0, as_own).otherwise(as_old)


def _repeatable(cells: DataFrame, key: Sequence[str], d: int, step: int, cell: int) -> DataFrame:
    """Cells by block, with the grid times of the block that see them in ``_times``."""
    width = BLOCK_RANGES * d
    own, here = block_of(F.col("_cell"), width), F.col("_cell")
    reaches_on = here + (d - cell) > (own + 1) * F.lit(width)
    start = F.col("_block") * F.lit(width)
    times = grid(F.greatest(here, start + cell), F.least(here + (d - cell), start + width), step)
    return (
        cells.withColumn("_block", F.explode(F.when(reaches_on, F.array(own, own + 1)).otherwise(F.array(own))))
        .repartition(*key, "_block")
        .withColumn("_times", times)
    )


def _role_window(key: Sequence[str]):
    ordered = Window.partitionBy(*key, "_block", "_old").orderBy("_pos")
    return ordered, ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def slide_counter(cells: DataFrame, key: Sequence[str], d: int, step: int, cell: int, limit: int = REPEAT_COUNTERS) -> DataFrame:
    """Merge counter cells into one row per series and grid time: n, ft, fv, lt, lv, adj."""
    merge = _repeated_counter if d // step <= limit else _running_counter
    return merge(cells, key, d, step, cell)


def _repeated_counter(cells: DataFrame, key: Sequence[str], d: int, step: int, cell: int) -> DataFrame:
    before = F.lag("lv").over(Window.partitionBy(*key, "_block").orderBy("_cell"))
    between = F.coalesce(F.when(F.col("fv") < before, before), F.col("fv") - F.col("fv"))
    parts = _repeatable(cells, key, d, step, cell).withColumn("_between", between).withColumn("_t", F.explode("_times"))
    return parts.groupBy(*key, "_block", "_t").agg(
        F.sum("n").alias("n"), F.min("ft").alias("ft"), F.max("lt").alias("lt"),
        F.min_by("fv", "ft").alias("fv"), F.max_by("lv", "lt").alias("lv"),
        # the drop before a window's first cell lies outside of it
        (F.sum(F.col("adj") + F.col("_between")) - F.min_by("_between", "ft")).alias("adj"),
    )


def _running_counter(cells: DataFrame, key: Sequence[str], d: int, step: int, cell: int) -> DataFrame:
    ordered, running = _role_window(key)
    old = F.col("_old") == 1
    fv, lv = F.col("fv"), F.col("lv")
    # drop between this cell and the one met before it, which is the earlier one only in the own block
    earlier, later = F.lag("lv").over(ordered), F.lag("fv").over(ordered)
    between = F.when(old, F.when(later < lv, lv)).otherwise(F.when(fv < earlier, earlier))
    parts = (
        _in_both_roles(cells, key, d)
        .withColumn("_between", F.coalesce(between, fv - fv))
        .withColumn("_next", F.lead("_cell").over(ordered))
        .select(
            *key, "_block", "_old",
            F.sum("n").over(running).alias("n"),
            F.sum(F.col("adj") + F.col("_between")).over(running).alias("adj"),
            F.when(old, F.col("ft")).otherwise(F.first("ft").over(running)).alias("ft"),
            F.when(old, fv).otherwise(F.first("fv").over(running)).alias("fv"),
            F.when(old, F.first("lt").over(running)).otherwise(F.col("lt")).alias("lt"),
            F.when(old, F.first("lv").over(running)).otherwise(lv).alias("lv"),
            _served(F.col("_next"), d, step, cell).alias("_times"),
        )
        .withColumn("_t", F.explode("_times"))
    )

    def of(role: int, name: str) -> Column:
        return F.max(F.when(F.col("_old") == role, F.col(name)))

    merged = parts.groupBy(*key, "_block", "_t").agg(
        F.sum("n").alias("n"), F.min("ft").alias("ft"), F.max("lt").alias("lt"), F.sum("adj").alias("adj"),
        of(1, "fv").alias("_fv1"), of(0, "fv").alias("_fv0"), of(1, "lv").alias("_lv1"), of(0, "lv").alias("_lv0"),
    )
    between_blocks = F.when(F.col("_fv0") < F.col("_lv1"), F.col("_lv1")).otherwise(F.col("adj") - F.col("adj"))
    return merged.select(
        *key, "_t", "n", "ft", "lt",
        F.coalesce("_fv1", "_fv0").alias("fv"), F.coalesce("_lv0", "_lv1").alias("lv"),
        (F.col("adj") + between_blocks).alias("adj"),
    )


def slide_gauge(cells: DataFrame, key: Sequence[str], d: int, step: int, cell: int, limit: int = REPEAT_GAUGES) -> DataFrame:
    """Merge gauge cells into one row per series and grid time: n, total, high, low."""
    if d // step <= limit:
        parts = _repeatable(cells, key, d, step, cell).withColumn("_t", F.explode("_times"))
    else:
        ordered, running = _role_window(key)
        parts = _in_both_roles(cells, key, d).select(
            *key, "_block",
            F.sum("n").over(running).alias("n"), F.sum("total").over(running).alias("total"),
            F.max("high").over(running).alias("high"), F.min("low").over(running).alias("low"),
            _served(F.lead("_cell").over(ordered), d, step, cell).alias("_times"),
        ).withColumn("_t", F.explode("_times"))
    return parts.groupBy(*key, "_block", "_t").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("high").alias("high"), F.min("low").alias("low")
    )


def _increase_parts(samples, key, d, step, ts, value, grain) -> DataFrame:
    d_us, s_us, cell, fine = widths(d, step, grain)
    cells = counter_cells(samples, key, fine, ts, value)
    if fine < cell:
        cells = merge_counter_cells(cells, key, cell)
    merged = slide_counter(cells, key, d_us, s_us, cell)
    enough = merged.where((F.col("n") >= 2) & (F.col("lt") > F.col("ft")))
    return enough.withColumn("inc", F.col("lv") - F.col("fv") + F.col("adj"))


def increase(samples: DataFrame, key: Sequence[str], d, step, ts: str = "ts", value: str = "v", grain=None) -> DataFrame:
    """Growth of each counter over ``(t - d, t]`` with resets added back ``(key, t, inc)``.

    No row where the range holds fewer than two samples. Where one series has so many samples that
    a single cell is too much for a task, ``grain`` names the width of the pieces that are sorted.
    """
    return _increase_parts(samples, key, d, step, ts, value, grain).select(*key, at(F.col("_t")).alias("t"), "inc")


def rate(
    samples: DataFrame, key: Sequence[str], d, step, extrapolate: bool = True, ts: str = "ts", value: str = "v", grain=None
) -> DataFrame:
    """Per-second growth ``(key, t, rate)``.

    With ``extrapolate`` the growth between the first and last sample is extended to the edges of
    the range, by at most half the mean sample distance where the edge is far, and never below zero.
    """
    parts = _increase_parts(samples, key, d, step, ts, value, grain)
    seconds = micros(d) / 1e6
    inc = F.col("inc").cast("double")
    if not extrapolate:
        return parts.select(*key, at(F.col("_t")).alias("t"), (inc / F.lit(seconds)).alias("rate"))
    return parts.select(*key, at(F.col("_t")).alias("t"), extrapolated_rate(inc, micros(d)).alias("rate"))


def extrapolated_rate(inc: Column, d: int) -> Column:
    """Rate from the columns ``_t, n, ft, lt, fv`` of one range and its increase."""
    us = F.lit(1e6)
    sampled = (F.col("lt") - F.col("ft")) / us
    mean_gap = sampled / (F.col("n") - 1)
    head = (F.col("ft") - (F.col("_t") - F.lit(d))) / us
    tail = (F.col("_t") - F.col("lt")) / us
    limit = mean_gap * F.lit(1.1)
    head = F.when(head >= limit, mean_gap / 2).otherwise(head)
    fv = F.col("fv").cast("double")
    # a counter cannot have been below zero before its first sample
    head = F.when((inc > 0) & (fv >= 0), F.least(head, sampled * fv / inc)).otherwise(head)
    tail = F.when(tail >= limit, mean_gap / 2).otherwise(tail)
    return inc * ((sampled + head + tail) / sampled) / F.lit(d / 1e6)


def _finish(merged: DataFrame, key: Sequence[str], aggs: Sequence[str], prefix: str) -> DataFrame:
    found = {
        "max": F.col("high"), "min": F.col("low"), "sum": F.col("total"), "count": F.col("n"),
        "avg": F.col("total").cast("double") / F.col("n"),
    }
    return merged.select(*key, at(F.col("_t")).alias("t"), *[found[a].alias(f"{a}{prefix}") for a in aggs])


def over_time(
    samples: DataFrame, key: Sequence[str], d, step, aggs: Sequence[str] = ("max", "avg"), ts: str = "ts", value: str = "v", suffix: str = ""
) -> DataFrame:
    """Aggregates of a gauge over ``(t - d, t]`` for every grid time ``(key, t, <agg>...)``."""
    d_us, s_us, cell, _ = widths(d, step)
    return _finish(slide_gauge(gauge_cells(samples, key, cell, ts, value), key, d_us, s_us, cell), key, aggs, suffix)


def rate_over_time(
    samples: DataFrame, key: Sequence[str], d, outer, step, aggs: Sequence[str] = ("max", "avg"),
    ts: str = "ts", value: str = "v", suffix: str = "", extrapolate: bool = True,
) -> DataFrame:
    """Aggregates over ``(t - outer, t]`` of the rate taken at every grid time.

    The rate is computed once for all aggregates; each of its rows already is a cell.
    """
    outer_us, s_us = micros(outer), micros(step)
    if outer_us % s_us:
        raise ValueError("the outer range must be a multiple of the step")
    rates = rate(samples, key, d, step, extrapolate, ts, value)
    r = F.col("rate")
    cells = rates.select(
        *key, epoch_us("t").alias("_cell"), F.lit(1).cast("bigint").alias("n"), r.alias("total"), r.alias("high"), r.alias("low")
    )
    return _finish(slide_gauge(cells, key, outer_us, s_us, s_us), key, aggs, suffix)
