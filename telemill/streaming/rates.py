"""Counter growth and rates on streams.

Two chained aggregates: raw samples wait only until their own grid cell is closed by the watermark
and are then replaced by one summary row; the sliding range works on those rows, of which it holds
at most ``range / cell``. Results are emitted once, when their range is closed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.timegrid import epoch_us, micros
from telemill.operators.rangefn import extrapolated_rate, present, widths


def interval(us: int) -> str:
    return f"{us} microseconds"


def with_event_time(df: DataFrame, delay: str, ts: str = "ts", name: str = "ev") -> DataFrame:
    """Add the watermarked event time. It is one microsecond early, which turns Spark's windows
    ``[start, end)`` into ``(start, end]`` as on the batch side."""
    return df.withColumn(name, F.col(ts).cast("timestamp") - F.expr("interval 1 microsecond")).withWatermark(name, delay)


def _drops(items: Column, first: str, last: str) -> Column:
    """Values lost between neighbours: the earlier one's ``last`` wherever the later one starts lower."""
    following = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))).alias("a"), following.alias("b"))
    lost = F.transform(pairs, lambda p: F.when(p["b"][first] < p["a"][last], p["a"][last]))
    zero = items[0][first] - items[0][first]
    return F.aggregate(F.filter(lost, lambda x: x.isNotNull()), zero, lambda acc, x: acc + x)


def stream_counter_cells(df: DataFrame, key: Sequence[str], cell: int, value: str = "v", ts: str = "ts") -> DataFrame:
    """One summary row per series and closed cell; ``df`` carries the event time ``ev``."""
    rows = present(df, value).select(*key, "ev", F.struct(epoch_us(ts).alias("e"), F.col(value).alias("v")).alias("_s"))
    listed = rows.groupBy(F.window("ev", interval(cell)), *key).agg(F.array_sort(F.collect_list("_s")).alias("_a"))
    first, last = F.col("_a")[0], F.element_at("_a", -1)
    return listed.select(
        F.window_time("window").alias("at"), *key,
        F.struct(
            first["e"].alias("ft"), first["v"].alias("fv"), last["e"].alias("lt"), last["v"].alias("lv"),
            F.size("_a").cast("bigint").alias("n"), _drops(F.col("_a"), "v", "v").alias("adj"),
        ).alias("cell"),
    )


def _joined(cells: Column) -> Column:
    """Summary of neighbouring cells, in time order, as one cell."""
    first, last = cells[0], F.element_at(cells, -1)
    inside = F.aggregate(cells, first["fv"] - first["fv"], lambda acc, x: acc + x["adj"])
    return F.struct(
        first["ft"].alias("ft"), first["fv"].alias("fv"), last["lt"].alias("lt"), last["lv"].alias("lv"),
        F.aggregate(cells, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]).alias("n"),
        (inside + _drops(cells, "fv", "lv")).alias("adj"),
    )


def _merged(cells: DataFrame, key: Sequence[str], width: int, slide: int) -> DataFrame:
    listed = cells.groupBy(F.window("at", interval(width), interval(slide)), *key).agg(
        F.array_sort(F.collect_list("cell")).alias("_c")
    )
    return listed.select("window", F.window_time("window").alias("at"), *key, _joined(F.col("_c")).alias("cell"))


def stream_increase(
    df: DataFrame, key: Sequence[str], d, step, delay: str = "5 minutes", ts: str = "ts", value: str = "v", grain=None
) -> DataFrame:
    """Growth over every closed range ``(at, key, t, inc, n, ft, fv, lt, _t)``.

    ``t`` is the range's end; ``at`` is the event time for a following aggregate. ``grain`` names
    the width of the pieces in which samples wait, for series with very many samples per cell.
    """
    d_us, s_us, cell, fine = widths(d, step, grain)
    cells = stream_counter_cells(with_event_time(df, delay, ts), key, fine, value, ts)
    if fine < cell:
        cells = _merged(cells, key, cell, cell).select("at", *key, "cell")
    # Spark's windows cannot slide by more than their width: such steps are picked from a finer slide
    ranges = _merged(cells, key, d_us, s_us if s_us <= d_us else cell)
    out = ranges.select(
        "at", *key, F.col("window.end").alias("t"), F.unix_micros("window.end").alias("_t"),
        "cell.n", "cell.ft", "cell.fv", "cell.lt",
        (F.col("cell.lv") - F.col("cell.fv") + F.col("cell.adj")).alias("inc"),
    )
    return out.where((F.col("n") >= 2) & (F.col("lt") > F.col("ft")) & (F.pmod("_t", F.lit(s_us)) == 0))


def stream_rate(df: DataFrame, key: Sequence[str], d, step, delay: str = "5 minutes", ts: str = "ts", value: str = "v", grain=None) -> DataFrame:
    """Per-second growth of every closed range ``(at, key, t, inc, rate)``."""
    grown = stream_increase(df, key, d, step, delay, ts, value, grain)
    return grown.select("at", *key, "t", "inc", extrapolated_rate(F.col("inc").cast("double"), micros(d)).alias("rate"))
