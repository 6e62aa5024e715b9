"""Values as of grid times, and the windows that decision times look back on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.timegrid import at, block_of, ceil_to, epoch_us, grid, micros
from telemill.operators.asof import asof_join
from telemill.operators.rangefn import present


#: Width of a block of cells in lookbacks; only the cells that one part in this many reaches are copied to the next block.
BLOCK_LOOKBACKS = 8


def lookup_on_grid(
    samples: DataFrame, key: Sequence[str], step, lookback="5 minutes", ts: str = "ts", value: str | None = "v"
) -> DataFrame:
    """Newest sample of each series at every grid time, no older than the lookback ``(key, t, v)``.

    Only the newest sample of a grid cell can be seen at or after the cell's end, so samples are
    first reduced to one per cell (before the shuffle). A cell serves the grid times until the next cell of its series or until
    it is too old: cells are shuffled by (series, block of time), with those of the block before that are seen
    beyond its end, and repeated only after that. NULL and NaN samples are gaps and hide nothing. Without a ``value``
    column the result tells presence only.
    """
    s, back = micros(step), micros(lookback)
    samples = present(samples, value) if value else samples
    e = epoch_us(ts)
    rows = samples.select(*key, e.alias("_e"), ceil_to(e, s).alias("_cell"), *([F.col(value).alias("_v")] if value else []))
    newest = [F.max("_e").alias("_e"), *([F.max_by("_v", "_e").alias("_v")] if value else [])]
    last = rows.groupBy(*key, "_cell").agg(*newest)
    # t < e + lookback
    until = F.col("_e") + F.lit(back - 1)
    last = last.where(until >= F.col("_cell"))
    if back <= s:
        served = last.withColumn("_t", F.col("_cell"))
    else:
        width = BLOCK_LOOKBACKS * s * -(-back // s)
        own, start = block_of(F.col("_cell"), width), F.col("_block") * F.lit(width)
        cut = last.withColumn("_block", F.explode(F.when(until > (own + 1) * F.lit(width), F.array(own, own + 1)).otherwise(F.array(own))))
        following = F.lead("_cell").over(Window.partitionBy(*key, "_block").orderBy("_cell"))
        stop = F.least(until, F.coalesce(following - 1, start + width), start + width)
        served = cut.withColumn("_times", grid(F.greatest(F.col("_cell"), start + 1), stop, s)).withColumn("_t", F.explode("_times"))
    return served.select(*key, at(F.col("_t")).alias("t"), *([F.col("_v").alias(value)] if value else []))


def lookup_at(
    events: DataFrame, samples: DataFrame, key: Sequence[str], lookback="5 minutes", ts: str = "ts", value: str = "v"
) -> DataFrame:
    """``events`` with the newest sample of their series at their own times, no older than the lookback; NULL where there is none.

    Times need not lie on a grid. NULL and NaN samples are gaps and hide nothing; of samples with the same time the greatest is taken.
    """
    back = micros(lookback)
    return asof_join(events, present(samples, value), key, ts, [value], width=lookback, within=back - 1)


def observation_windows(df: DataFrame, window, period, t: str = "t") -> DataFrame:
    """Give each row to the decision times ``obs_t`` (multiples of the period) whose window
    ``(obs_t - window, obs_t]`` holds it: at most ``ceil(window / period)`` copies of a row."""
    w, p = micros(window), micros(period)
    e = epoch_us(t)
    times = grid(e, e + F.lit(w - 1), p)
    return df.withColumn("_obs", F.explode(times)).withColumn("obs_t", at(F.col("_obs"))).drop("_obs")


def window_slice(df: DataFrame, end, window, t: str = "t") -> DataFrame:
    """Rows of the one window that ends at ``end`` (a timestamp Column or literal)."""
    e, stop = epoch_us(t), epoch_us(F.lit(end) if not hasattr(end, "cast") else end)
    return df.where((e > stop - F.lit(micros(window))) & (e <= stop))
