"""Fixed-length observation windows and their rewards, for all decision times in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators.grid import baseline, fill_zero, interpolate, on_flags, pad_front, resample
from telemill.operators.lookup import lookup_on_grid, observation_windows
from telemill.operators.rangefn import increase
from telemill.operators.reward import window_reward
from telemill.operators.rollup import sum_by, with_instance
from telemill.sources.dimensions import PRICES, SIZES


def throughput_series(samples: DataFrame, key: Sequence[str], step, lookback="5 minutes", mode: str = "raw") -> DataFrame:
    """One total per grid time ``(t, throughput)`` over all series.

    ``mode="raw"`` sums the counters as they are, so a restarted counter lowers the total;
    ``mode="increase"`` sums their growth over each step instead, with resets added back.
    """
    if mode == "increase":
        per_series = increase(samples, key, lookback, step).select("t", F.col("inc").alias("throughput"))
    else:
        per_series = lookup_on_grid(samples, key, step, lookback).select("t", F.col("v").alias("throughput"))
    return sum_by(per_series, ["t"], "throughput")


def windowed_presence(pods: DataFrame, nodes: DataFrame, window, period, step, lookback="5 minutes") -> DataFrame:
    """Instance types in use at each grid time of each window ``(obs_t, t, instance_type)``.

    With a node history, the types are those that an observer at ``obs_t`` reads.
    """
    seen = observation_windows(lookup_on_grid(pods, ["node"], step, lookback, value=None), window, period)
    return with_instance(seen, nodes, "obs_t").select("obs_t", "t", "instance_type")


def observations(
    throughput: DataFrame, presence: DataFrame, window, period, sample_step, samples: int,
    large: str = SIZES["window"]["Large"], small: str = SIZES["window"]["Small"], sticky: bool = True,
) -> DataFrame:
    """``(obs_t, slot, t, throughput, large_on, small_on)`` with exactly ``samples`` rows per window."""
    rows = observation_windows(throughput.withColumn("throughput", F.col("throughput").cast("double")), window, period)
    rows = interpolate(baseline(rows, value="throughput"), value="throughput")
    rows = interpolate(resample(rows, sample_step, value="throughput"), value="throughput")
    rows = on_flags(rows, presence, {"large_on": large, "small_on": small}, sticky)
    rows = fill_zero(pad_front(rows, samples, sample_step), ["throughput"])
    return rows.select("obs_t", "slot", "t", "throughput", "large_on", "small_on")


def observation_rewards(obs: DataFrame, window_minutes: float, samples: int, prices=PRICES) -> DataFrame:
    """Reward of each observation window."""
    return window_reward(obs, prices[SIZES["window"]["Large"]], prices[SIZES["window"]["Small"]], window_minutes, samples)
