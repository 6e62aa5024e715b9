"""Rewards of observation tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.rewards import hourly_reward, window_profit
from telemill.operators.grid import last_value, on_fraction
from telemill.operators.rollup import total_throughput


def with_hourly_reward(
    obs: DataFrame, ifaces: Sequence[str] = ("eth0", "ogstun"), reward: Callable[[Column, Column], Column] = hourly_reward
) -> DataFrame:
    """Add total throughput and reward to observation vectors; ``reward`` maps (throughput, cost) to a Column."""
    with_total = obs.withColumn("throughput", total_throughput(ifaces))
    return with_total.withColumn("reward", reward(F.col("throughput"), F.col("cost")))


def window_reward(
    obs: DataFrame, large_cost: float, small_cost: float, window_minutes: float, samples: int, by: Sequence[str] = ("obs_t",)
) -> DataFrame:
    """Reward of each observation window ``(obs_t, throughput, on_large, on_small, reward)``."""
    per_window = obs.groupBy(*by).agg(
        last_value("throughput").alias("throughput"),
        on_fraction("large_on", samples).alias("on_large"),
        on_fraction("small_on", samples).alias("on_small"),
    )
    profit = window_profit(F.col("throughput"), F.col("on_large"), F.col("on_small"), large_cost, small_cost, window_minutes)
    return per_window.withColumn("reward", profit)
