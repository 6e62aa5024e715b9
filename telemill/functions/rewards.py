"""Profit formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: revenue per byte (USD) and seconds per hour
USD_PER_BYTE = 3.33 / 10**9
USD_PER_BYTE_IN_WINDOW = 3.33e-9
SECONDS_PER_HOUR = 3600


def hourly_reward(bytes_per_second: Column, usd_per_hour: Column) -> Column:
    """Hourly revenue of the throughput minus the hourly cost of the nodes."""
    return bytes_per_second * F.lit(USD_PER_BYTE) * F.lit(float(SECONDS_PER_HOUR)) - usd_per_hour


def window_profit(window_bytes: Column, on_large: Column, on_small: Column, large_cost: float, small_cost: float, minutes: float) -> Column:
    """Revenue over one window minus the hourly prices, charged for the part of it each size was on."""
    return (
        F.lit(USD_PER_BYTE_IN_WINDOW) * window_bytes
        - F.lit(large_cost / 60) * on_large * F.lit(float(minutes))
        - F.lit(small_cost / 60) * on_small * F.lit(float(minutes))
    )
