"""Checks of observation values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: declared bounds of the observation vector and of the window rows
VECTOR_BOUNDS = {
    "rx_eth0": (0.0, 1e10), "rx_ogstun": (0.0, 1e10), "tx_eth0": (0.0, 1e10), "tx_ogstun": (0.0, 1e10), "cost": (0.0, 35.0),
}
WINDOW_BOUNDS = {"throughput": (0.0, float("inf")), "large_on": (0.0, 1.0), "small_on": (0.0, 1.0)}


def bounds_violations(df: DataFrame, bounds: Mapping[str, tuple[float, float]], keep: Sequence[str]) -> DataFrame:
    """One row per value that is missing, not a number or out of its bounds ``(keep..., field, value)``."""
    checks = []
    for name, (low, high) in bounds.items():
        v = F.col(name).cast("double")
        bad = v.isNull() | F.isnan(v) | ~v.between(low, high)
        checks.append(F.when(bad, F.struct(F.lit(name).alias("field"), v.alias("value"))))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(found).alias("_bad")).select(*keep, "_bad.field", "_bad.value")
