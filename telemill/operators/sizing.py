"""Resource requests and limits from usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.quantities import LIMIT_HEADROOM, cpu_quantity, memory_quantity


def right_size(usage: DataFrame, request_cpu: str = "avg") -> DataFrame:
    """Requests from average use, limits from the highest use plus headroom, for every pod and time.

    ``usage`` is ``(t, pod, max_cpu, avg_cpu, max_mem, avg_mem)`` in cores and bytes.
    ``request_cpu="max"`` takes the CPU request from the highest use as well.
    """
    if request_cpu not in ("avg", "max"):
        raise ValueError("request_cpu must be 'avg' or 'max'")

    # usage is a sum of doubles in no fixed order; rounding far below a unit keeps the truncation stable
    def mem(name: str):
        return F.round(name, 3)

    def cores(name: str):
        return F.round(name, 9)

    return usage.select(
        "t",
        "pod",
        memory_quantity(mem("avg_mem")).alias("request_memory"),
        cpu_quantity(cores(f"{request_cpu}_cpu")).alias("request_cpu"),
        memory_quantity(mem("max_mem"), LIMIT_HEADROOM).alias("limit_memory"),
        cpu_quantity(cores("max_cpu"), headroom=LIMIT_HEADROOM).alias("limit_cpu"),
    )


def as_actions(sizes: DataFrame, target_pod: str) -> DataFrame:
    """Sizing rows as requested actions ``(target_pod, requests{memory, cpu}, limits{memory, cpu})``."""
    return sizes.select(
        *[c for c in sizes.columns if c not in ("request_memory", "request_cpu", "limit_memory", "limit_cpu")],
        F.lit(target_pod).alias("target_pod"),
        F.struct(F.col("request_memory").alias("memory"), F.col("request_cpu").alias("cpu")).alias("requests"),
        F.struct(F.col("limit_memory").alias("memory"), F.col("limit_cpu").alias("cpu")).alias("limits"),
    )
