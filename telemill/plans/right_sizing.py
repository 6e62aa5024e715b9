"""From samples to resource requests and limits, for all pods and all times in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from telemill.operators.rangefn import over_time, rate_over_time
from telemill.operators.rollup import align_pod_metrics
from telemill.operators.sizing import right_size


def pod_usage(
    cpu: DataFrame, mem: DataFrame, cpu_key: Sequence[str], mem_key: Sequence[str], d="2 minutes", outer="3 hours", step="1 minute"
) -> DataFrame:
    """Highest and average CPU and memory of each pod ``(t, pod, max_cpu, avg_cpu, max_mem, avg_mem)``.

    ``cpu`` holds CPU-seconds counters, ``mem`` gauges in bytes; both keys must name ``pod``.
    """
    cpu_use = rate_over_time(cpu, cpu_key, d, outer, step, suffix="_cpu")
    mem_use = over_time(mem, mem_key, outer, step, suffix="_mem")
    return align_pod_metrics(cpu_use.drop(*_others(cpu_key)), mem_use.drop(*_others(mem_key)))


def _others(key: Sequence[str]) -> list[str]:
    return [k for k in key if k != "pod"]


def right_sizing(cpu, mem, cpu_key, mem_key, d="2 minutes", outer="3 hours", step="1 minute", request_cpu="avg") -> DataFrame:
    """Requests and limits ``(t, pod, request_memory, request_cpu, limit_memory, limit_cpu)``."""
    return right_size(pod_usage(cpu, mem, cpu_key, mem_key, d, outer, step), request_cpu)
