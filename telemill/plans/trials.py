"""From pod placement and traffic to a ledger of size trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.timegrid import epoch_us
from telemill.operators.rangefn import rate
from telemill.operators.rollup import labelled, sum_by
from telemill.operators.trials import trial_ledger


def pod_throughput(counters: DataFrame, key: Sequence[str], d="1 hour", step="1 hour") -> DataFrame:
    """Rate summed per pod ``(t, pod, rate)``."""
    return sum_by(rate(counters, key, d, step), ["t", "pod"], "rate")


def placement_sizes(pods: DataFrame, nodes: DataFrame) -> DataFrame:
    """Size in force per pod and hour, read off the nodegroup of the pod's node (at that time, if ``nodes`` is a node history).

    Where a pod was seen on several nodes in one hour, the first by name counts. ``nodes`` is
    ``(node, nodegroup)``; a nodegroup that names no size gives NULL.
    """
    placed = labelled(pods, nodes, ["nodegroup"], "ts")
    one = placed.groupBy(F.col("pod").alias("study_id"), F.col("ts").alias("t")).agg(F.min_by("nodegroup", "node").alias("_group"))
    size = F.when(F.col("_group").endswith("large"), "Large").when(F.col("_group").endswith("small"), "Small")
    return one.select("study_id", F.floor(epoch_us("t") / F.lit(3600 * 10**6)).cast("bigint").alias("trial_id"), "t", size.alias("size"))


def ledger(counters: DataFrame, key: Sequence[str], pods: DataFrame, nodes: DataFrame, d="1 hour", step="1 hour") -> DataFrame:
    throughput = pod_throughput(counters, key, d, step).select(F.col("pod").alias("study_id"), "t", F.col("rate").alias("throughput"))
    return trial_ledger(placement_sizes(pods, nodes), throughput)
