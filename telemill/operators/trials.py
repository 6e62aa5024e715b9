"""Trials of node sizes and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.rewards import hourly_reward
from telemill.sources.dimensions import size_cost


def trial_ledger(sizes: DataFrame, throughput: DataFrame, agent: str = "bandit") -> DataFrame:
    """One row per trial with its size, throughput, cost and reward.

    ``sizes`` is ``(study_id, trial_id, t, size)``, ``throughput`` ``(study_id, t, throughput)``.
    A size without a price has neither cost nor reward.
    """
    rows = sizes.join(throughput, ["study_id", "t"]).withColumn("cost", size_cost(F.col("size"), agent))
    return rows.withColumn("reward", hourly_reward(F.col("throughput"), F.col("cost"))).select(
        "study_id", "trial_id", "size", "throughput", "cost", "reward"
    )


def best_arm(trials: DataFrame) -> DataFrame:
    """Per study and size: trials, mean reward, best reward and the first trial that reached it."""
    rewarded = trials.where(F.col("reward").isNotNull())
    return (
        rewarded.groupBy("study_id", "size")
        .agg(
            F.count("*").alias("trials"),
            F.avg("reward").alias("mean_reward"),
            F.max(F.struct(F.col("reward").alias("r"), (-F.col("trial_id")).alias("k"))).alias("_best"),
        )
        .select(
            "study_id", "size", "trials", "mean_reward",
            F.col("_best.r").alias("best_reward"), (-F.col("_best.k")).alias("best_trial"),
        )
    )
