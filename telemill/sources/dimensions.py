"""Dimension tables: nodes, prices, node sizes and action codes."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemill.functions.labels import instance_type, matches, nodegroup
from telemill.functions.timegrid import at, epoch_us, floor_to, micros

# fixed values: USD per hour by instance type
PRICES = {"t2.micro": 0.0116, "t3.medium": 0.0416, "m4.large": 0.10, "m4.xlarge": 0.20, "m4.2xlarge": 0.40}

# fixed values: instance type behind each size; the two agents do not agree on Large
SIZES = {
    "bandit": {"Small": "t3.medium", "Large": "m4.large"},
    "window": {"Small": "t3.medium", "Large": "m4.xlarge"},
}

# fixed values: size asked for by each action code; NULL asks for no change
ACTIONS = {
    "q_learning": {0: "Small", 1: "Large"},
    "window": {0: None, 1: "Large", 2: "Small"},
}


def node_dim(info: DataFrame, nodegroup_pattern: str = "upf.*") -> DataFrame:
    """Latest labels of each node ``(node, instance_type, nodegroup)``.

    ``info`` holds ``(node, labels MAP, ts)``. The newest row per node is found by an aggregate
    that is combined before the shuffle, so a node with very many rows costs no more than others.
    """
    rows = info.select("node", "ts", instance_type("labels").alias("instance_type"), nodegroup("labels").alias("nodegroup"))
    wanted = rows.where(matches("nodegroup", nodegroup_pattern)) if nodegroup_pattern else rows
    return last_label_per_node(wanted)


def last_label_per_node(rows: DataFrame) -> DataFrame:
    """One row per node with the newest instance type and nodegroup.

    Rows are first reduced to the distinct label sets of each node, which hashes and combines before
    the shuffle; only those few are compared by time.
    """
    sets = rows.groupBy("node", "instance_type", "nodegroup").agg(F.max("ts").alias("ts"))
    newest = F.max(F.struct("ts", "instance_type", "nodegroup")).alias("_last")
    return sets.groupBy("node").agg(newest).select("node", "_last.instance_type", "_last.nodegroup")


def node_history(info: DataFrame, nodegroup_pattern: str = "upf.*") -> DataFrame:
    """Labels of each node over time ``(node, instance_type, nodegroup, valid_from, valid_to)``, one row per change.

    Labels hold from the sample that first shows them, ``valid_from``, until other labels are seen, ``valid_to``
    (NULL: still). Of several samples at one time the largest labels count. The nodegroup is matched after
    the ranges are made, so a node that leaves the group is out of it from then on. Samples without node
    or time are left out.

    Changes are found within each node and hour first; a node's hours meet in one task only as one row
    per hour and change.
    """
    rows = info.where(F.col("node").isNotNull() & F.col("ts").isNotNull()).select(
        "node", epoch_us("ts").alias("_e"), F.struct(instance_type("labels").alias("instance_type"), nodegroup("labels").alias("nodegroup")).alias("_labels")
    )
    hourly = rows.withColumn("_hour", floor_to(F.col("_e"), micros("1 hour")))
    changes = _changes(hourly, Window.partitionBy("node", "_hour").orderBy("_e", "_labels"))
    whole = Window.partitionBy("node").orderBy("_e", "_labels")
    ranges = _changes(changes, whole).withColumn("_end", F.lead("_e").over(whole)).where(F.col("_end").isNull() | (F.col("_end") > F.col("_e")))
    out = ranges.select("node", "_labels.*", at(F.col("_e")).alias("valid_from"), at(F.col("_end")).alias("valid_to"))
    return out.where(matches("nodegroup", nodegroup_pattern)) if nodegroup_pattern else out


def _changes(rows: DataFrame, ordered) -> DataFrame:
    """Rows whose labels differ from the row's before them, and each group's first row."""
    before = rows.withColumn("_before", F.lag("_labels").over(ordered))
    return before.where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_labels"))).drop("_before")


def price_dim(spark: SparkSession, prices: Mapping[str, float] = PRICES) -> DataFrame:
    """Price list as a DataFrame ``(instance_type, usd_per_hour)``."""
    table = pa.table({"instance_type": list(prices), "usd_per_hour": pa.array(prices.values(), pa.float64())})
    return spark.createDataFrame(table)


def size_cost(size: Column, agent: str = "bandit", prices: Mapping[str, float] = PRICES) -> Column:
    """Hourly price of a size; NULL for any other text."""
    out = F.lit(None).cast("double")
    for name, kind in SIZES[agent].items():
        out = F.when(size == name, F.lit(prices[kind])).otherwise(out)
    return out


def decode_action(action: Column, agent: str) -> Column:
    """Size asked for by an action code; NULL for no change and for unknown codes."""
    out = F.lit(None).cast("string")
    for code, size in ACTIONS[agent].items():
        if size is not None:
            out = F.when(action == code, F.lit(size)).otherwise(out)
    return out
