"""Rollups over label columns and joins to the node and price dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.operators.asof import asof_join
from telemill.sources.dimensions import PRICES, price_dim


def sum_by(df: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """Sums per group, combined before the shuffle."""
    return df.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])


def align_pod_metrics(cpu: DataFrame, mem: DataFrame) -> DataFrame:
    """``(t, pod, max_cpu, avg_cpu, max_mem, avg_mem)``; a metric without a value stays NULL.

    The two sides are stacked and grouped once, which aligns them like a full outer join would and
    sums the series of each pod in the same shuffle.
    """
    metrics = ["max_cpu", "avg_cpu", "max_mem", "avg_mem"]
    stacked = cpu.unionByName(mem, allowMissingColumns=True)
    return stacked.groupBy("t", "pod").agg(*[F.sum(F.col(m).cast("double")).alias(m) for m in metrics])


def by_direction(tx: DataFrame, rx: DataFrame) -> DataFrame:
    """Transmit and receive rows in one DataFrame with a ``direction`` column."""
    return tx.withColumn("direction", F.lit("tx")).unionByName(rx.withColumn("direction", F.lit("rx")))


def used_nodes(df: DataFrame, *by: str) -> DataFrame:
    """Nodes that occur, each once (per ``by`` columns when given)."""
    return df.select(*by, "node").distinct()


def only_used(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of the node dimension whose node was seen."""
    return nodes.join(seen.select("node").distinct(), "node", "left_semi")


def with_instance(df: DataFrame, nodes: DataFrame, t: str = "t") -> DataFrame:
    """Add each node's instance type: that of ``t`` if ``nodes`` is a node history."""
    return labelled(df, nodes, ["instance_type"], t)


def labelled(df: DataFrame, nodes: DataFrame, columns: Sequence[str], t: str = "t", how: str = "inner", spread: str | None = None) -> DataFrame:
    """Add ``columns`` of the node dimension; of a node history, those in force at ``t``.

    Either is joined on the node. A history holds few ranges per node, of which one at most holds ``t``.
    Whether the dimension is broadcast is left to its measured size. Where a history is too large for that and single nodes
    hold much of ``df``, ``spread`` names a width of time by which the rows of a node are dealt out (an as-of join).
    """
    if spread and "valid_from" in nodes.columns:
        ranges = nodes.select("node", F.col("valid_from").alias("_from"), F.struct("valid_to", *columns).alias("_range"))
        found = asof_join(df, ranges, ["node"], t, ["_range"], "_from", width=spread)
        over = F.col("_range").isNull() | F.col("node").isNull() | (F.col(t).cast("timestamp") >= F.col("_range.valid_to"))
        over = F.coalesce(over, F.lit(False))
        found = found.where(~over) if how == "inner" else found
        return found.select(*df.columns, *[F.when(~over, F.col(f"_range.{c}")).alias(c) for c in columns])
    if "valid_from" not in nodes.columns:
        return df.join(nodes.select("node", *columns), "node", how)
    ranges = nodes.select(F.col("node").alias("_node"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *columns)
    time = F.col(t).cast("timestamp")
    in_force = (time >= F.col("_from")) & (F.col("_to").isNull() | (time < F.col("_to")))
    return df.join(ranges, (F.col("node") == F.col("_node")) & in_force, how).drop("_node", "_from", "_to")


def with_price(df: DataFrame, prices: Mapping[str, float] | DataFrame = PRICES, on_unknown: str = "error") -> DataFrame:
    """Add ``usd_per_hour`` by instance type.

    An unknown type is an error, or NULL with ``on_unknown="null"``. A price list given as a mapping
    is a handful of rows and is broadcast; a DataFrame is joined as its size allows.
    """
    listed = F.broadcast(price_dim(df.sparkSession, prices)) if isinstance(prices, Mapping) else prices
    priced = df.join(listed, "instance_type", "left")
    if on_unknown == "null":
        return priced
    return priced.withColumn("usd_per_hour", F.coalesce("usd_per_hour", _no_price()))


def _no_price() -> Column:
    named = F.coalesce("instance_type", F.lit("NULL"))
    return F.raise_error(F.concat(F.lit("no price for instance type "), named)).cast("double")


def unknown_instance_types(df: DataFrame, prices: Mapping[str, float] | DataFrame = PRICES) -> DataFrame:
    """Instance types that the price list does not have."""
    listed = F.broadcast(price_dim(df.sparkSession, prices)) if isinstance(prices, Mapping) else prices
    return df.select("instance_type").distinct().join(listed, "instance_type", "left_anti")


def infra_cost(traffic: DataFrame, nodes: DataFrame, prices: Mapping[str, float] | DataFrame = PRICES) -> DataFrame:
    """Hourly cost of the known nodes in use at each ``t``, every node counted once ``(t, cost)``.

    With a node history, a node costs what its type of that time costs. A time at which only unknown nodes are in use costs 0.
    """
    priced = with_price(_with_known(used_nodes(traffic, "t"), nodes), prices, on_unknown="null")
    return priced.groupBy("t").agg(_cost())


def _with_known(df: DataFrame, nodes: DataFrame) -> DataFrame:
    return labelled(df, nodes.withColumn("_known", F.lit(True)), ["instance_type", "_known"], how="left")


def _cost() -> Column:
    # nodes outside the dimension carry traffic but are not charged
    return F.coalesce(F.sum(F.when(F.col("_known"), F.coalesce("usd_per_hour", _no_price()))), F.lit(0.0)).alias("cost")


def interface_columns(ifaces: Sequence[str] = ("eth0", "ogstun")) -> list[str]:
    return [f"{direction}_{iface}" for direction in ("rx", "tx") for iface in ifaces]


def _picked(value: str, column: str) -> Column:
    direction, iface = column.split("_", 1)
    return F.sum(F.when((F.col("direction") == direction) & (F.col("iface") == iface), F.col(value))).alias(column)


def pivot_interfaces(df: DataFrame, by: Sequence[str], value: str = "rate", ifaces: Sequence[str] = ("eth0", "ogstun")) -> DataFrame:
    """One column per direction and interface, in a fixed order."""
    return df.groupBy(*by).agg(*[_picked(value, c) for c in interface_columns(ifaces)])


def observation_vector(
    rates: DataFrame, nodes: DataFrame, ifaces: Sequence[str] = ("eth0", "ogstun"), prices: Mapping[str, float] | DataFrame = PRICES
) -> DataFrame:
    """``(t, rx_*..., tx_*..., cost)`` from rates ``(t, node, direction, iface, rate)``.

    Rates are summed per node first, so prices meet one row per node and time, and one more
    grouping gives both the interface sums and the cost.
    """
    columns = interface_columns(ifaces)
    per_node = pivot_interfaces(rates, ["t", "node"], "rate", ifaces)
    priced = with_price(_with_known(per_node, nodes), prices, on_unknown="null")
    return priced.groupBy("t").agg(*[F.sum(c).alias(c) for c in columns], _cost())


def total_throughput(ifaces: Sequence[str] = ("eth0", "ogstun")) -> Column:
    """Sum of all observation columns but the cost."""
    out = F.lit(0.0)
    for c in interface_columns(ifaces):
        out = out + F.coalesce(F.col(c), F.lit(0.0))
    return out
