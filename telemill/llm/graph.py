"""Connected components of large graphs by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.tables import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another one.

    Large-star and small-star steps in turn hang every node on the smallest one it knows of, until each
    component is one star. Edges never grow in number and a hub's edges are only joined with one row of
    minima, which Spark may split; no task or driver holds a component. Edges with a null end count for nothing.
    """
    now = _down(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null"))
    now, known = stored(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == known or not state[0]:
            break
        known = state
        now = stored(_small_star(_large_star(now)), "edges")
    stars = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.unionByName(roots)


def _down(pairs: DataFrame) -> DataFrame:
    """Every edge once, from the larger node to the smaller."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node hang on the smallest of the node and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # for a node without smaller neighbours the least is itself: those edges stay as they are
    return edges.withColumnsRenamed({"u": "x", "v": "u"}).join(least, "u", "left").select(
        F.col("x").alias("u"), F.coalesce("m", "u").alias("v")
    ).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _down(
        edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
    )
