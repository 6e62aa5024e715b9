"""Merkle manifest of a dataset: one root for all rows, and a proof for each.

Nodes are hex digests. A block of 256 neighbours holds a level as one string of hex digits: fixed-width
substrings of it hash to the parents, and the substrings left and right of a node are its siblings. Blocks' tops are the
nodes of the next round, so each round leaves one row in 256 and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.ordering import numbered
from telemill.llm.tables import small, stored

FAN = 16  # nodes under one parent
BLOCK = FAN * FAN
HEX = 64  # digits of a digest
RUN = FAN * HEX
GROUPS = 20_000  # groups whose ways to the root, some kilobytes each, are sent to all executors at most


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row's values: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path of ``(left, right)`` sibling strings."""
    return F.aggregate(path, leaf, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings along a path in one string, left to right, lowest level first."""
    return F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), "")


def manifest(docs: DataFrame, leaf: Column, group: str = "source", order: str = "doc_id", carried: Sequence[Column] = ()) -> DataFrame:
    """``(<carried>, leaf, subroot, root, path)`` for every row of ``docs``.

    Rows of a ``group`` (a text column; null is a group of its own) ascend by ``order`` (nulls first, ties by digest); rows that
    are alike in all three follow each other in no defined order, which changes no root. Every 16 nodes in a row have one parent
    until one node, the subroot, is left; subroots in the groups' order (null first, by UTF-8 bytes) lead to the root likewise.
    ``path`` lists ``(left, right)`` siblings from the leaf to the root; a group's only row is its subroot. Texts of any
    length enter through ``leaf`` alone. ``carried`` columns come back as they are and may have any name, as may all others.
    An empty table gives no rows.
    """
    key = F.concat(F.lit("="), F.col(f"`{group}`").cast("string"))
    rest = F.struct(*carried) if carried else F.lit(0)
    rows = docs.select(F.coalesce(key, F.lit("")).alias("g"), F.col(f"`{order}`").alias("o"), leaf.alias("node"), rest.alias("rest"))
    # written first, so that texts are read and hashed once although ranges are sampled before they are dealt
    leaves, tops = _proved(numbered(stored(rows, "digests"), "g", ["o", "node"], "leaves").withColumnRenamed("_pos", "pos"))
    tops = numbered(tops.select(F.lit(0).alias("one"), F.col("g").alias("of"), F.col("top").alias("node")), "one", ["of"], "subroots")
    above, _ = _proved(tops.select(F.lit("").alias("g"), F.col("_pos").alias("pos"), "node", F.struct("of").alias("rest")))
    above = small(above.select(F.col("rest.of").alias("g"), F.col("top").alias("root"), F.col("path").alias("above")), GROUPS)
    joined = leaves.join(above, "g")
    return joined.select(
        *(["rest.*"] if carried else []), F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "above").alias("path")
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    """``(g, block, rows, level, parents, whole, top)``: a block's nodes, their digests and their parents' as strings."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "node", "rest")))
    blocks = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block")).agg(rows.alias("rows"))
    blocks = blocks.withColumn("level", F.array_join(F.transform("rows", lambda r: r["node"]), ""))
    runs = F.sequence(F.lit(0), F.expr(f"int((size(rows) - 1) div {FAN})"))
    parents = F.transform(runs, lambda k: F.sha2(F.substring("level", k * RUN + 1, F.lit(RUN)), 256))
    return blocks.withColumn("parents", F.array_join(parents, ""))


def _proved(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For nodes ``(g, pos, node, rest)``: ``(g, pos, node, rest, top, path)`` with the last node of their group and the way there, and ``(g, top)``."""
    rounds: list[DataFrame] = []
    while True:
        blocks = stored(_blocks(nodes), "blocks")
        later = blocks.where("block > 0")
        # only a group's first block can be all of it
        first = blocks.where("block = 0").join(later.select("g").distinct().withColumn("more", F.lit(True)), "g", "left")
        blocks = first.withColumn("whole", F.col("more").isNull()).drop("more").unionByName(later.withColumn("whole", F.lit(False)))
        alone = F.col("whole") & (F.size("rows") == 1)
        single = F.col("whole") & (F.size("rows") <= FAN)
        top = F.when(alone, F.col("level")).when(single, F.col("parents")).otherwise(F.sha2("parents", 256))
        rounds.append(blocks.withColumn("top", top))
        if later.isEmpty():
            break
        nodes = rounds[-1].where("not whole").select("g", F.col("block").alias("pos"), F.col("top").alias("node"), F.lit(0).alias("rest"))
    tops = reduce(DataFrame.unionByName, [b.where("whole").select("g", "top") for b in rounds])
    empty = F.array().cast("array<struct<left:string,right:string>>")
    above = None
    for blocks in reversed(rounds):
        ended = blocks.where("whole").withColumn("above", empty)
        if above is not None:
            upper = above.select("g", F.col("pos").alias("block"), F.col("top").alias("last"), F.col("path").alias("above"))
            going = blocks.where("not whole").join(upper, ["g", "block"]).withColumn("top", F.col("last")).drop("last")
            ended = ended.unionByName(going)
        above = _opened(ended)
    return above, tops


def _opened(blocks: DataFrame) -> DataFrame:
    """One row per node of blocks with ``above``: the substrings beside the node, then those beside its parent, then the way above."""
    runs = F.transform(
        F.sequence(F.lit(0), F.expr(f"int((size(rows) - 1) div {FAN})")),
        lambda k: F.struct(
            F.slice("rows", k * FAN + 1, FAN).alias("rows"),
            F.substring("level", k * RUN + 1, F.lit(RUN)).alias("run"),
            F.struct(
                F.substring("parents", F.lit(1), k * HEX).alias("left"), F.substring("parents", (k + 1) * HEX + 1, F.lit(RUN)).alias("right")
            ).alias("beside"),
        ),
    )
    levels = F.when(~F.col("whole") | (F.size("rows") > FAN), 2).when(F.size("rows") > 1, 1).otherwise(0)
    opened = blocks.select("g", "top", "above", levels.alias("levels"), F.explode(runs).alias("r"))
    opened = opened.select("g", "top", "above", "levels", "r.run", "r.beside", F.posexplode("r.rows").alias("k", "row"))
    beside = F.struct(
        F.substring("run", F.lit(1), F.col("k") * HEX).alias("left"), F.substring("run", (F.col("k") + 1) * HEX + 1, F.lit(RUN)).alias("right")
    )
    path = F.concat(F.slice(F.array(beside, "beside"), F.lit(1), F.col("levels")), "above")
    return opened.select("g", "row.pos", "row.node", "row.rest", "top", path.alias("path"))
