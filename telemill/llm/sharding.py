"""Uniform shuffles with exact shard sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.tables import stored

BLOCK_ROWS = 20_000  # rows a block holds on average, while there are fewer than MOST_BLOCKS
MOST_BLOCKS = 4096  # bounds the matrix that the driver draws
SPAN = 40  # standard deviations of a count that are looked at; what lies beyond has no mass in a double


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """How many rows each block sends to each shard: exactly distributed as in a uniform permutation of all rows.

    Row by row: a block's rows are a draw without replacement from the places that the shards have left.
    """
    if sum(blocks) != sum(shards):
        raise ValueError("blocks and shards must hold the same number of rows")
    random = np.random.default_rng(seed)
    left = list(shards)
    out = np.zeros((len(blocks), len(shards)), dtype=np.int64)
    for i, size in enumerate(blocks):
        places = sum(left)
        for j in range(len(shards)):
            out[i, j] = _hypergeometric(random.random(), left[j], places - left[j], size)
            places -= left[j]
            size -= int(out[i, j])
            left[j] -= int(out[i, j])
    return out


def _hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """The value at quantile ``u`` of the number of good ones among ``draws`` without replacement."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = int(SPAN * (1 + (draws * (good / total) * (bad / total)) ** 0.5))
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    up = (good - k[:-1]) * (draws - k[:-1]) / ((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    weight = np.concatenate([[0.0], np.cumsum(np.log(up))])
    mass = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(np.searchsorted(mass, u * mass[-1], side="right"), len(k) - 1)])


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def uniform_shards(df: DataFrame, by: list[Column], shards: int, seed: int = 0, name: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1, sizes at most one apart) and ``slot`` (place in the shard, gapless from 0).

    ``by`` names what tells rows apart; rows alike in all of it may change places with each other, which changes
    nothing else. A row's block and its random order inside follow from ``by``, ``seed`` and a row number that is
    written down first, so a lost executor's rows come out the same again, and a row of which there are copies
    by the million is dealt out like any others. Nulls are values like others; an empty table gives an empty
    result. Columns named like the two new ones, in whatever case, are replaced; others may have any name.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (name.lower(), slot.lower())]
    key = F.xxhash64(F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\0")) for c in by])
    rows = df.select(F.struct(*own).alias("_own") if own else F.lit(0).alias("_own"), key.alias("_key"))
    # copies have the same key and would meet in one block: where they were read tells them apart
    rows = stored(rows.withColumn("_copy", F.monotonically_increasing_id()), "rows")
    rows = rows.withColumn("_random", F.xxhash64(F.lit(seed + 1), "_key", "_copy"))
    total = rows.count()
    count = max(1, min(MOST_BLOCKS, -(-total // BLOCK_ROWS)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 2), "_random"), F.lit(count)).cast("int"))
    held = {r["_block"]: r["count"] for r in rows.groupBy("_block").count().collect()}
    matrix = communication_matrix([held.get(b, 0) for b in range(count)], shard_sizes(total, shards), seed)

    # local permutation, cut by the block's row of the matrix
    cuts = df.sparkSession.createDataFrame([(b, np.cumsum(matrix[b]).tolist()) for b in range(count)], "_block int, _ends array<long>")
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_random", "_key", "_copy"))
    dealt = rows.withColumn("_place", place).join(F.broadcast(cuts), "_block")
    dealt = dealt.withColumn(name, F.size(F.filter("_ends", lambda e: e < F.col("_place"))).cast("int"))

    # permutation inside the shard: cells are ranges of another random number, so no task needs a whole shard
    again = F.xxhash64(F.lit(seed + 3), "_key", "_copy")
    cells = max(1, -(-count // shards))
    dealt = dealt.withColumn("_again", again).withColumn("_cell", F.pmod(F.shiftright("_again", 20), F.lit(cells)).cast("int"))
    dealt = stored(dealt.drop("_ends", "_place", "_random", "_block"), "dealt")
    sizes = {(r[name], r["_cell"]): r["count"] for r in dealt.groupBy(name, "_cell").count().collect()}
    starts, at = [], {}
    for k in sorted(sizes):
        starts.append((*k, at.get(k[0], 0)))
        at[k[0]] = at.get(k[0], 0) + sizes[k]
    offsets = df.sparkSession.createDataFrame(starts, f"{name} int, _cell int, _start long")
    inside = F.row_number().over(Window.partitionBy(name, "_cell").orderBy("_again", "_key", "_copy"))
    return dealt.withColumn("_inside", inside).join(F.broadcast(offsets), [name, "_cell"]).select(
        *(["_own.*"] if own else []), name, (F.col("_start") + F.col("_inside") - 1).cast("long").alias(slot)
    )
