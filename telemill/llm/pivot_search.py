"""Exact top-k search by inner product over a pivot-distance index.

Vectors get one more component that makes all of them equally long, so the largest inner product is the nearest
neighbour. Each is keyed by its nearest pivot and its distance from it; the vectors of one pivot fall into rings.
A query first looks into the rings nearest to it, which bounds how far its k-th neighbour can be, and then into
every other ring that the triangle inequality lets come within that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.tables import stored

PIVOTS, RINGS = 16, 8
SAMPLE = 2000  # vectors among which pivots are chosen, at most
CHUNK = 500  # vectors of a ring that are compared at once
BLOCK = 200  # queries compared at once
SLACK = 1e-6  # of the vectors' length: what rounding may add to a distance


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null or non-finite components."""
    exact = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(exact, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(exact, lambda x: F.floor(x * scale).cast("long")))


def nearest(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """The ``k`` largest integer inner products per query: query_id, rank, ``key``, score; ties go to the smaller key.

    ``rows`` hold a long ``key`` and an array<long> ``vector``; ``is_query`` marks queries. A query meets every row
    but those of its own key. Rows with a null key or vector take no part, rows alike count once, and a shorter
    vector counts as filled up with zeros. Without queries or candidates the result is empty.
    """
    rows = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    rows = stored(rows.distinct(), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    about = rows.agg(F.max(F.size("v")).alias("width"), F.max(squares).alias("length")).first()
    width, length = about["width"] or 1, about["length"] or 0.0
    sample = [r["v"] for r in rows.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).distinct().collect()]
    pivots = _pivots(_matrix_of(sample, width), length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = _nearest_pivot(_matrix(batch.column("v"), width), pivots, length)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance, pa.float64())], [*batch.schema.names, "pivot", "distance"])

    placed = stored(rows.mapInArrow(place, "id long, v array<long>, q boolean, pivot int, distance double"), "placed")
    # equal shares of a pivot's vectors, or fewer rings where distances coincide
    shares = [k / RINGS for k in range(1, RINGS)]
    edges = {r["pivot"]: r["edges"] for r in placed.groupBy("pivot").agg(F.percentile_approx("distance", shares, 1000).alias("edges")).collect()}
    table = placed.sparkSession.createDataFrame(list(edges.items()), "pivot int, edges array<double>")
    ring = F.size(F.filter("edges", lambda e: e < F.col("distance")))
    ringed = placed.join(F.broadcast(table), "pivot").withColumn("cell", F.col("pivot") * RINGS + ring).drop("edges")
    ringed = stored(ringed, "rings")
    rings = ringed.groupBy("cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("held")).orderBy("cell").collect()
    cells = np.array([[r["cell"], r["low"], r["high"], r["held"]] for r in rings], dtype=np.float64).reshape(-1, 4)

    parts = placed.sparkSession.createDataFrame([(r["cell"], -(-r["held"] // CHUNK)) for r in rings], "cell int, parts int")
    chunks = ringed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")))
    chunks = stored(chunks.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows")).drop("part"), "chunks")

    asked = ringed.where("q").select("id", "v", "pivot")
    first = _look(_plan(asked.withColumn("bound", F.lit(None).cast("long")), cells, pivots, width, length, k), chunks, width, k)
    first = stored(first, "first")
    order = Window.partitionBy("query", "asked").orderBy(F.desc("score"), "id")
    kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("asked").alias("v"), F.col("score").alias("bound"))
    rest = _look(_plan(asked.join(kth, ["id", "v"], "left"), cells, pivots, width, length, k, first=False), chunks, width, k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).cast("int").alias("rank")
    return first.unionByName(rest).drop("asked").distinct().select(
        F.col("query").alias("query_id"), rank, F.col("id").alias(key), "score"
    ).where(F.col("rank") <= k)


def _plan(asked: DataFrame, cells: np.ndarray, pivots: np.ndarray, width: int, length: float, k: int, first: bool = True) -> DataFrame:
    """Queries with the rings they look into: first the nearest that hold more than ``k`` rows, later all others within reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("v"), width)
            own = (vectors.astype(np.float64) ** 2).sum(axis=1)
            to_pivot = np.sqrt(np.maximum(own[:, None] + length - 2.0 * (vectors.astype(np.float64) @ pivots[:, :-1].T), 0))
            far = to_pivot[:, (cells[:, 0] // RINGS).astype(int)]
            least = np.maximum(0, np.maximum(far - cells[:, 2], cells[:, 1] - far))
            order = np.argsort(least, axis=1, kind="stable")
            before = np.cumsum(cells[order, 3], axis=1) - cells[order, 3]
            near = np.zeros(least.shape, dtype=bool)
            np.put_along_axis(near, order, before < k + 1, axis=1)
            if not first:
                bound = batch.column("bound").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                reach = np.sqrt(np.maximum(own + length - 2.0 * bound, 0)) + SLACK * np.sqrt(own + length) + 1e-9
                near = ~near & (least <= reach[:, None])
            chosen = [cells[row, 0].astype(np.int32) for row in near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return asked.select("id", "v", "pivot", "bound").mapInArrow(run, "id long, v array<long>, pivot int, bound long, cells array<int>")


def _look(queries: DataFrame, chunks: DataFrame, width: int, k: int) -> DataFrame:
    """(query, asked, id, score): per query and chunk the best ``k`` rows that reach the query's bound."""
    queries = queries.select("id", "v", "pivot", "bound", "cells")
    part = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 16))
    held = stored(queries.withColumn("part", part), "asked")
    blocks = {r["pivot"]: -(-r["count"] // BLOCK) for r in held.groupBy("pivot").count().collect()}
    table = held.sparkSession.createDataFrame(list(blocks.items()), "pivot int, blocks int")
    packed = held.join(F.broadcast(table), "pivot").groupBy("pivot", (F.col("part") % F.col("blocks")).alias("block")).agg(
        F.collect_list(F.struct("id", "v", "bound", "cells")).alias("queries")
    )
    wanted = F.filter("queries", lambda q: F.array_contains(q["cells"], F.col("cell")))
    wanted = F.transform(wanted, lambda q: F.struct(q["id"].alias("id"), q["v"].alias("v"), q["bound"].alias("bound")))
    asking = packed.withColumn("cell", F.explode(F.array_distinct(F.flatten("queries.cells")))).select("cell", wanted.alias("queries"))
    # a block is as many rows as its queries have rings: estimates leave that out and would send all of them through the driver
    pairs = asking.join(chunks.hint("merge"), "cell")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _best(batch.slice(row, 1), width, k)

    return pairs.mapInArrow(score, "query long, asked array<long>, id long, score long")


def _best(pair: pa.RecordBatch, width: int, k: int) -> pa.RecordBatch:
    queries, rows = pair.column("queries").flatten(), pair.column("rows").flatten()
    asked, ids = queries.field("id").to_numpy(zero_copy_only=False), rows.field("id").to_numpy(zero_copy_only=False)
    scores = _products(_matrix(queries.field("v"), width), _matrix(rows.field("v"), width))
    out: list[tuple[int, int, object]] = []
    bounds = queries.field("bound").to_pylist()
    for q in range(len(queries)):
        fits = np.flatnonzero(ids != asked[q])
        if bounds[q] is not None:
            fits = fits[scores[q, fits] >= bounds[q]]
        if len(fits) > k and scores.dtype != object:
            fits = fits[scores[q, fits] >= np.partition(scores[q, fits], -k)[-k]]
        best = sorted(zip((-scores[q, fits]).tolist(), ids[fits].tolist(), strict=True))[:k]
        out += [(q, i, -s) for s, i in best]
    at = pa.array([q for q, _, _ in out], pa.int64())
    return pa.RecordBatch.from_arrays(
        [queries.field("id").take(at), queries.field("v").take(at), pa.array([i for _, i, _ in out], pa.int64()), pa.array([s for _, _, s in out], pa.int64())],
        ["query", "asked", "id", "score"],
    )


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; doubles hold them exactly while they stay below 2 to the 53rd."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def _matrix_of(vectors: list[list[int]], width: int) -> np.ndarray:
    return _matrix(pa.array(vectors, pa.list_(pa.int64())), width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    if len(flat) == out.size:
        return flat.reshape(out.shape).astype(np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _lifted(vectors: np.ndarray, length: float) -> np.ndarray:
    exact = vectors.astype(np.float64)
    return np.hstack([exact, np.sqrt(np.maximum(length - (exact**2).sum(axis=1), 0))[:, None]])


def _pivots(sample: np.ndarray, length: float) -> np.ndarray:
    """Vectors of the sample far from each other: each next one is the farthest from those before."""
    lifted = _lifted(sample, length)
    if not len(lifted):
        return np.zeros((1, sample.shape[1] + 1))
    chosen, gap = [0], np.full(len(lifted), np.inf)
    while len(chosen) < min(PIVOTS, len(lifted)):
        gap = np.minimum(gap, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(gap.argmax()))
    return lifted[chosen]


def _nearest_pivot(vectors: np.ndarray, pivots: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    squared = 2 * length - 2 * (_lifted(vectors, length) @ pivots.T)
    cell = squared.argmin(axis=1)
    return cell, np.sqrt(np.maximum(squared[np.arange(len(cell)), cell], 0))
