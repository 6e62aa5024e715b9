"""Time steps, transitions and replay tables.

Steps are ordered by number inside an episode; numbers may be missing. The numbers cut episodes into chunks, so an
episode of any length is spread over tasks and only a few rows are copied across each cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators.chunked import dense_index, range_start
from telemill.session import written

CHUNK = 10_000
QUANTILES, SKETCH = 1_000, 10_000  # quantiles of a sequence that are known, and the ranks that its sketch tells apart

# fixed values: step types
FIRST, MID = 0, 1


def timesteps(obs: DataFrame, step: str = "step", episode: str = "episode") -> DataFrame:
    """Observation rows with their discount and step type: 0 for the lowest step of an episode, 1 for the others.

    Rows meet their episode's lowest step by episode and step, so a long episode is spread. A NULL step is never the lowest.
    """
    first = obs.where(F.col(step).isNotNull()).groupBy(episode).agg(F.min(step).alias(step)).withColumn("_first", F.lit(FIRST))
    kind = F.coalesce("y._first", F.lit(MID))
    return _null_safe(obs, first, [episode, step], "left").select(*[F.col(f"x.{c}") for c in obs.columns], F.lit(1.0).alias("discount"), kind.alias("step_type"))


def _with_following(rows: DataFrame, ahead: int, episode: str, step: str, chunk: int) -> DataFrame:
    """Rows with ``_ahead``, the next ``ahead`` rows of the episode as far as there are any, whatever the distance.

    Rows are shuffled once, by episode and block of ``chunk`` step numbers. A block's last rows take the first rows of the blocks
    that follow; only those first rows meet per episode. NULL is an episode like others; a row with a NULL step has no next.
    """
    # a NULL inside a struct equals another one in joins, too; first rows come from the same shuffle, so they carry whole rows
    cut = rows.select(
        F.struct(*rows.columns).alias("_row"), F.struct(episode).alias("_key"), F.col(step).alias("_step"),
        (F.col(step) - F.pmod(F.col(step), F.lit(chunk))).alias("_block"),
    )
    inside = Window.partitionBy("_key", "_block").orderBy("_step")
    after = F.collect_list("_row").over(inside.rowsBetween(1, ahead)) if ahead > 1 else F.array_compact(F.array(F.lead("_row").over(inside)))
    heads = cut.withColumn("_earlier", F.lag(F.lit(1), ahead).over(inside)).where(F.col("_earlier").isNull())
    along = Window.partitionBy("_key").orderBy("_step")
    beyond = heads.select(
        "_key", "_block", F.collect_list("_row").over(along.rowsBetween(1, ahead)).alias("_beyond"), F.lead("_block").over(along).alias("_later")
    ).where(F.col("_later") != F.col("_block"))
    found = cut.withColumn("_after", after).join(beyond.drop("_later"), ["_key", "_block"], "left")
    followed = F.concat("_after", F.slice(F.coalesce("_beyond", F.array()), F.lit(1), F.lit(ahead) - F.size("_after")))
    known = F.when(F.col("_block").isNotNull(), followed).otherwise(F.array().cast(found.schema["_after"].dataType))
    return found.select("_row.*", known.alias("_ahead"))


def transition_pairs(
    steps: DataFrame, columns: Sequence[str], episode: str = "episode", step: str = "step", chunk: int = CHUNK
) -> DataFrame:
    """Each step with ``next_<column>`` of the step after it, whatever the distance; an episode's last step has NULLs.

    NULL is an episode like others; a row with a NULL step is kept and has no next.
    """
    paired = _with_following(steps, 1, episode, step, chunk)
    following = F.get("_ahead", F.lit(0))
    return paired.select(*steps.columns, *[following[c].alias(f"next_{c}") for c in columns])


def trajectories(
    steps: DataFrame, observation: Sequence[str], episode: str = "episode", step: str = "step", chunk: int = CHUNK
) -> DataFrame:
    """Transitions: current step type, observation and action with the reward and discount that follow.

    ``steps`` holds ``discount, reward, step_type, action`` and the observation columns. The last
    step of an episode starts no transition.
    """
    paired = transition_pairs(steps, [step, "step_type", "reward", "discount", *observation], episode, step, chunk)
    return paired.where(F.col(f"next_{step}").isNotNull()).select(
        episode, step, "step_type", *observation, "action", "next_step_type",
        F.col("next_reward").alias("reward"), F.col("next_discount").alias("discount"),
        *[f"next_{c}" for c in observation],
    )


def sequences(
    rows: DataFrame, n: int = 2, episode: str | None = "episode", step: str = "step", chunk: int = CHUNK
) -> DataFrame:
    """All runs of ``n`` rows of an episode that follow each other ``(episode, step, items)``, one per start."""
    if n == 1:
        return rows.select(episode, step, F.array(F.struct(*rows.columns)).alias("items"))
    listed = _with_following(rows, n - 1, episode, step, chunk)
    items = F.concat(F.array(F.struct(*rows.columns)), "_ahead")
    return listed.where((F.size("_ahead") == n - 1) & F.col(step).isNotNull()).select(episode, step, items.alias("items"))


def _null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys``, of which NULL is a value like others."""
    on = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    return df.alias("x").join(other.alias("y"), on, how)


def retain_latest(df: DataFrame, n: int, seq: str = "seq", by: Sequence[str] = (), width: int = 1_000_000) -> DataFrame:
    """The newest ``n`` rows by the unique BIGINT ``seq``, overall or per group.

    Overall: one aggregate counts the rows and sketches the distribution of ``seq``; a filter on the scan then drops what is below
    a quantile that the newest ``n`` rows cannot reach, so that little more than a thousandth of the table (and ``n``) is sorted, however the
    numbers are spread. Per group: ranges of ``width`` sequence numbers that the group's newest ``n`` rows cannot
    reach are dropped first, so a group with very many rows brings few to the sort.
    """
    if by:
        counts = df.groupBy(*by, range_start(seq, width).alias("_range")).agg(F.count("*").alias("_rows"))
        earlier = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
        reach = counts.withColumn("_newer", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).where(F.col("_newer") < n)
        # rows meet their range, not their group, so a large group is spread over its ranges
        df = _null_safe(df.withColumn("_range", range_start(seq, width)), reach.drop("_rows", "_newer"), [*by, "_range"], "left_semi").drop("_range")
        newest = Window.partitionBy(*by).orderBy(F.desc(seq))
        return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")
    marks = F.percentile_approx(seq, [k / QUANTILES for k in range(QUANTILES + 1)], SKETCH)
    found = df.agg(F.count(seq).alias("_rows"), marks.alias("_marks"), F.min(seq).alias("_least"))
    # the sketch may be off by one rank in SKETCH; twice that and one row are left as a margin
    reach = F.floor(F.lit(QUANTILES) * (1 - (F.lit(n) + 1) / F.greatest("_rows", F.lit(1)) - F.lit(2.0 / SKETCH))).cast("int")
    oldest = found.select(F.when(reach > 0, F.get("_marks", reach)).otherwise(F.col("_least"))).scalar()
    return df.where(F.col(seq) >= oldest).orderBy(F.desc(seq)).limit(n)


def draw(k: Column, seed: int, n: Column) -> Column:
    """Reproducible draw number ``k`` from ``0 .. n - 1``: 60 bits of a hash, modulo ``n``."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), k.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), n)


def sample_batches(
    df: DataFrame, batch: int = 10, batches: int | None = None, seed: int = 0, seq: str = "seq"
) -> DataFrame:
    """Uniform sample with replacement ``(batch_no, draw_no, <columns>)``.

    ``batches=None`` draws as many rows as the table has. Draws meet rows in an equi-join on the
    dense row number, which a hash spreads evenly; ``seq`` may be as sparse as it likes.
    """
    indexed = dense_index(df, seq, "_idx")
    n = indexed.agg(F.count("*")).scalar()
    if batches is None:
        numbers = indexed.select(F.col("_idx").alias("draw_no"))
    else:
        numbers = df.sparkSession.range(batches * batch).withColumnRenamed("id", "draw_no")
    drawn = numbers.withColumn("_idx", draw(F.col("draw_no"), seed, n))
    return drawn.join(indexed, "_idx").withColumn(
        "batch_no", F.floor(F.col("draw_no") / F.lit(batch)).cast("bigint")
    ).select("batch_no", "draw_no", *df.columns)


def draw_counts(df: DataFrame, draws: int, seed: int = 0, seq: str = "seq", rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``draws``: how often each row is drawn when ``draws`` rows are taken uniformly with replacement, rows not drawn left out.

    The number of draws that fall on each range of about ``rows`` rows is drawn first, from the multinomial law of the ranges' sizes; only those numbers, one per
    range, pass the driver. A range's draws are then dealt out inside it by row number. No draw is shuffled and no row
    is numbered across ranges. The same table, seed and ranges give the same sample.
    """
    import numpy as np

    ranged = written(df.select(F.struct(*df.columns).alias("_row"), F.col(seq).alias("_seq"), F.pmod(F.xxhash64(seq), F.lit(_ranges(df, rows))).alias("_range")), "ranges")
    sizes = sorted(tuple(r) for r in ranged.groupBy("_range").count().collect())
    if not sizes or draws <= 0:
        return df.limit(0).withColumn("draws", F.lit(0).cast("bigint"))
    total = sum(n for _, n in sizes)
    dealt = np.random.default_rng(seed).multinomial(draws, [n / total for _, n in sizes]).tolist()
    table = [(r, n, k) for (r, n), k in zip(sizes, dealt, strict=True) if k]
    falls = df.sparkSession.createDataFrame(table, "_range bigint, _size bigint, _draws bigint")
    # draws of a range: numbers 0.. hashed to places in it, and counted there
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_draws") - 1))
    hits = falls.repartition("_range").select("_range", "_size", number.alias("_k"))
    key = F.concat_ws("-", F.lit(seed), "_range", "_k")
    place = F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint"), F.col("_size")).alias("_place")
    counts = hits.select("_range", place).groupBy("_range", "_place").agg(F.count("*").alias("draws"))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy("_seq")).cast("bigint") - 1)
    return placed.join(counts, ["_range", "_place"]).select("_row.*", "draws")


def _ranges(df: DataFrame, rows: int) -> int:
    """How many ranges of about so many rows a table has."""
    return max(1, -(-df.count() // rows))


def episode_rollup(steps: DataFrame, episode: str = "episode") -> DataFrame:
    """Step count, total and mean reward per episode."""
    return steps.groupBy(episode).agg(
        F.count("*").alias("steps"), F.sum("reward").alias("total_reward"), F.avg("reward").alias("mean_reward")
    )
