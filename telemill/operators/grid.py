"""Fixed-length observation windows: baseline, resampling, interpolation, padding, on-flags.

Every step works inside one decision time ``obs_t`` (plus optional further ``by`` columns), whose
rows are bounded by the window's length over the grid step. Resampling fills its gaps while rows
are generated, so no step needs a join back to a grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.timegrid import at, epoch_us, floor_to, micros
from telemill.operators.asof import asof_join
from telemill.operators.chunked import number_rows

OBS = ("obs_t",)


def baseline(df: DataFrame, by: Sequence[str] = OBS, t: str = "t", value: str = "v") -> DataFrame:
    """Subtract the window's first value."""
    first = F.first(value).over(Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(value, F.col(value) - first)


def bin_mean(df: DataFrame, step, by: Sequence[str] = OBS, t: str = "t", value: str = "v") -> DataFrame:
    """Mean per bin of what is neither NULL nor NaN; a bin is named by its start."""
    bins = floor_to(epoch_us(t), micros(step))
    return df.groupBy(*by, bins.alias("_bin")).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(value)).withColumn(t, at(F.col("_bin"))).drop("_bin")


def resample(df: DataFrame, step, by: Sequence[str] = OBS, t: str = "t", value: str = "v", spread: str | None = None) -> DataFrame:
    """Bin means on the regular grid from the first to the last bin; empty bins are NULL.

    ``spread`` names a width of time by which long groups are dealt out, so that none has to fit into one task.
    """
    s = micros(step)
    bins = bin_mean(df, step, by, t, value).withColumn("_e", epoch_us(t))
    if spread:
        bins = asof_join(bins, bins.select(*by, "_e", F.col("_e").alias("_later")), by, "_e", ["_later"], width=micros(spread), direction="forward", exact=False)
    else:
        bins = bins.withColumn("_later", F.lead("_e").over(Window.partitionBy(*by).orderBy("_e")))
    filled = bins.withColumn("_stop", F.coalesce(F.col("_later") - F.lit(s), F.col("_e"))).withColumn(
        "_slot", F.explode(F.sequence("_e", "_stop", F.lit(s).cast("bigint")))
    )
    return filled.select(
        *by, at(F.col("_slot")).alias(t), F.when(F.col("_slot") == F.col("_e"), F.col(value)).alias(value)
    )


def interpolate(df: DataFrame, by: Sequence[str] = OBS, t: str = "t", value: str = "v", spread: str | None = None) -> DataFrame:
    """Linear between known values by row position; leading NULLs stay, trailing ones take the last value.

    ``spread`` names a width of time by which long groups are dealt out: rows are numbered in pieces, and the known values before and
    after a row are found by as-of joins, with one carry per piece. Times must be unique in a group then, and group columns not NULL.
    """
    if spread:
        return _interpolate_spread(df, by, t, value, spread)
    ordered = Window.partitionBy(*by).orderBy(t)
    back = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.col("_row"))
    rows = df.withColumn("_row", F.row_number().over(ordered)).withColumn("_at", known)
    v = F.when(F.col("_at").isNotNull(), F.col(value).cast("double"))
    # walking the other way keeps the search for the next known row a running frame
    ahead = Window.partitionBy(*by).orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        rows.withColumn("_pv", F.last(v, ignorenulls=True).over(back))
        .withColumn("_pr", F.last("_at", ignorenulls=True).over(back))
        .withColumn("_nv", F.last(v, ignorenulls=True).over(ahead))
        .withColumn("_nr", F.last("_at", ignorenulls=True).over(ahead))
    )
    between = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_row") - F.col("_pr")) / (F.col("_nr") - F.col("_pr"))
    return rows.withColumn(value, F.coalesce(v, between, F.col("_pv"))).drop("_row", "_at", "_pv", "_pr", "_nv", "_nr")


def _interpolate_spread(df: DataFrame, by: Sequence[str], t: str, value: str, spread: str) -> DataFrame:
    pieces = df.withColumn("_piece", floor_to(epoch_us(t), micros(spread)))
    rows = number_rows(pieces, by, "_piece", [t], "_row").drop("_piece")
    v = F.col(value).cast("double")
    known = rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, t, F.struct("_row", v.alias("v")).alias("_before"))
    rows = asof_join(rows, known, by, t, ["_before"], width=spread)
    rows = asof_join(rows, known.withColumnRenamed("_before", "_after"), by, t, ["_after"], width=spread, direction="forward")
    share = (F.col("_row") - F.col("_before._row")) / F.nullif(F.col("_after._row") - F.col("_before._row"), F.lit(0))
    between = F.col("_before.v") + (F.col("_after.v") - F.col("_before.v")) * share
    # a known row is its own neighbour on both sides
    own = F.when(F.col("_before._row") == F.col("_row"), F.col("_before.v"))
    return rows.withColumn(value, F.coalesce(own, between, F.col("_before.v"))).drop("_row", "_before", "_after")


def update_flags(grid: DataFrame, marks: DataFrame, flags: Sequence[str], by: Sequence[str] = OBS, t: str = "t") -> DataFrame:
    """Overwrite flag columns where a mark has exactly the grid row's time and a value.

    Marks off the grid have no effect. Marks are reduced to one row per window and time, combined before
    they are shuffled by both; then both sides are stacked and grouped once instead of joined.
    """
    marks = marks.groupBy(*by, t).agg(*[F.max(f).alias(f) for f in flags])
    others = [c for c in grid.columns if c not in (*by, t, *flags)]
    stacked = grid.withColumn("_grid", F.lit(True)).unionByName(marks.select(*by, t, *flags), allowMissingColumns=True)
    own = [F.max(F.when(F.col("_grid"), F.col(f))) for f in flags]
    new = [F.max(F.when(F.col("_grid").isNull(), F.col(f))) for f in flags]
    return (
        # by window, so that the windowed steps that follow need no shuffle of their own
        stacked.repartition(*by)
        .groupBy(*by, t)
        .agg(
            F.max("_grid").alias("_grid"),
            *[F.max(c).alias(c) for c in others],
            *[F.coalesce(n, o).alias(f) for f, n, o in zip(flags, new, own, strict=True)],
        )
        .where("_grid")
        .drop("_grid")
    )


def presence_marks(presence: DataFrame, types: dict[str, str], by: Sequence[str] = OBS, t: str = "t") -> DataFrame:
    """Presence rows ``(obs_t, t, instance_type)`` as flag columns; ``types`` maps flag to instance type."""
    wanted = presence.where(F.col("instance_type").isin(list(types.values())))
    return wanted.select(*by, t, *[F.when(F.col("instance_type") == kind, 1.0).alias(flag) for flag, kind in types.items()])


def on_flags(
    grid: DataFrame, presence: DataFrame, types: dict[str, str], sticky: bool = True, by: Sequence[str] = OBS, t: str = "t"
) -> DataFrame:
    """Add one 0/1 column per type: on from the first grid row where the type is present to the window's end.

    ``sticky=False`` marks only the rows where the type is present.
    """
    flags = list(types)
    empty = grid.select("*", *[F.lit(None).cast("double").alias(f) for f in flags])
    marked = update_flags(empty, presence_marks(presence, types, by, t), flags, by, t)
    if sticky:
        so_far = Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        marked = marked.select(
            *[c for c in marked.columns if c not in flags], *[F.max(f).over(so_far).alias(f) for f in flags]
        )
    return fill_zero(marked, flags)


def pad_front(df: DataFrame, samples: int, step, by: Sequence[str] = OBS, t: str = "t") -> DataFrame:
    """Exactly ``samples`` rows per window, numbered by ``slot``: the first row is repeated at earlier
    times when there are too few, and only the last rows are kept when there are too many."""
    s = micros(step)
    whole = Window.partitionBy(*by)
    rows = df.withColumn("_e", epoch_us(t)).withColumn("_lo", F.min("_e").over(whole)).withColumn("_hi", F.max("_e").over(whole))
    slot = F.lit(samples - 1) - ((F.col("_hi") - F.col("_e")) / F.lit(s)).cast("bigint")
    rows = rows.withColumn("_slot", slot).where("_slot >= 0")
    from_slot = F.when(F.col("_e") == F.col("_lo"), F.lit(0).cast("bigint")).otherwise(F.col("_slot"))
    rows = rows.withColumn("slot", F.explode(F.sequence(from_slot, F.col("_slot"))))
    stamp = F.col("_hi") - (F.lit(samples - 1) - F.col("slot")) * F.lit(s)
    return rows.withColumn(t, at(stamp)).drop("_e", "_lo", "_hi", "_slot")


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0.0, list(columns))


def last_value(value: str, order: str = "slot") -> Column:
    """Aggregate: the value in the last row."""
    return F.max_by(value, order)


def on_fraction(flag: str, samples: int) -> Column:
    """Aggregate: share of the window's rows with the flag on."""
    return F.sum(flag) / F.lit(samples)


def first_row(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per group, found without sorting the group."""
    first = F.min(F.struct(order, *[c for c in columns if c != order])).alias("_first")
    return df.groupBy(*by).agg(first).select(*by, *[F.col(f"_first.{c}").alias(c) for c in columns])


def grid_size(window_minutes: int, samples_per_minute: int) -> tuple[int, int]:
    """Number of rows of an observation and their distance in whole seconds."""
    return window_minutes * samples_per_minute, int(60 / samples_per_minute)
