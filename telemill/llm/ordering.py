"""Numbers rows inside groups of any size: ranges are sorted in parallel, and only one row per range is carried on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telemill.llm.tables import stored


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``_pos``, the place (from 0) of each row in its ``group`` (text or integer) along ``order``, nulls first.

    Rows are dealt into ranges of (group, order), so a group with a large share of the rows lies in many ranges; rows that are
    alike in all of them are spread, too, in no defined order. A range is numbered as it streams by. What is carried between
    ranges is one row per range: only a range's first group can have begun in an earlier one. Columns ``_part``, ``_run``,
    ``_in``, ``_pos``, ``_same`` are the caller's to avoid.
    """
    rows = rows.withColumn("_same", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_same")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, inside, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column(group)
            changed = np.ones(batch.num_rows, dtype=bool)
            now, before = found.slice(1), found.slice(0, batch.num_rows - 1)
            same = pc.or_(pc.fill_null(pc.equal(now, before), False), pc.and_(pc.is_null(now), pc.is_null(before)))
            changed[1:] = ~same.to_numpy(zero_copy_only=False)
            changed[0] = at < 0 or found[0].as_py() != last
            runs = at + np.cumsum(changed)
            begin = np.maximum.accumulate(np.where(changed, np.arange(batch.num_rows), -1))
            places = np.where(begin < 0, inside + np.arange(batch.num_rows), np.arange(batch.num_rows) - begin)
            at, inside, last = int(runs[-1]), int(places[-1]) + 1, found[-1].as_py()
            new = [pa.array(np.full(batch.num_rows, part, dtype=np.int64)), pa.array(runs), pa.array(places)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "_part", "_run", "_in"])

    schema = StructType([*dealt.schema.fields, *StructType.fromDDL("_part long, _run long, _in long").fields])
    kept = stored(dealt.mapInArrow(run, schema), name)
    ranges = kept.groupBy("_part").agg(
        F.max("_run").alias("_runs"),
        F.min_by(F.struct(group), "_run").alias("_first"),
        F.max_by(F.struct(group), "_run").alias("_last"),
        (F.max(F.struct("_run", "_in"))["_in"] + 1).alias("_rows"),
    )
    # one row per range: as many as the shuffle has partitions
    along = Window.orderBy("_part")
    goes_on = F.coalesce(F.col("_first").eqNullSafe(F.lag("_last").over(along)) & (F.lag("_runs").over(along).isNotNull()), F.lit(False))
    chained = ranges.withColumn("_goes", goes_on).withColumn(
        "_chain", F.sum(F.when(F.col("_goes") & (F.col("_runs") == 0), 0).otherwise(1)).over(along)
    )
    carry = F.sum("_rows").over(Window.partitionBy("_chain").orderBy("_part"))
    offsets = (
        chained.withColumn("_carry", carry)
        .select("_part", F.when(F.col("_goes"), F.lag("_carry").over(along)).otherwise(0).alias("_offset"))
    )
    place = F.col("_in") + F.when(F.col("_run") == 0, F.col("_offset")).otherwise(0)
    return kept.join(F.broadcast(offsets), "_part").withColumn("_pos", place).drop("_part", "_run", "_in", "_offset")
