"""Shape of the physical plans: shuffles, pushed filters, no cross joins, no Python in the plan."""

import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as spark_entry  # noqa: E402
from telemill.catalog import batch  # noqa: E402
from telemill.operators import lookup, rangefn, replay  # noqa: E402
from telemill.session import scratch_dir  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", re.sub(r"#\d+L?", "", plan(df)))


@pytest.fixture(scope="module")
def samples(spark):
    path = scratch_dir(spark, "plan-samples")
    rows = spark.range(1000).select(
        (F.col("id") % 7).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.col("id").alias("v"),
        F.col("id").alias("seq"), F.lit("wide").alias("other"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_increase_shuffles_samples_once_and_cells_once(samples):
    df = rangefn.increase(samples, ["k"], "10 minutes", "1 minute")
    assert shuffles(df) == ["k, _block", "k, _cell"]
    assert "ReadSchema: struct<k:string,ts:timestamp,v:bigint>" in plan(df)


def test_long_ranges_take_running_sums_with_the_same_shuffles(samples):
    df = rangefn.over_time(samples, ["k"], "10 hours", "1 minute")
    assert shuffles(df) == ["k, _block", "k, _cell"]
    assert "Window" in plan(df)
    assert "Window" not in plan(rangefn.over_time(samples, ["k"], "10 minutes", "1 minute"))


def test_over_time_combines_before_the_shuffle(samples):
    df = rangefn.over_time(samples, ["k"], "10 minutes", "1 minute")
    assert shuffles(df) == ["k, _block", "k, _cell"]
    text = plan(df)
    assert text.index("Exchange hashpartitioning(k") < text.rindex("partial_sum(_v")


def test_rate_over_time_computes_the_rate_once(samples):
    df = rangefn.rate_over_time(samples, ["k"], "10 minutes", "1 hour", "1 minute")
    assert shuffles(df) == ["k, _block", "k, _block", "k, _cell"]
    assert plan(df).count("FileScan") == 1


def test_lookup_hashes_and_combines(samples):
    df = lookup.lookup_on_grid(samples, ["k"], "1 minute")
    assert "SortAggregate" not in plan(df)
    assert "partial_max_by" in plan(df)
    # one row per cell is shuffled, never a row per grid time
    assert shuffles(df) == ["k, _block", "k, _cell"]
    assert shuffles(lookup.lookup_on_grid(samples, ["k"], "5 minutes")) == ["k, _cell"]


def test_transitions_shuffle_rows_by_chunk(samples):
    df = replay.transition_pairs(samples.select(F.col("k").alias("episode"), F.col("seq").alias("step"), "v"), ["v"])
    # rows are shuffled once, by episode and block; only the blocks' first rows meet by episode
    found = shuffles(df)
    assert found.count("_key, _block") == 2 and found.count("_key") == 1, found
    assert set(found) == {"_key, _block", "_key"}
    # both uses shuffle the same columns, so that one shuffle serves both
    under = re.findall(r"Project \[struct\([^\n]*", re.sub(r"#\d+L?", "", plan(df)))
    assert len(under) == 2 and len(set(under)) == 1


def test_retention_filters_at_the_scan(samples):
    text = plan(replay.retain_latest(samples, 10, width=100))
    assert "TakeOrderedAndProject" in text
    assert "GreaterThanOrEqual(seq,ScalarSubquery" in text


def test_written_samples_are_rebalanced(spark, samples):
    hinted = samples.withColumn("date", F.to_date("ts")).hint("rebalance", "k", "date")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(hinted)


EAGER = {"sample_scan", "requested_actions_sink"}


@pytest.mark.parametrize("name", [n for n in batch.QUERIES if n not in EAGER])
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(spark_entry.queries()[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "MapInPandas"):
        assert word not in text


def test_presence_is_reduced_before_it_is_shuffled_by_window(spark, sf_dir):
    assert shuffles(batch.presence(spark, sf_dir)).count("obs_t") == 0
    flagged = shuffles(batch.QUERIES["grid_flag_update"](spark, sf_dir))
    assert "obs_t, t" in flagged
