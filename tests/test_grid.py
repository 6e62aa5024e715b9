"""Observation windows against a pandas reading of the same steps."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemill.operators.grid import baseline, bin_mean, first_row, grid_size, interpolate, on_flags, pad_front, resample, update_flags
from telemill.operators.lookup import lookup_on_grid, observation_windows, window_slice
from telemill.operators.quality import bounds_violations
from telemill.plans.observation import observation_rewards, observations, throughput_series

T0 = dt.datetime(2024, 3, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=float(seconds))


def secs(stamp):
    return (stamp - T0).total_seconds()


def table(spark, rows, schema="obs_t int, t timestamp, v double"):
    return spark.createDataFrame([(o, at(t), v) for o, t, v in rows], schema)


def values(df, column="v"):
    return {(r["obs_t"], secs(r["t"])): r[column] for r in df.collect()}


def test_baseline_is_the_first_value(spark):
    df = baseline(table(spark, [(1, 20, 7.0), (1, 10, 5.0), (2, 10, 1.0)]))
    assert values(df) == {(1, 10): 0.0, (1, 20): 2.0, (2, 10): 0.0}


def test_resample_fills_empty_bins_with_null(spark):
    df = resample(table(spark, [(1, 3, 2.0), (1, 9, 4.0), (1, 47, 8.0)]), "15 seconds")
    assert values(df) == {(1, 0): 3.0, (1, 15): None, (1, 30): None, (1, 45): 8.0}


def test_interpolate_between_leading_and_trailing_nulls(spark):
    rows = [(1, 0, None), (1, 10, 2.0), (1, 20, None), (1, 30, None), (1, 40, 8.0), (1, 50, None), (2, 0, None)]
    got = values(interpolate(table(spark, rows)))
    assert got == {(1, 0): None, (1, 10): 2.0, (1, 20): 4.0, (1, 30): 6.0, (1, 40): 8.0, (1, 50): 8.0, (2, 0): None}


def test_interpolate_goes_by_row_and_takes_nan_for_missing(spark):
    got = values(interpolate(table(spark, [(1, 0, 0.0), (1, 1, float("nan")), (1, 100, 4.0)])))
    assert got[1, 1] == 2.0


@pytest.mark.parametrize(("n", "first", "last"), [(57, 0.0, 56.0), (60, 0.0, 59.0), (61, 1.0, 60.0)])
def test_pad_front_gives_exactly_sixty_rows(spark, n, first, last):
    df = pad_front(table(spark, [(1, 15 * i, float(i)) for i in range(n)]), 60, "15 seconds")
    rows = sorted((r["slot"], secs(r["t"]), r["v"]) for r in df.collect())
    assert [r[0] for r in rows] == list(range(60))
    assert [r[1] for r in rows] == [15 * (n - 1) - 15 * (59 - i) for i in range(60)]
    assert (rows[0][2], rows[-1][2]) == (first, last)
    assert [r[2] for r in rows] == [max(0.0, float(n - 60 + i)) for i in range(60)]


def test_update_flags_ignores_stamps_off_the_grid_and_nulls(spark):
    grid = table(spark, [(1, 0, 0.0), (1, 15, 0.0), (1, 30, 0.0)], "obs_t int, t timestamp, on double")
    marks = table(spark, [(1, 15, 1.0), (1, 20, 1.0), (1, 30, None)], "obs_t int, t timestamp, on double")
    assert values(update_flags(grid, marks, ["on"]), "on") == {(1, 0): 0.0, (1, 15): 1.0, (1, 30): 0.0}


def test_on_flags_stay_on_unless_told_otherwise(spark):
    grid = table(spark, [(1, t, 1.0) for t in (0, 15, 30, 45)])
    seen = spark.createDataFrame([(1, at(15), "L"), (1, at(20), "S"), (1, at(30), "other")], "obs_t int, t timestamp, instance_type string")
    types = {"large": "L", "small": "S"}
    sticky = on_flags(grid, seen, types)
    assert values(sticky, "large") == {(1, 0): 0.0, (1, 15): 1.0, (1, 30): 1.0, (1, 45): 1.0}
    assert set(values(sticky, "small").values()) == {0.0}
    assert values(on_flags(grid, seen, types, sticky=False), "large") == {(1, 0): 0.0, (1, 15): 1.0, (1, 30): 0.0, (1, 45): 0.0}


def pandas_observation(points, presence, samples, delta):
    """points: [(second, value)], presence: [(second, type)] -> samples x 3 array"""
    df = pd.DataFrame({"v": [float(v) for _, v in points], "L": np.nan, "S": np.nan}, index=pd.to_datetime([at(s) for s, _ in points]))
    df["v"] = df["v"] - df["v"].iloc[0]
    df = df.interpolate().resample(f"{delta}s").mean().interpolate()
    for kind in ("L", "S"):
        stamps = [at(s) for s, k in presence if k == kind]
        df.update(pd.DataFrame({kind: 1.0}, index=pd.to_datetime(stamps)))
        df = df.interpolate()
    df = df.iloc[-samples:]
    while len(df) < samples:
        df.loc[df.index[0] - pd.Timedelta(seconds=delta)] = df.iloc[0]
        df = df.sort_index()
    return df.fillna(0).to_numpy()


def test_observations_equal_the_pandas_steps(spark):
    rnd = random.Random(5)
    window, period, delta, samples = 900, 300, 15, 60
    points = sorted((s, rnd.randint(0, 1000)) for s in rnd.sample(range(10, 3600, 10), 150))
    presence = [(s, rnd.choice(["L", "S", "X"])) for s in rnd.sample(range(0, 3600, 15), 12)]
    through = spark.createDataFrame([(at(s), v) for s, v in points], "t timestamp, throughput bigint")
    seen = spark.createDataFrame([(at(s), k) for s, k in presence], "t timestamp, instance_type string")
    df = observations(
        through, observation_windows(seen, window, period), window, period, delta, samples, large="L", small="S"
    ).toPandas()
    assert df.groupby("obs_t").size().eq(samples).all()
    checked = 0
    for obs_t, got in df.groupby("obs_t"):
        end = secs(obs_t)
        inside = [(s, v) for s, v in points if end - window < s <= end]
        marks = [(s, k) for s, k in presence if end - window < s <= end]
        want = pandas_observation(inside, marks, samples, delta)
        have = got.sort_values("slot")[["throughput", "large_on", "small_on"]].to_numpy()
        np.testing.assert_allclose(have, want, rtol=1e-9, atol=1e-9)
        checked += 1
    assert checked > 10


def test_window_reward_formula(spark):
    rows = [(1, i, at(15 * i), 1e9 * i, 1.0 if i >= 2 else 0.0, 1.0) for i in range(4)]
    obs = spark.createDataFrame(rows, "obs_t int, slot int, t timestamp, throughput double, large_on double, small_on double")
    got = observation_rewards(obs, 15, 4).collect()[0]
    assert (got["on_large"], got["on_small"]) == (0.5, 1.0)
    assert got["reward"] == pytest.approx(3.33e-9 * 3e9 - 0.20 / 60 * 0.5 * 15 - 0.0416 / 60 * 15)


def test_lookup_takes_the_newest_sample_within_the_lookback(spark):
    rows = [("a", at(5), 1), ("a", at(50), 2), ("a", at(70), 3), ("a", at(120), 4)]
    df = lookup_on_grid(spark.createDataFrame(rows, "k string, ts timestamp, v int"), ["k"], 60, 90)
    assert {secs(r["t"]): r["v"] for r in df.collect()} == {60: 2, 120: 4, 180: 4}


@pytest.mark.parametrize(("step", "back"), [(60, 300), (60, 60), (60, 45), (60, 90), (20, 300), (300, 299)])
def test_lookup_equals_merge_asof(spark, step, back):
    rnd = random.Random(3)
    rows = [(k, s, rnd.random()) for k in ("a", "b", None) for s in rnd.sample(range(-2000, 5000), 80)]
    df = spark.createDataFrame([(k, at(s), v) for k, s, v in rows], "k string, ts timestamp, v double")
    got = [(r["k"], secs(r["t"]), r["v"]) for r in lookup_on_grid(df, ["k"], step, back).collect()]
    grid_times = range(-2100 // step * step, 6000, step)
    want = []
    for k in ("a", "b", None):
        right = pd.DataFrame([(s, v) for o, s, v in rows if o == k], columns=["s", "v"]).sort_values("s")
        merged = pd.merge_asof(pd.DataFrame({"t": grid_times}), right, left_on="t", right_on="s", tolerance=back - 1).dropna(subset="v")
        want += [(k, float(r.t), r.v) for r in merged.itertuples()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_observation_windows_are_open_at_the_start(spark):
    df = spark.createDataFrame([(at(0),), (at(60),), (at(61),)], "t timestamp")
    got = sorted((secs(r["t"]), secs(r["obs_t"])) for r in observation_windows(df, 120, 60).collect())
    assert got == [(0, 0), (0, 60), (60, 60), (60, 120), (61, 120), (61, 180)]


def test_window_slice(spark):
    df = spark.createDataFrame([(at(s),) for s in (0, 60, 120, 121)], "t timestamp")
    assert sorted(secs(r["t"]) for r in window_slice(df, at(120), 120).collect()) == [60, 120]


def test_throughput_series_modes(spark):
    rows = [("a", at(10), 100), ("a", at(50), 130), ("a", at(70), 5), ("a", at(100), 9)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v bigint")
    raw = {secs(r["t"]): r["throughput"] for r in throughput_series(df, ["k"], 60, 60).collect()}
    grown = {secs(r["t"]): r["throughput"] for r in throughput_series(df, ["k"], 60, 60, mode="increase").collect()}
    assert raw == {60: 130, 120: 9}
    assert grown == {60: 30, 120: 4}


def test_bin_mean_first_row_and_grid_size(spark):
    df = table(spark, [(1, 0, 1.0), (1, 14, 3.0), (1, 15, 9.0)])
    assert values(bin_mean(df, 15)) == {(1, 0): 2.0, (1, 15): 9.0}
    assert [r["v"] for r in first_row(df, ["obs_t"], "t", ["v"]).collect()] == [1.0]
    assert grid_size(15, 4) == (60, 15)


def test_bounds_violations(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (2, -0.1, None), (3, 1.0, float("nan"))], "id int, a double, b double")
    got = {(r["id"], r["field"]) for r in bounds_violations(df, {"a": (0, 1), "b": (0, float("inf"))}, ["id"]).collect()}
    assert got == {(2, "a"), (2, "b"), (3, "b")}
    assert bounds_violations(df.where(F.col("id") == 1), {"a": (0, 1), "b": (0, 1)}, ["id"]).count() == 0


def test_long_groups_are_filled_in_pieces_as_in_one(spark):
    import random

    r = random.Random(4)
    rows = [(k, s, r.choice([None, float("nan"), r.random(), r.random()])) for k in (1, 2) for s in sorted(r.sample(range(9000), 150))]
    rows += [(3, s, None) for s in range(0, 500, 100)] + [(4, 7, 1.0)]
    df = table(spark, rows)
    close = lambda found: {(x[0], x[1]): None if x[2] is None else round(x[2], 9) for x in map(tuple, found.collect())}
    for width in ("1 minute", "10 minutes"):
        assert close(interpolate(df, spread=width).select(*df.columns)) == close(interpolate(df))
        assert close(resample(df, "15 seconds", spread=width).where("not isnan(v) or v is null")) == close(resample(df, "15 seconds"))
        whole = interpolate(resample(df, "15 seconds", spread=width), spread=width)
        assert close(whole) == close(interpolate(resample(df, "15 seconds")))
    spread = interpolate(df, spread="1 minute").withColumn("task", F.spark_partition_id())
    assert spread.where(F.col(df.columns[0]) == df.first()[0]).select("task").distinct().count() > 1
