"""Range functions against a plain per-window computation."""

import datetime as dt
import math
import random

import pytest

from telemill.operators import rangefn
from telemill.operators.rangefn import increase, over_time, rate, rate_over_time

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
E0 = int(T0.timestamp())


@pytest.fixture(params=["repeated", "running"])
def way(request, monkeypatch):
    """Both ways of merging cells, whatever the widths would have chosen."""
    limit = 10**9 if request.param == "repeated" else -1
    monkeypatch.setattr(rangefn.slide_counter, "__defaults__", (limit,))
    monkeypatch.setattr(rangefn.slide_gauge, "__defaults__", (limit,))


def frame(spark, rows, kind="bigint"):
    """rows: (series, seconds after T0, value)"""
    return spark.createDataFrame(
        [(k, T0 + dt.timedelta(seconds=s), v) for k, s, v in rows], f"k string, ts timestamp, v {kind}"
    )


def result(df, value):
    return {(r["k"], r["t"].replace(tzinfo=dt.timezone.utc).timestamp() - E0 if r["t"].tzinfo is None else r["t"].timestamp() - E0): r[value]
            for r in df.collect()}


@pytest.fixture(autouse=True)
def utc(spark, monkeypatch):
    import time

    monkeypatch.setenv("TZ", "UTC")
    time.tzset()


def windows(rows, d, s):
    """(series, t) -> the window's samples in order, for every grid time that sees a sample."""
    out = {}
    for k in {r[0] for r in rows}:
        samples = sorted((sec, v) for key, sec, v in rows if key == k)
        times = {t for sec, _ in samples for t in range(math.ceil(sec / s) * s, math.ceil(sec / s) * s + d + s, s)}
        for t in times:
            inside = [(sec, v) for sec, v in samples if t - d < sec <= t]
            if inside:
                out[k, t] = inside
    return out


def naive_increase(inside):
    total = 0
    for (_, a), (_, b) in zip(inside, inside[1:], strict=False):
        total += b if b < a else b - a
    return total


def naive_rate(inside, t, d):
    (ft, fv), (lt, _) = inside[0], inside[-1]
    inc, si = naive_increase(inside), lt - ft
    av, head, tail = si / (len(inside) - 1), ft - (t - d), t - lt
    if head >= 1.1 * av:
        head = av / 2
    if inc > 0 and fv >= 0:
        head = min(head, si * fv / inc)
    if tail >= 1.1 * av:
        tail = av / 2
    return inc * ((si + head + tail) / si) / d


def random_counter(seed, n=300, span=4000):
    rnd = random.Random(seed)
    rows = []
    for k in ("a", "b", "c"):
        v, seconds = 0, sorted(rnd.sample(range(1, span), n if k != "c" else 12))
        for sec in seconds:
            v = rnd.randint(0, 5) if rnd.random() < 0.05 else v + rnd.randint(0, 50)
            rows.append((k, sec, v))
    return rows


@pytest.mark.parametrize(("seed", "d", "s"), [(1, 120, 60), (2, 600, 60), (3, 300, 120), (4, 60, 60), (5, 60, 180), (6, 1800, 60)])
def test_increase_and_rate_of_random_counters(spark, way, seed, d, s):
    rows = random_counter(seed)
    want = {kt: w for kt, w in windows(rows, d, s).items() if len(w) >= 2}
    df = frame(spark, rows)
    inc = result(increase(df, ["k"], d, s), "inc")
    assert inc == {kt: naive_increase(w) for kt, w in want.items()}
    got = result(rate(df, ["k"], d, s), "rate")
    assert got.keys() == want.keys()
    for (k, t), w in want.items():
        assert got[k, t] == pytest.approx(naive_rate(w, t, d), rel=1e-9)


def test_finer_grain_changes_nothing(spark):
    df = frame(spark, random_counter(9))
    assert result(increase(df, ["k"], 600, 60), "inc") == result(increase(df, ["k"], 600, 60, grain=10), "inc")


@pytest.mark.parametrize(("seed", "d", "s"), [(1, 600, 60), (2, 300, 120), (3, 60, 60), (4, 60, 180)])
def test_over_time_of_random_gauges(spark, way, seed, d, s):
    rows = random_counter(seed, n=120)
    want = windows(rows, d, s)
    df = over_time(frame(spark, rows), ["k"], d, s, ["max", "min", "avg", "sum", "count"])
    for name, fn in {
        "max": lambda v: max(v), "min": lambda v: min(v), "sum": lambda v: sum(v), "count": lambda v: len(v), "avg": lambda v: sum(v) / len(v),
    }.items():
        assert result(df, name) == {kt: fn([v for _, v in w]) for kt, w in want.items()}


def test_rate_over_time_is_over_time_of_rate(spark, way):
    rows = random_counter(11)
    rates = {kt: naive_rate(w, kt[1], 120) for kt, w in windows(rows, 120, 60).items() if len(w) >= 2}
    want = windows([(k, int(t), v) for (k, t), v in rates.items()], 900, 60)
    df = rate_over_time(frame(spark, rows), ["k"], 120, 900, 60)
    most, mean = result(df, "max"), result(df, "avg")
    assert most.keys() == want.keys()
    for kt, w in want.items():
        values = [v for _, v in w]
        assert most[kt] == pytest.approx(max(values), rel=1e-9)
        assert mean[kt] == pytest.approx(sum(values) / len(values), rel=1e-9)


def test_reset_inside_a_window(spark, way):
    df = frame(spark, [("a", 10, 100), ("a", 20, 130), ("a", 30, 5), ("a", 40, 25)])
    assert result(increase(df, ["k"], 60, 60), "inc")["a", 60] == 30 + 5 + 20


def test_reset_at_the_first_sample_of_a_window_is_not_counted(spark, way):
    df = frame(spark, [("a", 50, 100), ("a", 70, 5), ("a", 80, 25)])
    assert result(increase(df, ["k"], 60, 60), "inc")["a", 120] == 20


def test_reset_between_two_cells_of_a_window(spark, way):
    df = frame(spark, [("a", 50, 100), ("a", 70, 5), ("a", 80, 25)])
    assert result(increase(df, ["k"], 120, 60), "inc")["a", 120] == 5 + 20


def test_one_sample_has_no_rate(spark):
    assert result(rate(frame(spark, [("a", 30, 7)]), ["k"], 60, 60), "rate") == {}


def test_window_is_open_at_its_start_and_closed_at_its_end(spark, way):
    df = frame(spark, [("a", 60, 1), ("a", 90, 2), ("a", 120, 4)])
    inc = result(increase(df, ["k"], 60, 60), "inc")
    assert inc == {("a", 120): 2}


def test_no_extrapolation_when_not_asked_for(spark):
    df = frame(spark, [("a", 70, 0), ("a", 100, 30)])
    assert result(rate(df, ["k"], 60, 60, extrapolate=False), "rate") == {("a", 120): 0.5}


def test_gaps_are_skipped(spark):
    df = frame(spark, [("a", 10, 1.0), ("a", 20, float("nan")), ("a", 30, None), ("a", 40, 4.0)], "double")
    assert result(increase(df, ["k"], 60, 60), "inc") == {("a", 60): 3.0}
    assert result(over_time(df, ["k"], 60, 60, ["max"]), "max") == {("a", 60): 4.0}


def test_missing_labels_form_a_series_of_their_own(spark, way):
    df = frame(spark, [(None, 10, 1), (None, 20, 3), ("a", 10, 5), ("a", 20, 9)])
    assert result(increase(df, ["k"], 60, 60), "inc") == {(None, 60): 2, ("a", 60): 4}


def test_grain_must_divide_the_widths(spark):
    with pytest.raises(ValueError, match="grain"):
        increase(frame(spark, [("a", 1, 1)]), ["k"], 60, 60, grain=7)
