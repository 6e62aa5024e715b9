"""Streams against the batch operators, over several deliveries and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from telemill.operators import rangefn, replay
from telemill.plans.right_sizing import right_sizing
from telemill.session import scratch_dir
from telemill.streaming import rates, right_size, sinks, transitions

T0 = dt.datetime(2024, 3, 1)
KEY = ["k"]


def counter(seed=1, n=240, span=7200):
    rnd, rows = random.Random(seed), []
    for k in ("a", "b"):
        v = 0
        for s in sorted(rnd.sample(range(1, span), n)):
            v = rnd.randint(0, 5) if rnd.random() < 0.05 else v + rnd.randint(0, 50)
            rows.append((k, T0 + dt.timedelta(seconds=s), v))
    return sorted(rows, key=lambda r: r[1])


def frame(spark, rows, schema="k string, ts timestamp, v bigint"):
    return spark.createDataFrame(rows, schema)


def deliver(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema="k string, ts timestamp, v bigint"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def parts(rows, n):
    size = -(-len(rows) // n)
    return [rows[i:i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize(("d", "step", "grain"), [("10 minutes", "1 minute", None), ("5 minutes", "5 minutes", "1 minute"), ("1 minute", "3 minutes", None)])
def test_stream_increase_equals_batch_on_closed_ranges(spark, d, step, grain):
    rows, path, out = counter(), scratch_dir(spark, "in"), scratch_dir(spark, "out")
    for part in parts(rows, 4):
        deliver(frame(spark, part), path)
    grown = rates.stream_increase(stream(spark, path), KEY, d, step, "30 seconds", grain=grain).select("k", "t", "inc")
    sinks.start(grown, scratch_dir(spark, "cp"), out, available_now=True).awaitTermination()
    got = {(r["k"], r["t"]): r["inc"] for r in spark.read.parquet(out).collect()}
    batch = rangefn.increase(frame(spark, rows), KEY, d, step)
    last = rows[-1][1] - dt.timedelta(seconds=30, microseconds=1)
    want = {(r["k"], r["t"]): r["inc"] for r in batch.collect() if r["t"] <= last}
    assert got == want
    assert len(want) > 20


def test_stream_goes_on_after_a_restart(spark):
    rows, path, out, cp = counter(3), scratch_dir(spark, "in"), scratch_dir(spark, "out"), scratch_dir(spark, "cp")
    for part in parts(rows, 3):
        deliver(frame(spark, part), path)
        df = rates.stream_rate(stream(spark, path), KEY, "10 minutes", "1 minute", "0 seconds")
        sinks.start(df.select("k", "t", "rate"), cp, out, available_now=True).awaitTermination()
    got = {(r["k"], r["t"]): r["rate"] for r in spark.read.parquet(out).collect()}
    last = rows[-1][1] - dt.timedelta(microseconds=1)
    want = {(r["k"], r["t"]): r["rate"] for r in rangefn.rate(frame(spark, rows), KEY, "10 minutes", "1 minute").collect() if r["t"] <= last}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_stream_right_size_equals_batch_on_closed_times(spark):
    schema = "pod string, ts timestamp, v bigint"
    cpu = frame(spark, counter(5), schema)
    mem = frame(spark, [(k, t, v * 1_000_000) for k, t, v in counter(6)], schema)
    cpu_in, mem_in, out = scratch_dir(spark, "cpu"), scratch_dir(spark, "mem"), scratch_dir(spark, "out")
    deliver(cpu, cpu_in)
    deliver(mem, mem_in)
    sized = right_size.stream_right_size(
        stream(spark, cpu_in, schema), stream(spark, mem_in, schema), ["pod"], ["pod"], "10 minutes", "30 minutes", "5 minutes", "0 seconds"
    )
    sinks.start(sized, scratch_dir(spark, "cp"), out, available_now=True).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    closed = min(r["m"] for df in (cpu, mem) for r in df.agg(F.max("ts").alias("m")).collect()) - dt.timedelta(milliseconds=1)
    batch = right_sizing(cpu, mem, ["pod"], ["pod"], "10 minutes", "30 minutes", "5 minutes")
    assert got == {tuple(r) for r in batch.collect() if r["t"] <= closed}
    assert len(got) > 20


STEPS = "episode string, step bigint, ts timestamp, x int"


def paired(spark, path, gap, delay, block, checkpoint, outs):
    """Pairs and unpaired steps that both streams have written so far."""
    found = []
    for k, df in enumerate((
        transitions.stream_transitions(stream(spark, path, STEPS), ["step", "x"], gap, delay, block=block).select("episode", "step", "next_step", "next_x"),
        transitions.stream_unpaired_steps(stream(spark, path, STEPS), gap, delay, block=block).select("episode", "step"),
    )):
        with sinks.rocksdb(spark):
            query = sinks.start(df, f"{checkpoint}{k}", outs[k], available_now=True)
            query.awaitTermination()
        found.append(([tuple(r) for r in spark.read.parquet(outs[k]).collect()], query))
    return found


@pytest.mark.parametrize("block", [4, 10_000])
def test_transitions_equal_batch_across_missing_steps_late_rows_and_a_restart(spark, block):
    rnd = random.Random(block)
    rows = []
    for e in ("a", "b", None):
        numbers = sorted(rnd.sample(range(-20, 120), 50))
        rows += [(e, i, T0 + dt.timedelta(seconds=10 * i + rnd.randint(0, 9)), i) for i in numbers]
    rows += [("one", 7, T0, 1), ("far", 1, T0, 1), ("far", 2, T0 + dt.timedelta(minutes=9), 2), ("far", 900, T0 + dt.timedelta(minutes=9, seconds=5), 3)]
    # rows arrive up to two minutes out of order
    rows.sort(key=lambda r: (r[2] + dt.timedelta(seconds=rnd.randint(0, 100)), str(r[0])))
    late = [("a", 1000, T0 - dt.timedelta(seconds=300), 0), ("one", 3, T0 - dt.timedelta(seconds=400), 0)]
    end = [("end", k, T0 + dt.timedelta(days=k), 0) for k in (1, 2)]
    path, checkpoint, outs = scratch_dir(spark, "in"), scratch_dir(spark, "cp"), [scratch_dir(spark, "out"), scratch_dir(spark, "out")]
    for part in parts(rows, 5)[:3]:
        deliver(frame(spark, part, STEPS), path)
    paired(spark, path, "5 minutes", "2 minutes", block, checkpoint, outs)
    for part in [*parts(rows, 5)[3:], late, end[:1], end[1:]]:
        deliver(frame(spark, part, STEPS), path)
    (pairs, first), (alone, second) = paired(spark, path, "5 minutes", "2 minutes", block, checkpoint, outs)
    batch = replay.transition_pairs(frame(spark, rows, STEPS), ["step", "ts", "x"], chunk=7).collect()
    near = [r for r in batch if r["next_ts"] is not None and r["next_ts"] - r["ts"] <= dt.timedelta(minutes=5)]
    assert sorted(pairs, key=str) == sorted(((r["episode"], r["step"], r["next_step"], r["next_x"]) for r in near), key=str)
    assert sum(r["next_step"] > r["step"] + 1 for r in near) > 30
    left = {(r["episode"], r["step"]) for r in batch}.difference((r["episode"], r["step"]) for r in near)
    assert sorted(alone, key=str) == sorted([*left, ("end", 1)], key=str)
    # what waits is what the watermark has not passed
    for query in (first, second):
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def test_transitions_in_any_order_of_arrival(spark):
    rows = [(e, i, T0 + dt.timedelta(seconds=10 * i), 100 * i) for e in "ab" for i in range(1, 21)]
    random.Random(1).shuffle(rows)
    path, out = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    for part in parts(rows, 3):
        deliver(frame(spark, part, STEPS), path)
    df = transitions.stream_transitions(stream(spark, path, STEPS), ["x"], "1 minute", "10 minutes")
    with sinks.rocksdb(spark):
        sinks.start(df, scratch_dir(spark, "cp"), out, available_now=True).awaitTermination()
    got = sorted((r["episode"], r["step"], r["next_x"]) for r in spark.read.parquet(out).collect())
    assert got == [(e, i, 100 * (i + 1)) for e in "ab" for i in range(1, 20)]


def test_steps_that_are_done_leave_the_state_and_count_once(spark):
    rows = [(e, i, T0 + dt.timedelta(seconds=10 * i), 100 * i) for e in "ab" for i in range(1, 101)]
    path, out, cp = scratch_dir(spark, "in"), scratch_dir(spark, "out"), scratch_dir(spark, "cp")
    # the second delivery repeats steps of the first and has the one after them
    for part in (rows[:90] + rows[100:190], rows[20:95], rows[90:100] + rows[150:160] + rows[190:]):
        deliver(frame(spark, part, STEPS), path)
        df = transitions.stream_transitions(stream(spark, path, STEPS), ["x", "ts"], "1 minute", "1 hour")
        with sinks.rocksdb(spark):
            sinks.start(df, cp, out, available_now=True).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [(e, i, t, x, x + 100, t + dt.timedelta(seconds=10)) for e, i, t, x in rows if i < 100]


def test_state_holds_runs_and_not_their_steps():
    class Held:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value
        put = update = lambda self, value: setattr(self, "value", value)
        clear = lambda self: setattr(self, "value", None)

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getListState(self, name, _):
            return self.states.setdefault(name, Held())

        getValueState = getListState
        listTimers = lambda self: self.timers
        registerTimer = lambda self, at: self.timers.append(at)

    class Watermark:
        ms = 0
        getCurrentWatermarkInMs = lambda self: self.ms

    handle, mark, second = Handle(), Watermark(), 1_000_000
    blocks = transitions._Blocks(60 * second, None, [0])
    blocks.init(handle)

    def told(*steps):
        rows = [{"_step": s, "_us": s * second, "_row": (f"row {s}",)} for s in steps]
        return [(r["_kind"], r["_step"], r["_next"]) for r in blocks.handleInputRows(("e", 0), iter(rows), mark)]

    done = lambda steps: [(transitions.DONE, s, (f"row {s + 1}",)) for s in steps]
    assert told(*range(100, 200)) == done(range(100, 199))
    assert len(handle.states["waiting"].value) == 2  # the run of those that are done, and the newest
    assert told(*range(120, 130), 199) == []
    assert told(200, 98) == done([199])
    assert told(99, 201) == done([98, 99, 200])
    assert len(handle.states["waiting"].value) == 2
    mark.ms = 150_000
    assert told() == [(transitions.HEAD, 98, None)]
    assert told(160, 180) == [] and len(handle.states["waiting"].value) == 2
    mark.ms = 201_000
    assert told() == [(transitions.TAIL, 201, None)]
    assert [e[0] for e in handle.states["waiting"].value] == [201]
    mark.ms = 300_000
    assert told() == [(transitions.EXPIRED, 201, None)] and not handle.states["waiting"].exists()


def test_step_counts_over_batches(spark):
    schema = "episode string, step bigint, ts timestamp"
    path, out = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    at = lambda day: T0 + dt.timedelta(days=day)
    for part in ([("a", 1, at(0)), ("b", 1, at(0)), ("a", 2, at(0))], [("a", 3, at(1))], [("a", 4, at(9)), ("c", 1, at(9))], [("c", 2, at(30))], [("c", 3, at(30))]):
        deliver(frame(spark, part, schema), path)
    counts = transitions.stream_step_counts(stream(spark, path, schema), "1 hour")
    query = sinks.start(counts, scratch_dir(spark, "cp"), sinks.batch_folder(out), "update", available_now=True)
    query.awaitTermination()
    assert {r["episode"]: r["steps"] for r in sinks.latest_counts(sinks.read_batches(spark, out)).collect()} == {"a": 4, "b": 1, "c": 3}
    # idle episodes leave no state behind
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_a_repeated_batch_replaces_its_own_output(spark):
    out = scratch_dir(spark, "out")
    write = sinks.batch_folder(out)
    write(spark.range(3), 0)
    write(spark.range(5), 1)
    write(spark.range(3), 0)
    assert sinks.read_batches(spark, out).count() == 8


def test_config_batches_compare_with_the_version_before_them(spark):
    configs = frame(spark, [(1, "v1"), (2, "v2")], "cfg_id bigint, sha string")
    log, schema = scratch_dir(spark, "log"), "cfg_id bigint, seq bigint, base_sha string, body string"
    apply = sinks.config_updates(configs, log)
    first = frame(spark, [(1, 1, "v1", "x"), (2, 1, "old", "y")], schema)
    for _ in range(2):  # the second run repeats the batch
        apply(first, 0)
    after = {r["cfg_id"]: r["sha"] for r in sinks.current_versions(configs, log).collect()}
    assert after[2] == "v2"
    apply(frame(spark, [(1, 2, "v1", "z"), (2, 2, "v2", "w")], schema), 1)
    apply(frame(spark, [(1, 3, after[1], "q")], schema), 2)
    logged = sorted((int(r["batch"]), r["cfg_id"], r["body"]) for r in sinks.read_batches(spark, log).collect())
    assert logged == [(0, 1, "x"), (1, 2, "w"), (2, 1, "q")]


def test_late_and_repeated_samples(spark):
    def at(minute, i):
        return (f"{minute}-{i}", T0 + dt.timedelta(minutes=minute), i)

    path, out = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    for part in ([at(60, i) for i in range(5)], [at(61, 0), at(60, 0)], [at(1, i) for i in range(7)] + [at(62, 0)]):
        deliver(frame(spark, part), path)
    kept = sinks.without_repeats(stream(spark, path), ["k"], "10 minutes")
    late, cp = sinks.record_late(spark, scratch_dir(spark, "late")), scratch_dir(spark, "cp")
    query = sinks.start(kept, cp, out, available_now=True)
    query.awaitTermination()
    late.finish(query)
    assert spark.read.parquet(out).count() == 5 + 1 + 1
    # 110 batches of one late row each, more than the stream itself remembers, after a restart
    frame(spark, [at(2, i) for i in range(110)]).repartition(110).write.mode("append").parquet(path)
    more = sinks.start(sinks.without_repeats(stream(spark, path), ["k"], "10 minutes"), cp, out, available_now=True)
    more.awaitTermination()
    late.finish(more)
    spark.streams.removeListener(late)
    assert more.id == query.id
    assert sinks.late_rows(spark, late.path).agg(F.sum("late")).first()[0] == 7 + 110


def test_steps_without_a_near_successor_are_reported(spark):
    schema = "episode string, step bigint, ts timestamp"
    rows = [("a", 1, 0), ("a", 2, 30), ("a", 3, 300), ("b", 1, 10), ("c", 1, 9000), ("d", None, 20)]
    path, out = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    deliver(frame(spark, [(e, i, T0 + dt.timedelta(seconds=s)) for e, i, s in rows], schema), path)
    df = transitions.stream_unpaired_steps(stream(spark, path, schema), "1 minute", "1 minute")
    with sinks.rocksdb(spark):
        sinks.start(df, scratch_dir(spark, "cp"), out, available_now=True).awaitTermination()
    assert sorted(((r["episode"], r["step"]) for r in spark.read.parquet(out).collect()), key=str) == [("a", 2), ("a", 3), ("b", 1), ("d", None)]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Cluster:
        class conf:
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Cluster(), "x")
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir", "/"))
