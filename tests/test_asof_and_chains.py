"""As-of joins, config updates built on each other, and the version log's snapshots, against plain versions."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from telemill import session
from telemill.operators import config, lookup, rollup
from telemill.operators.asof import asof_join
from telemill.streaming import sinks


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_asof(left, right, direction, exact, within):
    out = {}
    for i, key, at, _ in left:
        ok = []
        for k, t, *values in right if at is not None else []:
            gap = None if t is None else (at - t if direction == "backward" else t - at)
            if k == key and gap is not None and (gap > 0 or (exact and gap == 0)) and (within is None or gap <= within):
                ok.append((-gap, [(v is not None, v or 0) for v in values], values))
        out[i] = tuple(max(ok, key=lambda x: x[:2])[2]) if ok else (None, None)
    return out


@pytest.mark.parametrize("direction,exact,within,width,levels", [
    ("backward", True, None, 7, 2), ("backward", False, 40, 1, 3), ("forward", True, 40, 3, 1), ("forward", False, None, 100_000, 3),
])
def test_asof_is_the_nearest_row(spark, direction, exact, within, width, levels):
    r = random.Random(7)
    keys = [None, "a", "b", "hot", "hot", "hot"]
    left = [(i, r.choice(keys), r.choice([None] + [r.randint(-500, 3000)] * 12), "x") for i in range(400)]
    right = [(r.choice([*keys, "c"]), r.choice([None] + [r.randint(-500, 3000)] * 9), r.choice([None, r.randint(0, 99)]), str(r.randint(0, 9))) for _ in range(300)]
    ours = spark.createDataFrame(left, "block int, key string, at long, best string")
    theirs = spark.createDataFrame(right, "key string, t long, v int, row string")
    found = asof_join(ours, theirs, ["key"], "at", ["v", "row"], "t", width, direction, exact, within, levels)
    assert found.columns == ["block", "key", "at", "best", "v", "row"]
    assert {x["block"]: (x["v"], x["row"]) for x in found.collect()} == plain_asof(left, right, direction, exact, within)
    assert asof_join(ours.limit(0), theirs, ["key"], "at", ["v"], "t", width).count() == 0
    assert asof_join(ours, theirs.limit(0), ["key"], "at", ["v"], "t", width).where("v is null").count() == 400


def test_asof_spreads_a_key_over_its_blocks(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), "id", F.spark_partition_id().alias("x"))
    found = asof_join(rows, rows.withColumn("v", F.col("id")), ["key"], "id", ["v"], width=100).withColumn("task", F.spark_partition_id())
    assert found.where("v <> id").count() == 0
    assert found.groupBy("task").count().agg(F.max("count")).first()[0] < 20_000 * 0.6


def test_lookup_at_any_time(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(1, "p", at(9)), (2, "p", at(10)), (3, "p", at(30)), (4, "q", at(5))], "id int, pod string, ts timestamp")
    samples = spark.createDataFrame([("p", at(4), 1.0), ("p", at(10), 2.0), ("p", at(10), 3.0), ("p", at(12), float("nan")), ("p", at(13), None)], "pod string, ts timestamp, v double")
    found = {x["id"]: x["v"] for x in lookup.lookup_at(events, samples, ["pod"], "5 seconds").collect()}
    assert found == {1: None, 2: 3.0, 3: None, 4: None}
    found = {x["id"]: x["v"] for x in lookup.lookup_at(events, samples, ["pod"], "6 seconds").collect()}
    assert found[1] == 1.0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_labels_spread_over_time_are_those_of_the_range_join(spark, how):
    day = lambda d: dt.datetime(2024, 1, d)
    history = [("n", day(3), day(5), "a"), ("n", day(5), None, "b"), ("m", day(2), day(4), "c"), (None, day(1), None, "x")]
    history = spark.createDataFrame(history, "node string, valid_from timestamp, valid_to timestamp, instance_type string")
    rows = spark.createDataFrame([(n, day(d)) for n in ("n", "m", "o", None) for d in range(1, 9)], "node string, t timestamp")
    plain = rollup.labelled(rows, history, ["instance_type"], how=how)
    spread = rollup.labelled(rows, history, ["instance_type"], how=how, spread="1 day")
    assert spread.columns == ["node", "t", "instance_type"]
    assert sorted(spread.collect(), key=str) == sorted(plain.select(*spread.columns).collect(), key=str)


def plain_chain(current, updates):
    """Compare-and-set of one update after the other."""
    now, won = dict(current), set()
    for cfg, seq, base, body in sorted(updates, key=lambda u: u[1]):
        if cfg in now and now[cfg] == base:
            now[cfg] = sha(body)
            won.add((cfg, seq))
    return won, now


def chain_updates():
    r = random.Random(2)
    updates, seq, tip = [], 0, sha("start")
    for k in range(1000):  # one long chain with branches, stale updates and a return to an earlier text
        body = "start" if k == 500 else f"body {k}"
        seq += r.randint(1, 50_000)
        updates.append(("long", seq, tip, body))
        if k % 10 == 0:
            updates.append(("long", seq + 1, tip, f"branch {k}"))
            updates.append(("long", seq + 2, sha(f"branch {k}"), f"on the branch {k}"))
            seq += 2
        tip = sha(body)
    # a ring that nothing leads to, updates whose base comes later, and a config that is not known
    updates += [("ring", 1, sha("b"), "a"), ("ring", 2, sha("a"), "b"), ("ring", 3, sha("b"), "a")]
    updates += [("late", 1, sha("two"), "three"), ("late", 2, sha("one"), "two"), ("late", 5, sha("two"), "four")]
    updates += [("none", 1, sha("one"), "two"), ("same", 1, sha("one"), "one"), ("same", 2, sha("one"), "one"), ("same", 3, sha("one"), "two")]
    for c in range(60):
        texts = [f"{c}:{k}" for k in range(4)]
        updates += [(f"c{c}", s, sha(r.choice(texts)), r.choice(texts)) for s in range(12)]
    current = {"long": sha("start"), "ring": sha("z"), "late": sha("one"), "same": sha("one"), **{f"c{c}": sha(f"{c}:0") for c in range(60)}}
    return current, updates


def test_chains_are_accepted_as_one_after_the_other(spark):
    current, updates = chain_updates()
    now = spark.createDataFrame(list(current.items()), "cfg_id string, sha string")
    rows = spark.createDataFrame(updates, "cfg_id string, seq long, base_sha string, body string")
    judged = config.judge_chains(now, rows).collect()
    won, last = plain_chain(current, updates)
    assert len(judged) == len(updates)
    assert {(x["cfg_id"], x["seq"]) for x in judged if x["accepted"]} == won
    assert sum(c == "long" for c, _ in won) == 1000 and not any(c == "ring" for c, _ in won)
    accepted, rejected = config.apply_updates(now, rows, chains=True)
    assert rejected.count() == len(updates) - len(won)
    bodies = now.withColumn("body", F.lit(None).cast("string"))
    assert {x["cfg_id"]: x["sha"] for x in config.next_versions(bodies, accepted).collect()} == last


def test_chains_through_versions_that_many_updates_share(spark, monkeypatch):
    current, updates = chain_updates()
    updates += [("long", -s, sha("start"), f"early {s}") for s in range(1, 40)]  # the last of them is the first
    now = spark.createDataFrame(list(current.items()), "cfg_id string, sha string")
    rows = spark.createDataFrame(updates, "cfg_id string, seq long, base_sha string, body string")
    won, _ = plain_chain(current, updates)
    for most in (5, 10_000):
        monkeypatch.setattr(config, "SEQS", most)
        assert {(x["cfg_id"], x["seq"]) for x in config.judge_chains(now, rows).where("accepted").collect()} == won


def test_chains_read_their_updates_once_and_shuffle_links_once(spark):
    current, updates = chain_updates()
    now = spark.createDataFrame(list(current.items()), "cfg_id string, sha string")
    rows = spark.createDataFrame(updates, "cfg_id string, seq long, base_sha string, body string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert config.judge_chains(now, rows.mapInArrow(counted, rows.schema)).count() == len(updates)
    assert read.value == len(updates)
    links = config._followed(now, rows.withColumn("_made", F.sha2("body", 256)))
    assert links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_version_log_costs_a_snapshot_and_a_few_batches(spark, tmp_path):
    r = random.Random(3)
    start = {f"c{c}": sha(f"c{c}:0") for c in range(5)}
    configs = spark.createDataFrame(list(start.items()), "cfg_id string, sha string")
    apply, now, seq = sinks.config_updates(configs, str(tmp_path), every=3), dict(start), 0
    for batch in range(8):
        updates = []
        for _ in range(6):
            seq += 1
            c = f"c{r.randrange(5)}"
            updates.append((c, seq, r.choice([now[c], sha(f"{c}:{seq - 2}"), sha("other")]), f"{c}:{seq}"))
        rows = spark.createDataFrame(updates, "cfg_id string, seq long, base_sha string, body string")
        apply(rows, batch)
        if batch in (2, 5, 6):
            apply(rows, batch)  # a batch that is repeated, also where a snapshot was written
        _, now = plain_chain(now, updates)
        assert {x[0]: x[1] for x in sinks.versions_before(configs, str(tmp_path), batch + 1, 3).collect()} == now
    assert {x[0]: x[1] for x in sinks.current_versions(configs, str(tmp_path)).collect()} == now
    files = sinks.versions_before(configs, str(tmp_path), 8, 3).inputFiles()
    folders = {f.split(str(tmp_path))[1].rsplit("/", 1)[0] for f in files if str(tmp_path) in f}
    assert folders <= {"/snapshot/slot=1", "/batch=6", "/batch=7"}


def test_scratch_without_the_setting(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Bare:
        conf, sparkContext = Conf(), spark.sparkContext

    one, two = session.scratch_dir(Bare(), "x"), session.scratch_dir(Bare(), "x")
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
    monkeypatch.setattr(Bare, "sparkContext", type("C", (), {"master": "spark://host", "applicationId": "a"})())
    with pytest.raises(ValueError):
        session.scratch_dir(Bare(), "x")
