"""Responses, sample tables, configuration updates, chunked helpers and replay tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from telemill.operators import config, replay
from telemill.operators.chunked import dense_index, number_rows, running_total, with_rows_ahead
from telemill.session import scratch_dir
from telemill.sources import replay_table
from telemill.sources.answers import good, parse_answers, rejected
from telemill.sources.responses import failed_responses, parse_instant, parse_range, read_responses
from telemill.sources.samples import read_samples, write_samples

VECTOR = (
    '{"status":"success","data":{"resultType":"vector","result":['
    '{"metric":{"pod":"web-7"},"value":[1700000000.25,"4096"]},'
    '{"metric":{},"value":[1700000000.25,"NaN"]},{"metric":{"pod":"b"},"value":[1700000000,"x"]}]}}'
)
MATRIX = (
    '{"status":"success","data":{"resultType":"matrix","result":['
    '{"metric":{"pod":"a","node":"n"},"values":[[1700000000,"1"],[1700000060.5,"2.5"]]}]}}'
)
FAILED = '{"status":"error","errorType":"timeout"}'


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")


def test_instant_answers(spark):
    rows = parse_instant(bodies(spark, VECTOR, FAILED, "no json")).select(
        "id", F.col("labels")["pod"].alias("pod"), F.unix_micros("ts").alias("us"), "v"
    ).collect()
    assert [r["id"] for r in rows] == [0, 0, 0]
    assert (rows[0]["pod"], rows[0]["us"], rows[0]["v"]) == ("web-7", 1700000000250000, 4096.0)
    assert rows[1]["pod"] is None
    assert rows[1]["v"] != rows[1]["v"]
    assert rows[2]["v"] is None


def test_range_answers(spark):
    rows = parse_range(bodies(spark, MATRIX, FAILED)).select(F.col("labels")["node"].alias("n"), F.unix_micros("ts").alias("us"), "v").collect()
    assert [tuple(r) for r in rows] == [("n", 1700000000000000, 1.0), ("n", 1700000060500000, 2.5)]


def test_stamps_that_are_no_number_and_answers_of_the_other_kind(spark):
    odd = VECTOR.replace('[1700000000.25,"4096"]', '["soon","4096"]')
    rows = parse_instant(bodies(spark, odd, MATRIX)).collect()
    assert [(r["id"], r["ts"] is None) for r in rows] == [(0, True), (0, False), (0, False)]
    assert parse_range(bodies(spark, odd, MATRIX)).select("id").distinct().collect() == [(1,)]


def test_failed_answers_are_reported(spark):
    assert [r["id"] for r in failed_responses(bodies(spark, VECTOR, FAILED, "no json")).collect()] == [1, 2]


def test_landed_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text(VECTOR + "\n" + MATRIX + "\n")
    landed = read_responses(spark, str(tmp_path))
    assert landed.count() == 2
    assert parse_instant(landed).where("v > 0").count() == 1 + 1  # NaN is above every number


def test_samples_are_read_by_metric_and_day(spark):
    day = dt.datetime(2024, 3, 1)
    rows = [(m, day + dt.timedelta(days=i), float(i)) for m in ("cpu", "mem") for i in range(4)]
    path = scratch_dir(spark, "samples")
    write_samples(spark.createDataFrame(rows, "metric string, ts timestamp, v double"), path)
    df = read_samples(spark, path, "cpu", "2024-03-02", "2024-03-03")
    assert sorted(r["v"] for r in df.collect()) == [1.0, 2.0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "metric" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def document(spark, terms):
    sizes = "struct<requests:struct<memory:string,cpu:string>,limits:struct<memory:string,cpu:string>>"
    selector = "array<struct<matchExpressions:array<struct<key:string,operator:string,values:array<string>>>>>"
    schema = (
        f"struct<amf:struct<resources:{sizes}>,upf:struct<affinity:struct<nodeAffinity:struct<"
        f"requiredDuringSchedulingIgnoredDuringExecution:struct<nodeSelectorTerms:{selector}>>>>>"
    )
    text = (
        '{"amf":{"resources":{"requests":{"memory":"1Mi","cpu":"1m"},"limits":{"memory":"2Mi","cpu":"2m"}}},'
        '"upf":{"affinity":{"nodeAffinity":{"requiredDuringSchedulingIgnoredDuringExecution":{"nodeSelectorTerms":' + terms + "}}}}}"
    )
    df = spark.createDataFrame([(1, text)], "cfg_id bigint, text string").withColumn("doc", F.from_json("text", schema))
    return df.withColumn("sha", F.sha2(F.to_json("doc"), 256)).drop("text")


EXPRESSION = '{"key":"g","operator":"In","values":["Small","Tiny"]}'
TERMS = f'[{{"matchExpressions":[{EXPRESSION},{EXPRESSION}]}},{{"matchExpressions":[{EXPRESSION}]}}]'


def test_patch_limits_replaces_the_whole_resources(spark):
    configs = document(spark, TERMS)
    size = F.struct(F.lit("9Mi").alias("memory"), F.lit("9m").alias("cpu"))
    actions = spark.range(1, 2).select(F.col("id").alias("cfg_id"), F.lit("amf").alias("target_pod"), size.alias("requests"), size.alias("limits"))
    got = config.patch_limits(configs, actions, "amf").first()
    assert got["doc"]["amf"]["resources"]["requests"].asDict() == {"memory": "9Mi", "cpu": "9m"}
    assert got["doc"]["upf"] == configs.first()["doc"]["upf"]
    assert config.patch_limits(configs, actions, "upf").count() == 0


@pytest.mark.parametrize(("terms", "ok"), [(TERMS, True), ("[]", False), ('[{"matchExpressions":[]}]', False), ("null", False)])
def test_patch_nodegroup_changes_the_first_expression_only(spark, terms, ok):
    actions = spark.createDataFrame([(1, "upf", "Large")], "cfg_id bigint, target_pod string, values string")
    patched = config.patch_nodegroup(document(spark, terms), actions, "upf")
    assert config.unpatchable(patched).count() == (0 if ok else 1)
    assert config.as_updates(patched).count() == (1 if ok else 0)
    if ok:
        found = patched.first()["doc"]["upf"]["affinity"]["nodeAffinity"]["requiredDuringSchedulingIgnoredDuringExecution"]["nodeSelectorTerms"]
        assert [[e["values"] for e in t["matchExpressions"]] for t in found] == [[["Large"], ["Small", "Tiny"]], [["Small", "Tiny"]]]


def test_updates_of_old_versions_are_rejected(spark):
    current = spark.createDataFrame([(1, "v1", "a"), (2, "v2", "b"), (3, "v3", "c")], "cfg_id bigint, sha string, body string")
    updates = spark.createDataFrame(
        [(1, 5, "v1", "x"), (1, 4, "v1", "y"), (1, 3, "v0", "z"), (2, 1, "v1", "w"), (9, 1, "v9", "q")],
        "cfg_id bigint, seq bigint, base_sha string, body string",
    )
    accepted, rejected = config.apply_updates(current, updates)
    assert [(r["cfg_id"], r["seq"], r["body"]) for r in accepted.collect()] == [(1, 4, "y")]
    assert sorted((r["cfg_id"], r["seq"]) for r in rejected.collect()) == [(1, 3), (1, 5), (2, 1), (9, 1)]
    after = {r["cfg_id"]: r["body"] for r in config.next_versions(current, accepted).collect()}
    assert after == {1: "y", 2: "b", 3: "c"}


def test_running_total_over_chunks(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for k in ("a", "b"):
        total = 0
        for i in range(200):
            value, reset = rnd.randint(0, 9), rnd.random() < 0.03
            total = value if reset else total + value
            rows.append((k, i // 17, i, value, reset))
            want[k, i] = total
    df = spark.createDataFrame(rows, "k string, c int, i int, x bigint, r boolean")
    got = running_total(df, ["k"], "c", ["i"], F.col("x"), "y", F.col("r"))
    assert {(r["k"], r["i"]): r["y"] for r in got.collect()} == want
    numbered = number_rows(df.where("i % 3 = 0"), ["k"], "c", ["i"], "n")
    assert {(r["k"], r["i"]): r["n"] for r in numbered.collect()} == {(k, i): i // 3 + 1 for k in "ab" for i in range(0, 200, 3)}


def test_dense_index_over_gaps(spark):
    seqs = random.Random(4).sample(range(10_000), 300)
    got = dense_index(spark.createDataFrame([(s,) for s in seqs], "seq bigint"), "seq")
    assert [r["idx"] for r in got.orderBy("seq").collect()] == list(range(300))


def test_rows_ahead_must_fit_in_a_chunk(spark):
    with pytest.raises(ValueError, match="ahead"):
        with_rows_ahead(spark.range(3), "id", 2, 3)


def steps(spark, n=25, episodes=("a", "b")):
    rows = [(e, i, float(i) / 2, i % 2, float(i)) for e in episodes for i in range(1, n + 1)]
    return replay.timesteps(spark.createDataFrame(rows, "episode string, step bigint, obs double, action int, reward double"))


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_trajectories_cross_chunks_but_not_episodes(spark, chunk):
    got = replay.trajectories(steps(spark), ["obs"], chunk=chunk).orderBy("episode", "step").collect()
    assert len(got) == 48
    assert [r["step"] for r in got[:24]] == list(range(1, 25))
    assert [r["step_type"] for r in got[:3]] == [0, 1, 1]
    assert all(r["reward"] == r["step"] + 1 and r["next_obs"] == (r["step"] + 1) / 2 and r["next_step_type"] == 1 for r in got)


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_steps_pair_across_missing_numbers(spark, chunk):
    df = steps(spark, 9, ("a",)).where("step not in (1, 3, 6, 7)").drop("discount", "step_type")
    pairs = {r["step"]: r["next_step"] for r in replay.transition_pairs(df, ["step", "obs"], chunk=chunk).collect()}
    assert pairs == {2: 4, 4: 5, 5: 8, 8: 9, 9: None}
    assert {r["step"]: r["step_type"] for r in replay.timesteps(df).collect()} == {2: 0, 4: 1, 5: 1, 8: 1, 9: 1}
    runs = {r["step"]: [i["step"] for i in r["items"]] for r in replay.sequences(df, 3, chunk=chunk).collect()}
    assert runs == {2: [2, 4, 5], 4: [4, 5, 8], 5: [5, 8, 9]}


@pytest.mark.parametrize(("n", "chunk"), [(1, 10), (2, 3), (3, 3), (5, 4)])
def test_sequences(spark, n, chunk):
    got = replay.sequences(steps(spark, 11), n, chunk=chunk).collect()
    assert len(got) == 2 * (11 - n + 1)
    assert all([i["step"] for i in r["items"]] == list(range(r["step"], r["step"] + n)) for r in got)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_retention_keeps_the_newest(spark, width):
    seqs = random.Random(6).sample(range(2000), 150)
    df = spark.createDataFrame([(s, s % 3) for s in seqs], "seq bigint, g int")
    for n in (1, 40, 150, 400):
        assert sorted(r["seq"] for r in replay.retain_latest(df, n, width=width).collect()) == sorted(seqs)[-n:]
    for n in (5, 30, 100_000):
        per = replay.retain_latest(df, n, by=["g"], width=width).collect()
        assert sorted(r["seq"] for r in per) == sorted(s for g in range(3) for s in sorted(x for x in seqs if x % 3 == g)[-n:])
    assert replay.retain_latest(df.withColumn("g", F.lit(None).cast("int")), 5, by=["g"], width=width).count() == 5
    assert replay.retain_latest(df.where("seq < 0"), 5).count() == 0


def test_samples_are_reproducible_and_with_replacement(spark):
    df = spark.createDataFrame([(i * 3, f"r{i}") for i in range(50)], "seq bigint, name string")
    one = replay.sample_batches(df, batch=10, batches=30, seed=1)
    rows = {(r["batch_no"], r["draw_no"]): r["name"] for r in one.collect()}
    assert len(rows) == 300
    assert rows == {(r["batch_no"], r["draw_no"]): r["name"] for r in replay.sample_batches(df.repartition(5), 10, 30, 1).collect()}
    assert rows != {(r["batch_no"], r["draw_no"]): r["name"] for r in replay.sample_batches(df, 10, 30, 2).collect()}
    counts = [list(rows.values()).count(f"r{i}") for i in range(50)]
    assert 0 < max(counts) < 20
    assert sum(1 for c in counts if c) > 40
    assert replay.sample_batches(df, 10, seed=1).count() == 50


def test_episode_rollup(spark):
    got = {r["episode"]: (r["steps"], r["total_reward"], r["mean_reward"]) for r in replay.episode_rollup(steps(spark, 4)).collect()}
    assert got == {"a": (4, 10.0, 2.5), "b": (4, 10.0, 2.5)}


def test_rows_without_key_or_step_are_kept(spark):
    """A NULL episode is an episode; a NULL step has no neighbours."""
    rows = [(None, 1, 10), (None, 5, 50), (None, None, 0), ("a", 3, 30), ("a", None, 1), ("a", 900_000, 9), ("a", None, 2)]
    steps = spark.createDataFrame(rows, "episode string, step bigint, x bigint")
    pairs = {(r["episode"], r["step"], r["x"]): r["next_x"] for r in replay.transition_pairs(steps, ["step", "x"], chunk=2).collect()}
    assert pairs == {(None, 1, 10): 50, (None, 5, 50): None, (None, None, 0): None, ("a", 3, 30): 9, ("a", None, 1): None, ("a", 900_000, 9): None, ("a", None, 2): None}
    runs = replay.sequences(steps, 2, chunk=2).collect()
    assert sorted((str(r["episode"]), [i["x"] for i in r["items"]]) for r in runs) == [("None", [10, 50]), ("a", [30, 9])]
    kinds = {(r["episode"], r["step"], r["x"]): r["step_type"] for r in replay.timesteps(steps).collect()}
    assert len(kinds) == 7 and {k for k, v in kinds.items() if v == 0} == {(None, 1, 10), ("a", 3, 30)}


@pytest.mark.parametrize("n", [2, 3, 5])
@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_runs_over_several_sparse_blocks(spark, n, chunk):
    r = random.Random(n * chunk)
    rows = [(e, s, f"{e}{s}") for e in ("a", "b", "c") for s in sorted(r.sample(range(-60, 60), 17))] + [("d", 1, "d1")]
    found = replay.sequences(spark.createDataFrame(rows, "episode string, step bigint, name string").repartition(3), n, chunk=chunk)
    want = [(e, [x[2] for x in own[i : i + n]]) for e in "abcd" for own in [[x for x in rows if x[0] == e]] for i in range(len(own) - n + 1)]
    assert sorted((x["episode"], [i["name"] for i in x["items"]]) for x in found.collect()) == sorted(want)


def test_draws_by_counts_follow_the_law(spark):
    df = spark.createDataFrame([(10**12 * k + k % 3, f"n{k}") for k in range(200)], "seq bigint, name string")
    counts = dict.fromkeys([f"n{k}" for k in range(200)], 0)
    for seed in range(5):
        found = {r["name"]: r["draws"] for r in replay.draw_counts(df, 4_000, seed, rows=30).collect()}
        assert sum(found.values()) == 4_000
        for name, k in found.items():
            counts[name] += k
    # chi-square of 199 degrees of freedom: mean 199, standard deviation 20
    assert 120 < sum((k - 100) ** 2 / 100 for k in counts.values()) < 290
    again = {r["name"]: r["draws"] for r in replay.draw_counts(df.repartition(3), 4_000, 4, rows=30).collect()}
    assert again == found
    assert replay.draw_counts(df.limit(0), 10).count() == 0 and replay.draw_counts(df, 0).count() == 0


def test_answers_of_all_kinds_in_one_pass(spark):
    scalar = '{"status":"success","data":{"resultType":"scalar","result":[1700000000.5,"7"]}}'
    broken = (
        '{"status":"success","data":{"resultType":"matrix","result":[{"metric":{"pod":"a"},"values":[[1700000000,"1"],["soon","2"],[1700000060,"x"],7]},'
        '{"values":[[1700000000,"1"]]},{"metric":{"pod":"b"},"values":[]},{"metric":{"pod":"c"}},null]}}'
    )
    empty = '{"status":"success","data":{"resultType":"vector","result":[]}}'
    odd = ['{"status":"success"}', '{"status":"success","data":{"resultType":"vector","result":3}}', '{"data":{}}', "[1, 2]", '"text"', "", None]
    given = bodies(spark, VECTOR, MATRIX, scalar, FAILED, "no json", broken, empty, *odd).withColumn("kind_", F.lit("mine")).withColumn("own", F.lit(1))
    parsed = parse_answers(given)
    assert parsed.columns == ["id", "kind_", "own", "kind", "labels", "ts", "v", "reason"]
    rows = good(parsed).select("id", "kind", F.to_json("labels").alias("labels"), F.unix_micros("ts").alias("us"), F.col("v").cast("string").alias("v")).collect()
    assert sorted(map(tuple, rows)) == [
        (0, "vector", '{"pod":"web-7"}', 1700000000250000, "4096.0"), (0, "vector", "{}", 1700000000250000, "NaN"),
        (1, "matrix", '{"node":"n","pod":"a"}', 1700000000000000, "1.0"), (1, "matrix", '{"node":"n","pod":"a"}', 1700000060500000, "2.5"),
        (2, "scalar", "{}", 1700000000500000, "7.0"), (5, "matrix", '{"pod":"a"}', 1700000000000000, "1.0"),
    ]
    wrong = sorted((r["id"], r["reason"]) for r in parsed.where("reason is not null").collect())
    assert wrong == sorted([
        (0, "value is no number"), (3, "error timeout"), (4, "no JSON"), (5, "time is no number"), (5, "value is no number"), (5, "time is no number"), (5, "series without labels"),
        (5, "series without samples"), (5, "series without samples"), (5, "series without labels"), (7, "unknown result type"), (8, "no result"), (9, "error"), (10, "error"), (11, "error"),
        (12, "no JSON"), (13, "no JSON"),
    ])
    assert rejected(parsed).agg(F.sum("rejects")).scalar() is not None
    assert parse_answers(given.limit(0)).collect() == []


def test_answers_equal_the_parsers_of_one_kind(spark):
    given = bodies(spark, VECTOR, MATRIX, FAILED)
    shown = lambda df: sorted((r["id"], sorted(r["labels"].items()), r["ts"], r["v"]) for r in df.where("v = v and v < 1e300").collect())
    parsed = good(parse_answers(given))
    assert shown(parsed.where("kind = 'vector'")) == shown(parse_instant(given))
    assert shown(parsed.where("kind = 'matrix'")) == shown(parse_range(given))


def test_replay_table_is_bounded_when_written(spark):
    path, pick = scratch_dir(spark, "replay"), random.Random(4)
    seqs, seen, n, width = pick.sample(range(5_000), 1_500), [], 120, 50
    for b in range(6):
        # mostly newer rows, some late ones
        part = sorted(seqs)[b * 250 : (b + 1) * 250][5:] + [s for s in sorted(seqs)[:5] if b == 5]
        rows = spark.createDataFrame([(s, f"r{s}") for s in part], "seq long, item string").repartition(3)
        for _ in range(1 + (b == 2)):  # a repeated batch
            replay_table.append(rows, path, b, n, width=width)
        seen += part
        newest = sorted(seen)[::-1][:n]
        assert [tuple(r) for r in replay_table.kept(spark, path, n).collect()] == [(s, f"r{s}") for s in newest]
        held = [r["seq"] for r in spark.read.parquet(path).collect()]
        assert len(held) == len(set(held)) <= n + width and min(held) >= newest[-1] // width * width
    replay_table.append(rows.limit(0), path, 6, n, width=width)
    assert replay_table.kept(spark, path, n).count() == n


def test_replay_table_writes_no_range_that_goes_at_once(spark, monkeypatch):
    path = scratch_dir(spark, "replay")
    rows = spark.range(4_000).selectExpr("id as seq", "'x' as item")
    monkeypatch.setattr(replay_table, "_drop_below", lambda *_: None)
    for b in range(2):
        replay_table.append(rows.where(F.col("seq") % 2 == b), path, b, 100, width=50)
        assert sorted(start for start, _ in replay_table._ranges(spark, path)) == [3_800, 3_850, 3_900, 3_950]
    assert [r["seq"] for r in replay_table.kept(spark, path, 100).collect()] == list(range(3_999, 3_899, -1))


def test_replay_table_of_sparse_numbers_and_fewer_rows(spark):
    path = scratch_dir(spark, "replay")
    replay_table.append(spark.createDataFrame([], "seq long, item string"), path, 0, 5)
    rows = spark.createDataFrame([(s * 10**12, "x") for s in range(-3, 9)], "seq long, item string")
    replay_table.append(rows, path, 1, 20)
    assert replay_table.kept(spark, path, 20).count() == 12
    replay_table.append(spark.createDataFrame([(10**14, "y")], rows.schema), path, 2, 5)
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == [s * 10**12 for s in range(5, 9)] + [10**14]
