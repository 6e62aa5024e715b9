"""Column functions, dimensions and rollups on hand-written rows."""

import datetime as dt

import pytest
from telemill.operators.lookup import lookup_on_grid
from pyspark.sql import functions as F

from telemill.functions.labels import drop_unlabelled, equals, instance_type, matches, to_number
from telemill.functions.quantities import cpu_quantity, memory_quantity
from telemill.functions.rewards import hourly_reward
from telemill.functions.timegrid import micros
from telemill.functions.urls import parse_config_url
from telemill.operators.rollup import align_pod_metrics, infra_cost, observation_vector, unknown_instance_types, with_price
from telemill.operators.sizing import as_actions, right_size
from telemill.operators.trials import best_arm, trial_ledger
from telemill.sources import dimensions
from telemill.sources.queryset import QuerySet

T = dt.datetime(2024, 3, 1)


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_widths():
    assert micros("2 minutes") == 120 * 10**6
    assert micros("1 hour 30 minutes") == 5400 * 10**6
    assert micros(dt.timedelta(milliseconds=5)) == 5000
    assert micros(15) == 15 * 10**6
    with pytest.raises(ValueError, match="positive"):
        micros("0 minutes")


@pytest.mark.parametrize(("pattern", "want"), [
    ("open5gs-upf.*", [True, False, False, None]),
    ("open5gs-upf-0", [True, False, False, None]),
    ("upf", [False, False, False, None]),
    ("open5gs-upf-0|amf", [True, False, True, None]),
    (".*upf.*", [True, True, False, False]),
    ("open5gs-upf-[0-9]+", [True, False, False, False]),
    (".*", [True, True, True, True]),
    ("amf|x-.*", [False, True, True, None]),
    ("amf|", [False, False, True, True]),
    ("a|.*", [True, True, True, True]),
    ("(open5gs|x)-.*", [True, True, False, False]),
    ("(amf)?", [False, False, True, True]),
])
def test_matchers_are_anchored(spark, pattern, want):
    got = column(spark, ["open5gs-upf-0", "x-open5gs-upf-4", "amf", None], "string", lambda x: matches(x, pattern))
    assert [bool(g) for g in got] == [bool(w) for w in want]


def test_prefix_patterns_reach_the_scan(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/events.parquet").where(matches("event_type", "view.*")).select("event_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(event_type,view)" in text
    either = spark.read.parquet(f"{sf_dir}/events.parquet").where(matches("event_type", "vi.*|click|error"))
    assert "Or(StringStartsWith(event_type,vi),In(event_type" in either._jdf.queryExecution().executedPlan().toString()
    assert "props" not in text


def test_equals_empty_matches_missing(spark):
    assert column(spark, ["a", "", None], "string", lambda x: equals(x, "")) == [False, True, True]
    assert column(spark, ["a", "b"], "string", lambda x: equals(x, "a")) == [True, False]


def test_numbers(spark):
    got = column(spark, ["87298048", "1.5e3", "x", None], "string", to_number)
    assert got == [87298048.0, 1500.0, None, None]


def test_missing_label_rows_are_dropped(spark):
    df = spark.createDataFrame([("a",), (None,)], "pod string")
    assert drop_unlabelled(df, "pod").count() == 1


def test_instance_type_reads_both_label_names(spark):
    new, old = "label_node_kubernetes_io_instance_type", "label_beta_kubernetes_io_instance_type"
    got = column(spark, [{new: "a"}, {old: "b"}, {new: "a", old: "b"}, {}], "map<string,string>", instance_type)
    assert got == ["a", "b", "a", None]


def test_memory_quantity(spark):
    assert column(spark, [87298048.0, 999999.0, None], "double", memory_quantity) == ["87Mi", "0Mi", None]
    assert column(spark, [100_000_000.0], "double", lambda x: memory_quantity(x, 1.05)) == ["105Mi"]


def test_cpu_quantity_floor_is_strict(spark):
    assert column(spark, [0.0, 0.1, 0.1009, 0.101, 2.5, None], "double", cpu_quantity) == ["100m", "100m", "100m", "101m", "2500m", None]
    assert column(spark, [0.1, 0.2], "double", lambda x: cpu_quantity(x, headroom=1.05)) == ["100m", "210m"]


def test_hourly_reward(spark):
    df = spark.createDataFrame([(1000.0, 0.1)], "b double, c double")
    assert df.select(hourly_reward(F.col("b"), F.col("c"))).first()[0] == pytest.approx(1000 * 3.33e-9 * 3600 - 0.1)


@pytest.mark.parametrize(("url", "top", "want"), [
    ("https://h/org/repo/blob/main/charts/core/values.yaml", "charts", ("org/repo", "main", "charts/core", "values.yaml")),
    ("https://h/org/repo/blob/team/topic/charts/values.yaml", "charts", ("org/repo", "team/topic", "charts", "values.yaml")),
    ("https://h/charts/repo/blob/main/charts/a/b/c.yaml", "charts", ("charts/repo", "main", "charts/a/b", "c.yaml")),
    ("https://h/org/repo/tree/main/charts/values.yaml", "charts", None),
    ("https://h/org/repo/blob/main/values.yaml", "charts", None),
    ("", "charts", None),
    (None, "charts", None),
])
def test_config_urls(spark, url, top, want):
    df = spark.createDataFrame([(url, top)], "url string, d string").select(parse_config_url("url", "d").alias("p"))
    got = df.first()["p"]
    assert (tuple(got) if got else None) == want


def test_unknown_instance_type_is_an_error(spark):
    df = spark.createDataFrame([("m4.large",), ("z9.huge",)], "instance_type string")
    with pytest.raises(Exception, match="z9.huge"):
        with_price(df).collect()
    assert {r["instance_type"]: r["usd_per_hour"] for r in with_price(df, on_unknown="null").collect()} == {"m4.large": 0.10, "z9.huge": None}
    assert [r[0] for r in unknown_instance_types(df).collect()] == ["z9.huge"]


def nodes(spark):
    return spark.createDataFrame([("n1", "m4.xlarge"), ("n2", "t3.medium"), ("n3", "m4.large")], "node string, instance_type string")


def test_every_used_node_is_charged_once(spark):
    used = spark.createDataFrame([(1, "n1"), (1, "n1"), (1, "n2"), (2, "n2"), (2, "gone")], "t int, node string")
    got = {r["t"]: r["cost"] for r in infra_cost(used, nodes(spark)).collect()}
    assert got == {1: pytest.approx(0.2416), 2: pytest.approx(0.0416)}


def test_observation_vector(spark):
    rows = [(1, "n1", "tx", "eth0", 5.0), (1, "n1", "tx", "eth0", 2.0), (1, "n2", "rx", "ogstun", 3.0), (1, "gone", "rx", "eth0", 1.0)]
    df = spark.createDataFrame(rows, "t int, node string, direction string, iface string, rate double")
    got = observation_vector(df, nodes(spark)).first()
    assert (got["rx_eth0"], got["rx_ogstun"], got["tx_eth0"], got["tx_ogstun"]) == (1.0, 3.0, 7.0, None)
    assert got["cost"] == pytest.approx(0.2416)


def test_observation_vector_rejects_a_known_node_of_unknown_type(spark):
    df = spark.createDataFrame([(1, "n", "tx", "eth0", 5.0)], "t int, node string, direction string, iface string, rate double")
    odd = spark.createDataFrame([("n", "z9.huge")], "node string, instance_type string")
    with pytest.raises(Exception, match="z9.huge"):
        observation_vector(df, odd).collect()


def test_align_keeps_pods_with_one_kind_of_metric(spark):
    cpu = spark.createDataFrame([(T, "a", 2.0, 1.0), (T, "a", 1.0, 0.5)], "t timestamp, pod string, max_cpu double, avg_cpu double")
    mem = spark.createDataFrame([(T, "b", 7.0, 6.0)], "t timestamp, pod string, max_mem double, avg_mem double")
    got = {r["pod"]: tuple(r)[2:] for r in align_pod_metrics(cpu, mem).collect()}
    assert got == {"a": (3.0, 1.5, None, None), "b": (None, None, 7.0, 6.0)}


def test_right_size_and_actions(spark):
    use = spark.createDataFrame([(T, "amf", 0.5, 0.25, 2e8, 1e8)], "t timestamp, pod string, max_cpu double, avg_cpu double, max_mem double, avg_mem double")
    got = right_size(use).first()
    assert (got["request_memory"], got["request_cpu"], got["limit_memory"], got["limit_cpu"]) == ("100Mi", "250m", "210Mi", "525m")
    assert right_size(use, "max").first()["request_cpu"] == "500m"
    action = as_actions(right_size(use), "amf").first()
    assert action["target_pod"] == "amf"
    assert action["limits"].asDict() == {"memory": "210Mi", "cpu": "525m"}


def test_node_dim_takes_the_newest_labels(spark):
    rows = [("n1", T, "old", "upf-large"), ("n1", T + dt.timedelta(hours=1), "new", "upf-large"), ("n2", T, "x", "system"), ("n3", T, "y", "my-upf")]
    info = spark.createDataFrame(rows, "node string, ts timestamp, kind string, grp string").select(
        "node", "ts", F.create_map(F.lit("label_node_kubernetes_io_instance_type"), "kind", F.lit("label_eks_amazonaws_com_nodegroup"), "grp").alias("labels")
    )
    assert [tuple(r) for r in dimensions.node_dim(info).collect()] == [("n1", "new", "upf-large")]


def test_sizes_and_actions(spark):
    assert column(spark, ["Small", "Large", "Huge"], "string", dimensions.size_cost) == [0.0416, 0.10, None]
    assert column(spark, ["Large"], "string", lambda x: dimensions.size_cost(x, "window")) == [0.20]
    assert column(spark, [0, 1, 2], "int", lambda x: dimensions.decode_action(x, "q_learning")) == ["Small", "Large", None]
    assert column(spark, [0, 1, 2, 3], "int", lambda x: dimensions.decode_action(x, "window")) == [None, "Large", "Small", None]


def test_trials(spark):
    sizes = spark.createDataFrame([("s", 1, 10, "Small"), ("s", 2, 20, "Large"), ("s", 3, 30, "Large"), ("s", 4, 40, None)], "study_id string, trial_id bigint, t int, size string")
    through = spark.createDataFrame([("s", 10, 1e4), ("s", 20, 1e4), ("s", 30, 1e4), ("s", 40, 1e4)], "study_id string, t int, throughput double")
    ledger = trial_ledger(sizes, through)
    assert {r["trial_id"]: r["cost"] for r in ledger.collect()} == {1: 0.0416, 2: 0.10, 3: 0.10, 4: None}
    arms = {r["size"]: r for r in best_arm(ledger).collect()}
    assert set(arms) == {"Small", "Large"}
    assert (arms["Large"]["trials"], arms["Large"]["best_trial"]) == (2, 2)


def test_query_sets(spark):
    assert QuerySet().run(spark, "") is None
    assert QuerySet().run_as_one(spark, "") is None
    one = QuerySet({"a": lambda s, d: s.range(2), "b": lambda s, d: s.range(3)})
    assert list(one.run(spark, "")) == ["a", "b"]
    assert {r["query_name"]: r["count"] for r in one.run_as_one(spark, "").groupBy("query_name").count().collect()} == {"a": 2, "b": 3}
    assert list(QuerySet.from_builder(lambda: {"z": lambda s, d: s.range(1)}).queries) == ["z"]


def test_any_text_only_outside_groups(spark):
    df = spark.createDataFrame([("abc",), ("xz",), ("x|.*",), (None,)], "pod string")
    found = lambda pattern: {r["pod"] for r in df.where(matches("pod", pattern)).collect()}
    assert found("(x|.*|y)z") == {"xz"}
    assert found(r"x\|.*") == {"x|.*"}
    assert found("a|.*") == {"abc", "xz", "x|.*", None}


def test_gaps_hide_no_sample(spark):
    rows = [("a", 10, 5.0), ("a", 50, None), ("a", 55, float("nan")), ("b", 20, float("nan"))]
    samples = spark.createDataFrame(rows, "pod string, s long, v double").selectExpr("pod", "timestamp_seconds(s) as ts", "v")
    assert [(r["pod"], r["v"]) for r in lookup_on_grid(samples, ["pod"], "1 minute", "1 minute").collect()] == [("a", 5.0)]


def test_times_of_unknown_nodes_cost_nothing(spark):
    used = spark.createDataFrame([(1, "n1"), (1, "n9"), (2, "n9")], "t int, node string")
    known = spark.createDataFrame([("n1", "m4.2xlarge")], "node string, instance_type string")
    assert {r["t"]: r["cost"] for r in infra_cost(used, known).collect()} == {1: 0.40, 2: 0.0}


def test_labels_hold_from_one_change_to_the_next(spark):
    rows = [("n1", 10, "old", "upf-a"), ("n1", 20, "old", "upf-a"), ("n1", 4000, "new", "upf-a"), ("n1", 4010, "old", "upf-a"),
            ("n1", 9000, "old", "upf-a"), ("n1", 9000, "tie", "upf-a"), ("n1", 20000, "new", "other"), ("n2", 5, None, None), (None, 1, "x", "upf-x")]
    info = spark.createDataFrame(rows, "node string, s long, i string, g string").select(
        "node", F.timestamp_seconds("s").alias("ts"), F.create_map(
            F.lit("label_node_kubernetes_io_instance_type"), "i", F.lit("label_eks_amazonaws_com_nodegroup"), "g").alias("labels"))
    seconds = [F.unix_seconds(c).alias(c) for c in ("valid_from", "valid_to")]
    got = {tuple(r) for r in dimensions.node_history(info, "").select("node", "instance_type", *seconds).collect()}
    assert got == {("n1", "old", 10, 4000), ("n1", "new", 4000, 4010), ("n1", "old", 4010, 9000), ("n1", "tie", 9000, 20000),
                   ("n1", "new", 20000, None), ("n2", None, 5, None)}
    kept = {tuple(r) for r in dimensions.node_history(info).select("instance_type", *seconds).collect()}
    assert kept == {("old", 10, 4000), ("new", 4000, 4010), ("old", 4010, 9000), ("tie", 9000, 20000)}
    assert dimensions.node_history(info.limit(0)).count() == 0


def test_cost_takes_the_type_of_its_time(spark):
    history = spark.sql("""select 'n1' node, 'm4.2xlarge' instance_type, timestamp'2024-01-01' valid_from, timestamp'2024-01-03' valid_to
        union all select 'n1', 't2.micro', timestamp'2024-01-03', null""")
    used = spark.sql("select 'n1' node, explode(array(timestamp'2023-12-31', timestamp'2024-01-02', timestamp'2024-01-03')) t")
    got = {r["d"]: r["cost"] for r in infra_cost(used, history).select(F.dayofmonth("t").alias("d"), "cost").collect()}
    assert got == {31: 0.0, 2: 0.40, 3: 0.0116}
