"""Registered batch queries: each operator over the whole test tables.

Times leave as epoch seconds, and doubles that were summed are rounded, so that results can be
compared value by value with another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.catalog import adapters as ad
from telemill.catalog.adapters import (
    LOOKBACK, OGSTUN, OUTER_D, PERIOD, RATE_D, SAMPLE_STEP, SAMPLES, SERIES, STEP, TRAFFIC_D, UPF, WINDOW, WINDOW_MINUTES,
)
from telemill.functions.labels import all_match, drop_unlabelled, equals, matches, to_number
from telemill.functions.quantities import LIMIT_HEADROOM, cpu_quantity, memory_quantity
from telemill.functions.rewards import hourly_reward
from telemill.functions.timegrid import epoch_us
from telemill.functions.urls import parse_config_url
from telemill.operators import config, grid, lookup, quality, rangefn, replay, rollup, sizing, trials
from telemill.plans import observation, right_sizing, transitions
from telemill.plans import trials as trial_plan
from telemill.session import scratch_dir, written
from telemill.sources import answers, dimensions, replay_table, responses
from telemill.sources.queryset import QuerySet, RangeQuery
from telemill.sources.samples import read_samples, write_samples

QUERIES: dict = {}


def query(fn):
    """Register a query under its function's name; a trailing underscore only avoids an import."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Timestamps as epoch seconds, doubles rounded, whole numbers as BIGINT."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("timestamp"):
            c = F.unix_seconds(c.cast("timestamp"))
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        cols.append(c.alias(name))
    return df.select(*cols)


def us(name: str = "ts"):
    return epoch_us(name).alias("us")


# --- shared inputs -----------------------------------------------------------------------------


def cpu(spark, d):
    return ad.counters(spark, d, "cpu")


def traffic(spark, d):
    """Receive and transmit counters of the user-plane pods."""
    return ad.counters(spark, d, "rx", "tx", where=matches("pod", UPF)).withColumnRenamed("kind", "direction")


TRAFFIC_KEY = ["direction", "pod", "node", "iface"]


def traffic_rates(spark, d):
    return transitions.interface_rates(traffic(spark, d), TRAFFIC_KEY, TRAFFIC_D, STEP)


def upf_nodes(spark, d):
    return dimensions.node_dim(ad.node_info(spark, d))


def all_nodes(spark, d):
    return dimensions.node_dim(ad.node_info(spark, d), "")


def upf_history(spark, d):
    return dimensions.node_history(ad.node_info(spark, d))


def all_history(spark, d):
    return dimensions.node_history(ad.node_info(spark, d), "")


def usage(spark, d):
    return right_sizing.pod_usage(cpu(spark, d), ad.gauges(spark, d), SERIES, ["pod", "container"], RATE_D, OUTER_D, STEP)


def user_plane(spark, d):
    return ad.counters(spark, d, "tx", where=all_match(pod=UPF, iface=OGSTUN))


def totals(spark, d):
    return observation.throughput_series(user_plane(spark, d), SERIES, STEP, LOOKBACK)


def windows(spark, d):
    return lookup.observation_windows(totals(spark, d), WINDOW, PERIOD).withColumn("throughput", F.col("throughput").cast("double"))


def resampled(spark, d):
    return grid.resample(grid.baseline(windows(spark, d), value="throughput"), SAMPLE_STEP, value="throughput")


def presence(spark, d):
    pods = ad.pod_info(spark, d).where(matches("pod", UPF))
    return observation.windowed_presence(pods, all_history(spark, d), WINDOW, PERIOD, STEP, LOOKBACK)


def observed(spark, d):
    return observation.observations(totals(spark, d), presence(spark, d), WINDOW, PERIOD, SAMPLE_STEP, SAMPLES)


def vectors(spark, d):
    return transitions.hourly_observations(traffic(spark, d), TRAFFIC_KEY, upf_history(spark, d), TRAFFIC_D, STEP)


VECTOR = ["rx_eth0", "rx_ogstun", "tx_eth0", "tx_ogstun", "cost"]


def day_steps(spark, d):
    """One episode per day; the action asks for the large size when more was sent than received."""
    sent, received = F.coalesce("tx_ogstun", F.lit(0.0)), F.coalesce("rx_ogstun", F.lit(0.0))
    return transitions.episode_steps(vectors(spark, d), "1 day", STEP, F.when(sent > received, 1).otherwise(0))


def user_steps(spark, d):
    """Steps of the users' episodes with rewards."""
    cost = dimensions.size_cost(dimensions.decode_action(F.col("action"), "q_learning"))
    rows = ad.steps(spark, d).withColumn("reward", hourly_reward(F.col("throughput"), cost))
    return replay.timesteps(rows)


def ledger(spark, d):
    return trial_plan.ledger(
        ad.counters(spark, d, "tx", where=matches("pod", UPF)), SERIES,
        ad.pod_info(spark, d).where(matches("pod", UPF)), all_history(spark, d), TRAFFIC_D, STEP,
    )


# --- sources and sinks -------------------------------------------------------------------------


def _flat(df):
    return df.select(
        F.col("labels")["pod"].alias("pod"), F.col("labels")["container"].alias("container"), us(), F.col("v").cast("bigint").alias("v")
    )


@query
def instant_vector_parse(spark, d):
    return _flat(responses.parse_instant(ad.responses(spark, d, "vector")))


@query
def range_vector_parse(spark, d):
    return _flat(responses.parse_range(ad.responses(spark, d, "matrix")))


@query
def mixed_answers(spark, d):
    parsed = answers.good(answers.parse_answers(ad.mixed_responses(spark, d)))
    return parsed.select("kind", F.col("labels")["pod"].alias("pod"), F.col("labels")["container"].alias("container"), us(), F.col("v").cast("bigint").alias("v"))


@query
def rejected_answers(spark, d):
    return answers.rejected(answers.parse_answers(ad.mixed_responses(spark, d))).select("reason", "rejects")


@query
def sample_scan(spark, d):
    path = scratch_dir(spark, "samples")
    write_samples(ad.counters(spark, d).withColumnRenamed("kind", "metric"), path)
    return read_samples(spark, path, "tx", "2024-01-10", "2024-01-19").select("event_id", "pod", "node", "iface", us(), "v")


def cpu_mem_queries():
    """Highest and average CPU and memory per pod, as a query set."""

    by = ("t", "pod")

    def cpu_by_pod(agg):
        return RangeQuery(cpu, tuple(SERIES), agg, OUTER_D, STEP, RATE_D, by)

    def mem_by_pod(agg):
        return RangeQuery(ad.gauges, ("pod", "container"), agg, OUTER_D, STEP, None, by)

    return {"max_cpu": cpu_by_pod("max"), "avg_cpu": cpu_by_pod("avg"), "max_memory": mem_by_pod("max"), "avg_memory": mem_by_pod("avg")}


@query
def query_set(spark, d):
    return shown(QuerySet.from_builder(cpu_mem_queries).run_as_one(spark, d), 3)


@query
def node_dim(spark, d):
    return upf_nodes(spark, d)


@query
def price_dim(spark, d):
    seen = ad.node_info(spark, d).select(dimensions.instance_type("labels").alias("instance_type"))
    counted = seen.groupBy("instance_type").agg(F.count("*").alias("samples"))
    return counted.join(F.broadcast(dimensions.price_dim(spark)), "instance_type")


@query
def config_url_parse(spark, d):
    parsed = ad.urls(spark, d).withColumn("p", parse_config_url("url", "dir_name")).where(F.col("p").isNotNull())
    return parsed.select("page_id", "p.repo", "p.branch", "p.dir", "p.file")


@query
def config_url_rejects(spark, d):
    rows = ad.urls(spark, d).unionByName(ad.page_urls(spark, d))
    return rows.where(parse_config_url("url", "dir_name").isNull()).select("page_id", "url")


def _bodies(patched):
    return config.as_updates(patched).select("cfg_id", "base_sha", "body")


@query
def patch_limits(spark, d):
    return _bodies(config.patch_limits(ad.configs(spark, d), ad.limit_actions(spark, d), "amf"))


@query
def patch_nodegroup(spark, d):
    return _bodies(config.patch_nodegroup(ad.configs(spark, d), ad.nodegroup_actions(spark, d), "upf"))


@query
def unpatchable_configs(spark, d):
    return config.unpatchable(config.patch_nodegroup(ad.configs(spark, d), ad.nodegroup_actions(spark, d), "upf"))


def _updates(spark, d):
    """Two updates per config; the first is made from an old version in every tenth."""
    limits = config.patch_limits(ad.configs(spark, d), ad.limit_actions(spark, d), "amf")
    groups = config.patch_nodegroup(ad.configs(spark, d), ad.nodegroup_actions(spark, d), "upf")
    first = config.as_updates(limits, F.col("cfg_id") * 2).withColumn(
        "base_sha", F.when(F.col("cfg_id") % 10 == 0, F.sha2("base_sha", 256)).otherwise(F.col("base_sha"))
    )
    return first.unionByName(config.as_updates(groups, F.col("cfg_id") * 2 + 1))


@query
def config_cas_apply(spark, d):
    judged = config.judge_updates(ad.configs(spark, d).select("cfg_id", "sha"), _updates(spark, d))
    status = F.when(F.col("accepted"), "accepted").otherwise("rejected")
    return judged.select("cfg_id", "seq", status.alias("status"), F.when(F.col("accepted"), F.sha2("body", 256)).alias("sha"))


@query
def config_next_versions(spark, d):
    current = ad.configs(spark, d).select("cfg_id", "sha", F.to_json("doc").alias("body"))
    accepted, _ = config.apply_updates(current, _updates(spark, d))
    return config.next_versions(current, accepted)


@query
def config_chain_apply(spark, d):
    """Updates that follow each other: each accepted one is the base of the next."""
    judged = config.judge_chains(ad.configs(spark, d).select("cfg_id", "sha"), ad.order_updates(spark, d))
    return judged.select("cfg_id", "seq", "base_sha", "accepted")


@query
def config_chain_versions(spark, d):
    current = ad.configs(spark, d).select("cfg_id", "sha", F.to_json("doc").alias("body"))
    accepted, _ = config.apply_updates(current, ad.order_updates(spark, d), chains=True)
    return config.next_versions(current, accepted)


@query
def requested_actions_sink(spark, d):
    path = scratch_dir(spark, "actions")
    sized = sizing.right_size(usage(spark, d)).where(F.col("pod").contains("amf"))
    config.write_actions(sizing.as_actions(sized, "amf"), path)
    rows = spark.read.parquet(path)
    return shown(rows.select(
        "t", "pod", "target_pod", F.col("requests.memory").alias("request_memory"), F.col("requests.cpu").alias("request_cpu"),
        F.col("limits.memory").alias("limit_memory"), F.col("limits.cpu").alias("limit_cpu"),
    ))


# --- projections and filters -------------------------------------------------------------------


@query
def label_regex_filter(spark, d):
    return ad.base(spark, d).where(matches("pod", UPF) & matches("iface", "e.h[0-9]+|c0")).select("event_id", "pod", "iface")


@query
def label_eq_filter(spark, d):
    return ad.base(spark, d).where(equals("node", "node-1")).select("event_id", "node", "pod")


@query
def multi_matcher_filter(spark, d):
    return ad.base(spark, d).where(all_match(pod=UPF, iface=OGSTUN)).select("event_id", "pod", "iface")


@query
def pod_contains_filter(spark, d):
    return ad.base(spark, d).where(F.col("pod").contains("amf")).select("event_id", "pod")


@query
def missing_label_drop(spark, d):
    """Errors carry no pod label."""
    labelled = F.when(F.col("event_type") != "error", F.create_map(F.lit("pod"), F.col("pod"))).otherwise(
        F.create_map(F.lit("container"), F.col("event_type"))
    )
    rows = ad.base(spark, d).select("event_id", labelled["pod"].alias("pod"), "inc")
    return drop_unlabelled(rows, "pod")


@query
def result_project(spark, d):
    parsed = responses.parse_instant(ad.responses(spark, d, "vector"))
    return drop_unlabelled(parsed.select(F.col("labels")["pod"].alias("pod"), F.col("v").alias("v")), "pod")


@query
def vector_slice(spark, d):
    return shown(vectors(spark, d).select("t", F.array(*VECTOR[:-1])[0].alias("first_part"), F.array(*VECTOR[:-1])[3].alias("last_part"), "cost"))


# --- range functions ---------------------------------------------------------------------------


@query
def counter_rate(spark, d):
    return shown(rangefn.rate(ad.counters(spark, d), SERIES, RATE_D, STEP))


@query
def counter_rate_plain(spark, d):
    return shown(rangefn.rate(ad.counters(spark, d), SERIES, RATE_D, STEP, extrapolate=False))


@query
def counter_increase(spark, d):
    return shown(rangefn.increase(ad.counters(spark, d), SERIES, RATE_D, STEP))


@query
def max_over_time(spark, d):
    return shown(rangefn.over_time(ad.gauges(spark, d), ["pod", "container"], OUTER_D, STEP, ["max"], suffix="_value"))


@query
def avg_over_time(spark, d):
    return shown(rangefn.over_time(ad.gauges(spark, d), ["pod", "container"], OUTER_D, STEP, ["avg"], suffix="_value"), 3)


@query
def max_rate_subquery(spark, d):
    return shown(rangefn.rate_over_time(cpu(spark, d), SERIES, RATE_D, OUTER_D, STEP, ["max"], suffix="_rate"))


@query
def avg_rate_subquery(spark, d):
    return shown(rangefn.rate_over_time(cpu(spark, d), SERIES, RATE_D, OUTER_D, STEP, ["avg"], suffix="_rate"))


@query
def instant_lookup(spark, d):
    return shown(lookup.lookup_on_grid(ad.counters(spark, d), SERIES, STEP, LOOKBACK))


@query
def event_lookup(spark, d):
    """The memory gauge of a pod as each of its purchases found it."""
    rows = ad.base(spark, d).where("event_type = 'purchase'").select("event_id", "pod", "ts")
    memory = ad.gauges(spark, d).where("container <> 'purchase'").select("pod", "ts", "v")
    return shown(lookup.lookup_at(rows, memory, ["pod"], "1 hour").select("event_id", "pod", "v"))


@query
def window_slice(spark, d):
    return shown(windows(spark, d).select("obs_t", "t", F.col("throughput").cast("bigint").alias("throughput")))


@query
def range_literal(spark, d):
    """The same query with two window widths."""
    parts = []
    for hours in (10, 15):
        rows = lookup.observation_windows(totals(spark, d), f"{hours} hours", PERIOD)
        parts.append(rows.groupBy("obs_t").agg(
            F.count("*").alias("points"), F.max_by("throughput", "t").alias("newest")).withColumn("hours", F.lit(hours)))
    return shown(parts[0].unionByName(parts[1]))


# --- joins -------------------------------------------------------------------------------------


@query
def pod_metric_align(spark, d):
    return shown(usage(spark, d), 3)


@query
def used_node_semi(spark, d):
    return rollup.only_used(upf_nodes(spark, d), traffic(spark, d))


@query
def node_instance_lookup(spark, d):
    placed = ad.pod_info(spark, d).groupBy("pod", "node").agg(F.count("*").alias("hours"))
    return rollup.with_instance(placed, all_nodes(spark, d))


@query
def event_instance(spark, d):
    """Each event with its node's type as of its own time, the rows of a node spread over time."""
    rows = ad.base(spark, d).select("event_id", "node", "ts")
    return rollup.labelled(rows, all_history(spark, d), ["instance_type"], "ts", "left", spread="1 day").select("event_id", "node", "instance_type")


@query
def price_lookup(spark, d):
    placed = ad.pod_info(spark, d).groupBy("pod", "node").agg(F.count("*").alias("hours"))
    return rollup.with_price(rollup.with_instance(placed, all_nodes(spark, d)))


@query
def unknown_instance_types(spark, d):
    seen = ad.node_info(spark, d).select(dimensions.instance_type("labels").alias("instance_type"))
    known = {k: v for k, v in dimensions.PRICES.items() if k not in ("m4.2xlarge", "t2.micro")}
    return rollup.unknown_instance_types(seen, known)


TYPES = {"large_on": dimensions.SIZES["window"]["Large"], "small_on": dimensions.SIZES["window"]["Small"]}


@query
def grid_flag_update(spark, d):
    rows = resampled(spark, d).select("obs_t", "t", *[F.lit(0.0).alias(f) for f in TYPES])
    marks = grid.presence_marks(presence(spark, d), TYPES)
    return shown(grid.update_flags(rows, marks, list(TYPES)))


@query
def rx_tx_align(spark, d):
    rows = ad.counters(spark, d, "tx", "rx").select("event_id", "kind", "iface", "v")
    tx, rx = rows.where(F.col("kind") == "tx").drop("kind"), rows.where(F.col("kind") == "rx").drop("kind")
    return rollup.by_direction(tx, rx)


# --- aggregations ------------------------------------------------------------------------------


@query
def sum_by_pod(spark, d):
    rates = rangefn.rate(ad.counters(spark, d, "tx", where=matches("pod", UPF)), SERIES, TRAFFIC_D, STEP)
    return shown(rollup.sum_by(rates, ["t", "pod"], "rate"))


@query
def sum_all_by_time(spark, d):
    return shown(totals(spark, d))


@query
def sum_all_by_time_increase(spark, d):
    """Growth instead of raw totals: a restarted counter does not lower it."""
    return shown(observation.throughput_series(user_plane(spark, d), SERIES, STEP, LOOKBACK, mode="increase"))


@query
def sum_by_interface(spark, d):
    return shown(rollup.sum_by(traffic_rates(spark, d), ["t", "direction", "iface"], "rate"))


@query
def observation_pivot(spark, d):
    return shown(rollup.pivot_interfaces(traffic_rates(spark, d), ["t"]))


@query
def distinct_nodes(spark, d):
    return shown(rollup.used_nodes(traffic_rates(spark, d), "t"))


@query
def node_history(spark, d):
    """Label changes of every node, in microseconds since the epoch."""
    rows = all_history(spark, d)
    return rows.select("node", "instance_type", "nodegroup", *[F.unix_micros(c).alias(c) for c in ("valid_from", "valid_to")])


@query
def last_label_per_node(spark, d):
    return all_nodes(spark, d)


@query
def infra_cost(spark, d):
    return shown(rollup.infra_cost(traffic_rates(spark, d), upf_history(spark, d)))


@query
def total_throughput(spark, d):
    return shown(vectors(spark, d).select("t", "throughput"))


@query
def on_fraction(spark, d):
    return shown(observed(spark, d).groupBy("obs_t").agg(
        grid.on_fraction("large_on", SAMPLES).alias("on_large"), grid.on_fraction("small_on", SAMPLES).alias("on_small")))


@query
def bin_mean(spark, d):
    return shown(grid.bin_mean(ad.gauges(spark, d).withColumn("v", F.col("v").cast("double")), STEP, ["pod", "container"], "ts"), 3)


# --- observation windows -----------------------------------------------------------------------


@query
def baseline_normalise(spark, d):
    return shown(grid.baseline(windows(spark, d), value="throughput").select("obs_t", "t", "throughput"))


@query
def resample_grid(spark, d):
    return shown(resampled(spark, d), 3)


@query
def linear_interpolate(spark, d):
    return shown(grid.interpolate(resampled(spark, d), value="throughput"), 3)


@query
def pad_front(spark, d):
    rows = grid.interpolate(resampled(spark, d), value="throughput")
    return shown(grid.pad_front(rows, SAMPLES, SAMPLE_STEP).select("obs_t", "slot", "t", "throughput"), 3)


@query
def instance_on_flags(spark, d):
    return shown(grid.on_flags(resampled(spark, d).select("obs_t", "t"), presence(spark, d), TYPES))


@query
def fill_zero(spark, d):
    return shown(observed(spark, d), 3)


@query
def last_value(spark, d):
    return shown(observed(spark, d).groupBy("obs_t").agg(grid.last_value("throughput").alias("throughput")), 3)


@query
def transition_pairs(spark, d):
    pairs = replay.transition_pairs(ad.steps(spark, d), ["seq", "throughput", "action"])
    return shown(pairs.select("episode", "step", "seq", "action", "throughput", "next_seq", "next_throughput", "next_action"))


@query
def first_step_flag(spark, d):
    return shown(replay.timesteps(ad.steps(spark, d)).select("episode", "step", "step_type"))


# --- order and limits --------------------------------------------------------------------------


@query
def time_sort(spark, d):
    return shown(windows(spark, d).select("obs_t", "t", "throughput").orderBy("obs_t", "t"))


@query
def first_row(spark, d):
    rates = rangefn.rate(ad.counters(spark, d, "tx", where=matches("pod", UPF)), SERIES, TRAFFIC_D, STEP)
    return shown(grid.first_row(rollup.sum_by(rates, ["t", "pod"], "rate"), ["t"], "pod", ["pod", "rate"]))


@query
def fifo_latest_n(spark, d):
    return shown(replay.retain_latest(ad.steps(spark, d), 3, "step", by=["episode"]))


# --- scalar functions --------------------------------------------------------------------------


@query
def epoch_to_ts(spark, d):
    parsed = responses.parse_range(ad.responses(spark, d, "matrix"))
    return parsed.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.col("labels")["pod"].alias("pod"))


@query
def string_to_float(spark, d):
    return ad.events(spark, d).select(
        "event_id", to_number(F.get_json_object("props", "$.k")).alias("k"), to_number("event_type").alias("no_number")
    )


@query
def memory_quantity_(spark, d):
    v = F.col("v")
    return ad.gauges(spark, d).select("event_id", memory_quantity(v).alias("request_size"), memory_quantity(v, LIMIT_HEADROOM).alias("limit_size"))


@query
def cpu_quantity_(spark, d):
    cores = F.col("inc") / F.lit(100000.0)
    return ad.base(spark, d).select(
        "event_id", cpu_quantity(cores).alias("request_size"), cpu_quantity(cores, headroom=LIMIT_HEADROOM).alias("limit_size")
    )


@query
def right_size(spark, d):
    return shown(sizing.right_size(usage(spark, d)))


@query
def right_size_by_max(spark, d):
    """CPU requests from the highest instead of the average use."""
    return shown(sizing.right_size(usage(spark, d), request_cpu="max"))


@query
def hourly_reward_(spark, d):
    return shown(vectors(spark, d).select("t", "throughput", "cost", "reward"))


@query
def window_reward(spark, d):
    return shown(observation.observation_rewards(observed(spark, d), WINDOW_MINUTES, SAMPLES))


@query
def size_cost(spark, d):
    sizes = trial_plan.placement_sizes(ad.pod_info(spark, d).where(matches("pod", UPF)), all_history(spark, d))
    size = F.col("size")
    return sizes.select(
        "study_id", "trial_id", "size", dimensions.size_cost(size, "bandit").alias("bandit_cost"),
        dimensions.size_cost(size, "window").alias("window_cost"),
    )


@query
def action_decode(spark, d):
    action = F.col("action")
    return ad.steps(spark, d).select(
        "seq", dimensions.decode_action(action, "q_learning").alias("q_size"), dimensions.decode_action(action, "window").alias("window_size")
    )


@query
def grid_size(spark, d):
    """Rows and row distance of every observation, which follow from window and sample rate."""
    rows, seconds = grid.grid_size(15, 4)
    e = epoch_us("t")
    per = observed(spark, d).groupBy("obs_t").agg(F.count("*").alias("n_rows"), (F.max(e) - F.min(e)).alias("_span"))
    return shown(per.select(
        "obs_t", "n_rows", F.lit(rows).alias("samples"), (F.col("_span") / ((F.col("n_rows") - 1) * 10**6)).cast("bigint").alias("step_s"),
        F.lit(seconds).alias("live_step_s"),
    ))


@query
def observation_bounds(spark, d):
    vector = quality.bounds_violations(vectors(spark, d), quality.VECTOR_BOUNDS, ["t"])
    window = quality.bounds_violations(observed(spark, d), quality.WINDOW_BOUNDS, ["t", "obs_t"])
    return shown(vector.unionByName(window, allowMissingColumns=True), 3)


# --- replay and trial tables -------------------------------------------------------------------


@query
def timestep_table(spark, d):
    steps = transitions.episode_steps(vectors(spark, d), "1 day", STEP)
    return shown(steps.select("episode", "step", "step_type", "discount", *VECTOR, "reward"))


@query
def trajectory_table(spark, d):
    return shown(replay.trajectories(day_steps(spark, d), VECTOR))


@query
def replay_sequences(spark, d):
    runs = replay.sequences(user_steps(spark, d).select("episode", "step", "seq", "action", "reward"), 2)
    one, two = F.col("items")[0], F.col("items")[1]
    return shown(runs.select(
        "episode", "step", one["seq"].alias("seq_1"), two["seq"].alias("seq_2"), one["action"].alias("action_1"),
        two["action"].alias("action_2"), two["reward"].alias("reward_2"),
    ))


@query
def replay_retain(spark, d):
    return shown(replay.retain_latest(ad.steps(spark, d), 128))


@query
def replay_kept(spark, d):
    """The newest steps of a table on storage that four batches were appended to."""
    path, steps = scratch_dir(spark, "replay"), written(ad.steps(spark, d), "steps")
    for batch in range(4):
        replay_table.append(steps.where(F.pmod(F.col("seq"), F.lit(4)) == batch), path, batch, 128, width=500)
    return shown(replay_table.kept(spark, path, 128))


@query
def replay_sample(spark, d):
    return shown(replay.sample_batches(ad.steps(spark, d), batch=10, seed=7))


@query
def replay_draw_counts(spark, d):
    """A sample by counts: as many rows as asked for are drawn, none that the table does not have, about 63 in 100 distinct."""
    steps = ad.steps(spark, d)
    n = steps.count()
    drawn = replay.draw_counts(steps, n, seed=7, rows=1_000)
    known = drawn.join(steps.select("seq"), "seq", "left_semi").agg(F.sum("draws").alias("drawn"), F.count("*").alias("distinct"))
    near = F.abs(F.col("distinct") / F.lit(n) - F.lit(1 - 2.718281828459045**-1)) < 0.05
    return known.select("drawn", near.alias("as_expected"))


@query
def trial_ledger(spark, d):
    return shown(ledger(spark, d))


@query
def best_arm(spark, d):
    # ties on the exact reward are broken by trial, so rewards are rounded before and not after
    return shown(trials.best_arm(ledger(spark, d).withColumn("reward", F.round("reward", 6))))


@query
def training_metrics(spark, d):
    return shown(replay.episode_rollup(user_steps(spark, d)))
