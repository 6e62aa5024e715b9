"""Telemetry views over the test tables.

The test tables hold events, not metrics, so each event is read as one sample: pods, nodes and
interfaces come from its user, day and type, counters are running totals of its value. Running
totals are cut by hour (see ``operators.chunked``), so no series is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.timegrid import epoch_us, floor_to, micros
from telemill.operators.asof import asof_join
from telemill.operators.chunked import number_rows, running_total

SERIES = ["kind", "pod", "node", "iface"]

# Widths used on the test tables: the shapes of real telemetry in wider units, because the events
# are minutes apart.
RATE_D, OUTER_D, TRAFFIC_D, STEP, LOOKBACK = "6 hours", "3 days", "12 hours", "1 hour", "6 hours"
WINDOW, PERIOD, SAMPLE_STEP, SAMPLES, WINDOW_MINUTES = "15 hours", "5 hours", "15 minutes", 60, 900
UPF, OGSTUN = "open5gs-upf.*", "ogstun.*"

# fixed values: labels of the four nodes
NODES = [
    ("node-0", "m4.xlarge", "upf-large"),
    ("node-1", "t3.medium", "upf-small"),
    ("node-2", "m4.large", "upf-large"),
    ("node-3", "t2.micro", "control-plane"),
]
FORMER_TYPE = "m4.2xlarge"

# The event types behind each kind of counter, as conditions that the parquet scan can use.
KINDS = {
    "tx": "event_type in ('click', 'view')",
    "rx": "event_type in ('purchase', 'signup')",
    "cpu": "(event_type is null or event_type not in ('click', 'view', 'purchase', 'signup'))",
}


# Read with known schemas: no job has to open files just to find them out.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
PAGES = "page_id bigint, url string, html string"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string"
CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def _hour():
    """Chunk of a running total: the rows of one hour.

    Never NULL, so that both uses of the shuffled rows in a running total stay the same plan and are
    shuffled once.
    """
    return F.coalesce(floor_to(epoch_us("ts"), micros("1 hour")), F.lit(0))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with pod, node, kind and interface labels."""
    return events(spark, sf_dir).selectExpr(
        "event_id",
        "ts",
        "event_type",
        "cast(round(value * 1000) as bigint) as inc",
        """case user_id % 5 when 0 then 'open5gs-upf-0' when 1 then 'open5gs-upf-1' when 2 then 'open5gs-amf-2'
           when 3 then 'open5gs-smf-3' else 'x-open5gs-upf-4' end as pod""",
        "concat('node-', (user_id % 5 + floor((dayofmonth(ts) - 1) / 10.0)) % 4) as node",
        """case event_type when 'click' then 'tx' when 'view' then 'tx' when 'purchase' then 'rx' when 'signup' then 'rx'
           else 'cpu' end as kind""",
        """case event_type when 'click' then 'eth0' when 'purchase' then 'eth0' when 'view' then 'ogstun'
           when 'signup' then 'ogstun' else 'c0' end as iface""",
    )


def counters(spark: SparkSession, sf_dir: str, *kinds: str, where=None) -> DataFrame:
    """Counters that reset at every 500th event ``(event_id, kind, pod, node, iface, ts, v)``.

    Series are picked by kind and by a condition on the labels before the totals are made.
    """
    rows = base(spark, sf_dir)
    if kinds:
        rows = rows.where(" or ".join(KINDS[kind] for kind in kinds))
    if where is not None:
        rows = rows.where(where)
    dated = rows.select("event_id", *SERIES, "ts", "inc", _hour().alias("_hour"))
    total = running_total(dated, SERIES, "_hour", ["ts", "event_id"], F.col("inc"), "v", F.pmod("event_id", F.lit(500)) == 0)
    return total.select("event_id", *SERIES, "ts", "v")


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory-like gauge per pod and container."""
    return base(spark, sf_dir).select(
        "event_id", "pod", F.col("event_type").alias("container"), "ts", (F.col("inc") * 1000).alias("v")
    )


def node_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Info samples ``(node, ts, labels)``, one per event; nodes had another type in the first days.

    The instance type sits under its former label name in the first half of the month.
    """
    seen = base(spark, sf_dir).select("node", "ts")
    kind = F.lit(None).cast("string")
    group = F.lit(None).cast("string")
    for node, instance, nodegroup in NODES:
        kind = F.when(F.col("node") == node, instance).otherwise(kind)
        group = F.when(F.col("node") == node, nodegroup).otherwise(group)
    kind = F.when(F.dayofmonth("ts") <= 5, F.lit(FORMER_TYPE)).otherwise(kind)
    name = F.when(F.dayofmonth("ts") <= 15, "label_beta_kubernetes_io_instance_type").otherwise(
        "label_node_kubernetes_io_instance_type"
    )
    return seen.select("node", "ts", F.create_map(name, kind, F.lit("label_eks_amazonaws_com_nodegroup"), group).alias("labels"))


def pod_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly presence of pods on nodes; pods move on days 11 and 21."""
    return base(spark, sf_dir).select("pod", "node", F.date_trunc("hour", "ts").alias("ts")).distinct()


def steps(spark: SparkSession, sf_dir: str, with_ts: bool = False) -> DataFrame:
    """Agent steps, one episode per user ``(episode, step, seq, action, throughput[, ts])``."""
    rows = events(spark, sf_dir).select(
        F.col("user_id").alias("episode"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("click", "error"), 0).otherwise(1).alias("action"),
        F.round(F.col("value") * 1000).cast("bigint").alias("throughput"),
        _hour().alias("_hour"),
    )
    numbered = number_rows(rows, ["episode"], "_hour", ["ts", "seq"], "step")
    return numbered.select("episode", "step", "seq", "action", "throughput", *(["ts"] if with_ts else []))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of configuration files, one per page."""
    page = F.col("page_id")
    url = F.concat(
        F.lit("https://github.com/org"), (page % 7).cast("string"), F.lit("/repo/blob/feature/"), page.cast("string"),
        F.lit("/charts/core/values.yaml"),
    )
    return spark.read.schema(PAGES).parquet(f"{sf_dir}/pages.parquet").select("page_id", url.alias("url"), F.lit("charts").alias("dir_name"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own addresses, which are no configuration files."""
    return spark.read.schema(PAGES).parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.lit("charts").alias("dir_name"))


def _sized(megabytes, milli):
    return F.struct(F.concat(megabytes.cast("string"), F.lit("Mi")).alias("memory"), F.concat(milli.cast("string"), F.lit("m")).alias("cpu"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(CUSTOMER).parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration document per customer ``(cfg_id, sha, doc)``.

    Every seventh document has no node selector terms.
    """
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    expression = F.struct(
        F.lit("nodegroup").alias("key"), F.lit("In").alias("operator"),
        F.array(F.when(nation % 2 == 0, "Large").otherwise("Small")).alias("values"),
    )
    second = F.struct(F.lit("zone").alias("key"), F.lit("In").alias("operator"), F.array(nation.cast("string")).alias("values"))
    term = F.struct(F.array(expression, second).alias("matchExpressions"))
    terms = F.when(key % 7 != 0, F.array(term, term)).otherwise(F.array().cast(
        "array<struct<matchExpressions:array<struct<key:string,operator:string,values:array<string>>>>>"
    ))
    selector = F.struct(F.struct(F.struct(terms.alias("nodeSelectorTerms")).alias(
        "requiredDuringSchedulingIgnoredDuringExecution")).alias("nodeAffinity"))
    resources = F.struct(
        _sized(nation + 100, nation * 10 + 100).alias("requests"), _sized(nation + 200, nation * 20 + 100).alias("limits")
    )
    doc = F.struct(F.struct(resources.alias("resources")).alias("amf"), F.struct(selector.alias("affinity")).alias("upf"))
    return (
        customers(spark, sf_dir).select(key.alias("cfg_id"), doc.alias("doc")).withColumn("sha", F.sha2(F.to_json("doc"), 256))
    )


def limit_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested sizes per config, from the customer's balance in cents."""
    cents = F.round(F.abs("c_acctbal") * 100).cast("bigint")
    return customers(spark, sf_dir).select(
        F.col("c_custkey").alias("cfg_id"), F.lit("amf").alias("target_pod"),
        _sized(cents % 1000, cents % 700).alias("requests"), _sized(cents % 1000 + 50, cents % 700 + 35).alias("limits"),
    )


def nodegroup_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested node size per config, from the customer's segment."""
    large = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    return customers(spark, sf_dir).select(
        F.col("c_custkey").alias("cfg_id"), F.lit("upf").alias("target_pod"),
        F.when(large, "Large").otherwise("Small").alias("values"),
    )


def order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of the customers' configs built on each other, one per order ``(cfg_id, seq, base_sha, body)``.

    Every fifth author had not seen the update before, so that two updates have the same base.
    """
    orders = spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status")))
    own = orders.select(F.col("o_custkey").alias("cfg_id"), F.col("o_orderkey").alias("seq"), body.alias("body"))
    seen = own.where("seq % 5 <> 0").select("cfg_id", "seq", F.sha2("body", 256).alias("_sha"))
    based = asof_join(own, seen, ["cfg_id"], "seq", ["_sha"], width=100_000, direction="backward", exact=False)
    start = configs(spark, sf_dir).select("cfg_id", "sha")
    return based.join(start, "cfg_id").select("cfg_id", "seq", F.coalesce("_sha", "sha").alias("base_sha"), "body")


def responses(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """JSON answers ``(body_id, body)`` made from the gauges, at most 100 samples each.

    ``kind="vector"`` gives every sample its own result, ``kind="matrix"`` one ``values`` list.
    """
    # written as fixed-point text, because a double's text may use an exponent
    epoch = (F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)") / F.lit(10**6).cast("decimal(20,0)")).cast("decimal(20,6)")
    pair = F.concat(F.lit("["), epoch.cast("string"), F.lit(',"'), F.col("v").cast("string"), F.lit('"]'))
    metric = F.concat(F.lit('{"metric":{"pod":"'), F.col("pod"), F.lit('","container":"'), F.col("container"), F.lit('"},'))
    name = "value" if kind == "vector" else "values"
    shown = pair if kind == "vector" else F.concat(F.lit("["), pair, F.lit("]"))
    one = F.concat(metric, F.lit(f'"{name}":'), shown, F.lit("}"))
    rows = gauges(spark, sf_dir).select(F.floor(F.col("event_id") / 100).cast("bigint").alias("body_id"), one.alias("_one"))
    head, tail = f'{{"status":"success","data":{{"resultType":"{kind}","result":[', "]}}"
    return rows.groupBy("body_id").agg(
        F.concat(F.lit(head), F.array_join(F.collect_list("_one"), ","), F.lit(tail)).alias("body")
    )


def mixed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all kinds ``(body_id, body)``: vectors, matrices, and some of either replaced by an error or cut off."""
    vector = responses(spark, sf_dir, "vector").withColumn("kind", F.lit(0))
    both = vector.unionByName(responses(spark, sf_dir, "matrix").withColumn("kind", F.lit(1)))
    error = F.lit('{"status":"error","errorType":"timeout","error":"query timed out"}')
    cut = F.substring("body", F.lit(1), F.length("body") - 2)
    body = F.when(F.col("body_id") % 7 == 3, error).when(F.col("body_id") % 11 == 5, cut).otherwise(F.col("body"))
    return both.select((F.col("body_id") * 2 + F.col("kind")).alias("body_id"), body.alias("body"))
