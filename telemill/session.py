"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "telemill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on; cluster settings are left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
            # one machine has few shuffle partitions already; merging them further would idle its cores
            .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
            # call sites of column expressions are only of use when debugging
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: Folders of local sessions that run without ``spark.checkpoint.dir``, by application.
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``, the folder every executor can reach.

    Only a local session may go without that setting; it then gets a temporary folder, the same one as long
    as the application runs. Executors of a cluster could not see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="telemill-")
        root = _LOCAL[application]
    return f"{root.rstrip('/')}/telemill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: lineage ends there, and lost executors lose nothing."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
