"""Patches of nested configuration documents and their compare-and-set write-back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators.asof import asof_join
from telemill.session import written

SEQS = 10_000  # sequence numbers of a config and version that are looked at together, and updates of a version that one task links

# fixed value: where a pod's document keeps its node selection
SELECTOR = "affinity.nodeAffinity.requiredDuringSchedulingIgnoredDuringExecution.nodeSelectorTerms"


def _requested(configs: DataFrame, actions: DataFrame, pod: str, columns: list[str]) -> DataFrame:
    wanted = actions.where(F.col("target_pod") == pod).select("cfg_id", *columns)
    return configs.select("cfg_id", F.col("sha").alias("base_sha"), "doc").join(wanted, "cfg_id")


def patch_limits(configs: DataFrame, actions: DataFrame, pod: str) -> DataFrame:
    """Replace ``<pod>.resources`` by the requested ``{requests, limits}``.

    ``configs`` is ``(cfg_id, sha, doc)``, ``actions`` ``(cfg_id, target_pod, requests, limits)``;
    the result is ``(cfg_id, base_sha, doc)`` with a NULL document where the pod has none.
    """
    rows = _requested(configs, actions, pod, ["requests", "limits"])
    resources = F.struct(F.col("requests").alias("requests"), F.col("limits").alias("limits"))
    patched = F.col("doc").withField(f"{pod}.resources", resources)
    return rows.select("cfg_id", "base_sha", F.when(F.col(f"doc.{pod}").isNotNull(), patched).alias("doc"))


def _change_first(items: Column, change: Callable[[Column], Column]) -> Column:
    return F.transform(items, lambda item, i: F.when(i == 0, change(item)).otherwise(item))


def patch_nodegroup(configs: DataFrame, actions: DataFrame, pod: str) -> DataFrame:
    """Set the values of the pod's first node selector expression to the one requested size.

    ``actions`` is ``(cfg_id, target_pod, values STRING)``. The document is NULL where the pod has
    no selector expression to change.
    """
    rows = _requested(configs, actions, pod, [F.col("values").alias("_size")])
    terms = F.col(f"doc.{pod}.{SELECTOR}")
    sized = _change_first(
        terms,
        lambda term: term.withField(
            "matchExpressions",
            _change_first(term["matchExpressions"], lambda e: e.withField("values", F.array(F.col("_size")))),
        ),
    )
    reachable = F.coalesce(F.size(F.get(terms, F.lit(0))["matchExpressions"]) > 0, F.lit(False))
    patched = F.col("doc").withField(f"{pod}.{SELECTOR}", sized)
    return rows.select("cfg_id", "base_sha", F.when(reachable, patched).alias("doc"))


def as_updates(patched: DataFrame, seq: Column | None = None) -> DataFrame:
    """Patched documents as updates ``(cfg_id, seq, base_sha, body)``; unpatchable rows are left out."""
    seq = F.lit(0).cast("bigint") if seq is None else seq
    return patched.where(F.col("doc").isNotNull()).select("cfg_id", seq.alias("seq"), "base_sha", F.to_json("doc").alias("body"))


def unpatchable(patched: DataFrame) -> DataFrame:
    return patched.where(F.col("doc").isNull()).select("cfg_id", "base_sha")


def judge_updates(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Add ``accepted`` to updates: made from the current version, and the first of those.

    ``current`` is ``(cfg_id, sha)`` with one row per config, ``updates`` ``(cfg_id, seq, base_sha,
    body)`` with ``seq`` unique per config. After the first update of a version the others are stale.
    Winners are found on minima combined before the shuffle, and updates meet them by (config, seq),
    so many updates of one config stay spread out.
    """
    first = updates.groupBy("cfg_id", "base_sha").agg(F.min("seq").alias("seq"))
    fresh = current.select("cfg_id", F.col("sha").alias("base_sha"))
    winners = first.join(fresh, ["cfg_id", "base_sha"]).select("cfg_id", "seq", F.lit(True).alias("_won"))
    return updates.join(winners, ["cfg_id", "seq"], "left").withColumn("accepted", F.coalesce("_won", F.lit(False))).drop("_won")


def judge_chains(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Add ``accepted`` to updates that may follow each other: what a compare-and-set of each in ``seq`` order accepts.

    An accepted update makes ``sha2(body)`` the current version; the next accepted one is the first behind it that was made from that
    version. So every update has one follower at most, and those accepted are the chain from the current version on. Its
    links are found in one shuffle and doubled round by round: after k rounds 2^k links are known, so a
    chain of a million updates takes twenty rounds and no task walks it. Updates of one branch, those made from a version that comes up only later, and
    rings of updates that no current version leads to are rejected. ``current`` and ``updates`` are as for :func:`judge_updates`.
    """
    made = F.sha2("body", 256).alias("_made")
    updates = written(updates.select("*", made), "updates")
    followed = written(_followed(current, updates), "links")
    links = followed.where("seq is not null")
    reached = followed.where("seq is null").select("cfg_id", F.col("to").alias("seq"))
    parts = [reached]
    while True:
        # what is known so far is the chain's beginning; the links lead as far again
        further = written(reached.join(links, ["cfg_id", "seq"]).select("cfg_id", F.col("to").alias("seq")), "reached")
        if further.isEmpty():
            break
        parts.append(further)
        reached = reduce(DataFrame.unionByName, parts)
        onward = links.select("cfg_id", F.col("seq").alias("to"), F.col("to").alias("far"))
        links = written(links.join(onward, ["cfg_id", "to"]).select("cfg_id", "seq", F.col("far").alias("to")), "links")
    won = reached.withColumn("_won", F.lit(True))
    return updates.drop("_made").join(won, ["cfg_id", "seq"], "left").withColumn("accepted", F.coalesce("_won", F.lit(False))).drop("_won")


def _followed(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Links ``(cfg_id, seq, to)``: the first update behind ``seq`` that was made from its version; ``seq`` is NULL for the current version.

    Those that make a version and those made from it meet by (config, version) in one shuffle of narrow rows. Versions that
    more than ``SEQS`` of them share are linked by an as-of join, which spreads them.
    """
    makers = updates.where("seq is not null").select("cfg_id", F.col("_made").alias("sha"), "seq", F.lit(False).alias("uses"))
    users = updates.where("seq is not null").select("cfg_id", F.col("base_sha").alias("sha"), "seq", F.lit(True).alias("uses"))
    start = current.where("cfg_id is not null and sha is not null").select("cfg_id", "sha", F.lit(None).cast(updates.schema["seq"].dataType).alias("seq"), F.lit(False).alias("uses"))
    ends = makers.unionByName(users).unionByName(start)
    crowd = F.xxhash64("cfg_id", "sha").alias("crowd")
    crowded = written(ends.groupBy(crowd).count().where(F.col("count") > SEQS).select("crowd"), "crowded")
    few = crowded.isEmpty()
    plain = ends if few else ends.withColumn("crowd", crowd).join(crowded, "crowd", "left_anti")
    # from the last to the first; of one number the maker comes before the user, whom it does not serve
    back = Window.partitionBy("cfg_id", "sha").orderBy(F.desc_nulls_last("seq"), "uses").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = plain.withColumn("to", F.min(F.when(F.col("uses"), F.col("seq"))).over(back)).where("not uses and to is not null").select("cfg_id", "seq", "to")
    if few:
        return found
    ends = ends.withColumn("crowd", crowd).join(crowded, "crowd", "left_semi")
    makers, users, start = ends.where("not uses and seq is not null"), ends.where("uses"), ends.where("seq is null")
    behind = asof_join(makers, users.withColumn("to", F.col("seq")), ["cfg_id", "sha"], "seq", ["to"], width=SEQS, direction="forward", exact=False)
    first = users.groupBy("cfg_id", "sha").agg(F.min("seq").alias("to"))
    begun = start.join(first, ["cfg_id", "sha"])
    return found.unionByName(behind.where("to is not null").select("cfg_id", "seq", "to")).unionByName(begun.select("cfg_id", "seq", "to"))


def apply_updates(current: DataFrame, updates: DataFrame, chains: bool = False) -> tuple[DataFrame, DataFrame]:
    """Compare-and-set: (accepted updates with their new ``sha``, rejected updates).

    With ``chains`` updates may be built on each other, and the last accepted one of a config is its new version.
    """
    judged = (judge_chains if chains else judge_updates)(current, updates)
    accepted = judged.where("accepted").drop("accepted").withColumn("sha", F.sha2("body", 256))
    return accepted, judged.where("not accepted").drop("accepted")


def next_versions(current: DataFrame, accepted: DataFrame) -> DataFrame:
    """The config table after the accepted updates ``(cfg_id, seq, sha, body)``, of which the last of each config counts."""
    last = accepted.groupBy("cfg_id").agg(F.max_by(F.struct("sha", "body"), "seq").alias("_new"))
    return current.join(last, "cfg_id", "left").select(
        "cfg_id", F.coalesce("_new.sha", "sha").alias("sha"), F.coalesce("_new.body", "body").alias("body")
    )


def write_actions(actions: DataFrame, path: str, mode: str = "append") -> None:
    """Write requested actions, one folder per target pod."""
    actions.write.mode(mode).partitionBy("target_pod").parquet(path)
