"""Benchmark decontamination by spaced seeds, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.tables import only, small, stored, without

#: Word positions that each mask looks at (the ones between are free to differ), and the sizes of the items it is laid on.
#: Whatever words of an item differ, as far as ``AGREE`` allows, one of its masks sees none of them.
ENDLESS = 1 << 30
MASKS = (
    ((0, 1, 3, 4, 6), 9, ENDLESS), ((0, 2, 3, 5, 8), 9, ENDLESS), ((0, 3, 4, 7, 8), 9, ENDLESS), ((0, 1, 2, 3), 4, 17),
    ((0, 1, 3, 4), 5, 7), ((0, 2, 3, 4), 5, 5), ((0, 1, 2, 4), 5, 5), ((0, 1, 2), 3, 3), ((0, 1), 2, 2), ((0,), 1, 1),
)
#: Words of an item that are held against a document at once, and the percentage of them that must agree.
WINDOW, AGREE = 20, 80
#: ``clean`` takes items of fewer words for ordinary phrases.
EVIDENCE = 5
#: Seeds sent to all executors at most (some 100 MB as a hash table); beyond it windows are shuffled to them.
BROADCAST_SEEDS = 2_000_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, masks: Sequence[int] = range(len(MASKS))) -> DataFrame:
    """A row per mask and position at which it fits into the words ``h``: key, mask, at; ``h`` itself goes."""
    keep = [c for c in rows.columns if c != "h"]
    spans = {k: 1 + max(MASKS[k][0]) for k in masks}
    last = F.size("h") - min(spans.values())
    every = rows.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0), (last + 1) * len(masks) - 1)).alias("i"))
    mask, at = F.array(*map(F.lit, masks))[(F.col("i") % len(masks)).cast("int")], F.floor(F.col("i") / len(masks)).cast("int")
    every = every.select("*", mask.alias("mask"), at.alias("at"))
    span = F.array(*map(F.lit, spans.values()))[(F.col("i") % len(masks)).cast("int")]
    every = every.where(F.col("at") + span <= F.size("h"))
    keys = {k: F.xxhash64(F.lit(k), *[F.get("h", F.col("at") + p) for p in MASKS[k][0]]) for k in masks}
    key = keys[masks[-1]]
    for k in masks[:-1]:
        key = F.when(F.col("mask") == k, keys[k]).otherwise(key)
    return every.select(*keep, key.alias("key"), "mask", "at")


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """Items that documents hold: doc_id, item_id, agreeing, window, start (word of the document), and the row's ``uid``.

    A mask's hash at some words of an item that equals the same mask's hash in a document fixes how the two lie
    against each other. So laid, a stretch of ``WINDOW`` words of the item (all of a shorter one) must agree with
    the document in at least ``AGREE`` percent of its places; places beyond the document's ends do not agree. One
    row per document and item: the most agreeing words, then the smallest start.

    Items of fewer than ``least`` words, or none, are left out. Of one to four words all must agree, and such items
    may be met by chance. Documents are cut under those masks alone that some item needs. Null texts have no words,
    and null ids are values like others. Rows alike in doc_id and text are one, as are items. Other columns are not
    looked at.
    """
    docs, uid = _with_uid(docs)
    items = benchmark.select("item_id", _hashes(F.col("text")).alias("h")).where(F.size("h") >= max(least, 1)).distinct()
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    low, high = (F.array(*[F.lit(m[k]) for m in MASKS])[F.col("mask")] for k in (1, 2))
    seeds = _seeds(items.select("item", F.size("h").alias("size"), "h")).where(F.col("size").between(low, high))
    seeds = stored(seeds.select("key", "item", F.col("at").alias("item_at"), "mask"), "seeds")
    needed = sorted(r["mask"] for r in seeds.select("mask").distinct().collect()) or [0]
    windows = _seeds(docs.select(uid, _hashes(F.col("text")).alias("h")), needed)
    hits = windows.join(small(seeds.drop("mask"), BROADCAST_SEEDS), "key").select("uid", "item", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = stored(hits.distinct(), "hits")

    held = stored(only(docs, hits, "uid").select("uid", "doc_id", _hashes(F.col("text")).alias("doc_h")).distinct(), "held")
    laid = hits.join(held, "uid").join(items, "item")
    same = F.transform("h", lambda w, i: F.coalesce((F.try_element_at("doc_h", _place(F.col("shift") + i)) == w).cast("int"), F.lit(0)))
    width = F.least(F.size("h"), F.lit(WINDOW))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("h") - width),
        lambda s: F.struct(F.aggregate(F.slice("same", s + 1, width), F.lit(0), lambda a, b: a + b).alias("agreeing"), (-s).alias("order")),
    )
    best = laid.withColumn("same", same).withColumn("best", F.array_max(sums)).withColumn("window", width)
    best = best.where(F.col("best.agreeing") * 100 >= F.col("window") * AGREE)
    start = F.col("shift") - F.col("best.order")
    found = best.groupBy("uid", "doc_id", "item_id").agg(F.max(F.struct("best.agreeing", "window", (-start).alias("order"))).alias("m"))
    return found.select("uid", "doc_id", "item_id", "m.agreeing", "m.window", (-F.col("m.order")).cast("int").alias("start"))


def _place(at: Column) -> Column:
    # element_at counts from 1, and from the end for negative places
    return F.when(at >= 0, at + 1).otherwise(F.lit(1 << 30)).cast("int")


def _with_uid(docs: DataFrame) -> tuple[DataFrame, str]:
    named = docs.select("doc_id", "text")
    return named.withColumn("uid", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")), "uid"


def clean(docs: DataFrame, benchmark: DataFrame, least: int = EVIDENCE) -> DataFrame:
    """``docs`` without the documents that hold an item of at least ``least`` words. Columns may have any names."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("uid"), own.alias("own"))
    return without(rows, overlaps(docs, benchmark, least).select("uid"), "uid").select("own.*")
