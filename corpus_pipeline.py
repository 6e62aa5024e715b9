"""The corpus pipeline: filters, deduplicates, decontaminates and tokenises ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import bpe, cotraining, decontaminate, toxicity
from telemill.llm.catalog import tokenizer
from telemill.llm.ngram_join import Join
from telemill.llm.tables import load, small, stored, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Rows of one doc_id stay or go together; null ids stay."""
    judged = cotraining.scored(docs, load(spark, sf_dir, "labels"))
    return without(docs, judged.where(~F.col("keep")), "doc_id")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not judged toxic. Rows of one doc_id stay or go together; null ids stay."""
    judged = toxicity.scored(docs, load(spark, sf_dir, "labels"))
    return without(docs, judged.where("predicted = 1"), "doc_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null last) of every group of similar ones.

    Rows are told apart by a 64-bit hash of doc_id and text, so rows of one id with different texts are documents of their own,
    and rows alike in both are one, of which any stays. Null ids are values like others.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    found = stored(Join(words=5, percent=80).clusters(docs.select(key.alias("doc_id"), "text")), "clusters")
    linked = found.where("doc_id <> component_id").select(F.explode(F.array("doc_id", "component_id")).alias("key"), "component_id").distinct()
    linked = small(linked)
    named = docs.select(key.alias("key"), "doc_id").join(linked, "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("first"))
    others = linked.join(first, "component_id").where("key <> first")
    rows = without(docs.select(key.alias("key"), F.struct(*docs.columns).alias("own")), others, "key")
    twice = small(found.groupBy(F.col("doc_id").alias("key")).count().where("count > 1").select("key"))
    once = rows.join(twice, "key", "left_semi").dropDuplicates(["key"])
    return rows.join(twice, "key", "left_anti").unionByName(once).select("own.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its id and source, its token ids, and digests of them and of the decoded text."""
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokenised),
]

#: Classifiers that are fitted here cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each one's rows written before the next reads them."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k + 1}")
    return docs
