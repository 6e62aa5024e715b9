"""Registered queries of the subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import (
    bpe, conversations, cotraining, decontaminate, licenses, merkle, pieces, pivot_search, sharding, toxicity, training_order, url_rules,
)
from telemill.llm.ngram_join import Join
from telemill.llm.tables import load

Query = Callable[[SparkSession, str], DataFrame]

#: The rules that pages are judged by.
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
SHARDS = 8


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; the folder is the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with the words that agree."""
    return decontaminate.overlaps(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("uid")


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose row counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    rows = load(spark, sf_dir, "documents").select("doc_id", size, F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dealt = sharding.uniform_shards(rows, [F.col("doc_id"), F.col("text_crc32")], SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, and the probability of each view."""
    return cotraining.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    return toxicity.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def ordered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences in training order, one row per shard of fixed stride."""
    return training_order.shards(load(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every text and of the text decoded from them."""
    return bpe.digests(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by integer inner product for every hundredth vector."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", pivot_search.whole_numbers(F.col("embedding")).alias("vector"))
    return pivot_search.nearest(rows, F.col("vec_id") % 100 == 0, 10)


def judged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page, with blocks carried along redirects and canonical links."""
    pages = load(spark, sf_dir, "pages")
    return url_rules.judged(pages.select("page_id", "url"), URL_RULES, url_rules.links(pages)).drop("url")


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and component of every document."""
    return Join(words=3, percent=90).clusters(load(spark, sf_dir, "documents"))


def similar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the number of documents that each one is similar to."""
    return Join(words=3, percent=90).linked(load(spark, sf_dir, "documents"))


def licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.scanned(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded from a text that was tampered with in a fifth of the rows."""
    docs = load(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = merkle.leaf_digest(values)
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest([*values[:-1], lowered])).otherwise(leaf)
    proofs = merkle.manifest(docs, leaf, carried=[F.col("doc_id"), claimed.alias("claimed")])
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.col("claimed"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by a hash of their rows' ids, and what it takes to repair them."""
    given = load(spark, sf_dir, "conversations")
    blank = F.lit(" ")
    rows = given.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    id_of = F.concat(*[F.coalesce(F.col(c).cast("string"), blank) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    fate = F.crc32(id_of) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))
    return conversations.digests(rows, given)


def pieced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text with the end id, and the text decoded from them."""
    return pieces.digests(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_spaced_seed_decontamination": decontamination,
    "op2_hypergeometric_sharding": sharded,
    "op3_cotraining_quality": quality,
    "op4_weak_supervision_toxicity": toxic,
    "op5_training_order": ordered_shards,
    "op6_rank_array_bpe": encoded,
    "op7_pivot_distance_search": nearest,
    "op8_redirect_equivalence": judged_urls,
    "op9_ngram_jaccard_join": similar,
    "op9_ngram_jaccard_links": similar_links,
    "op10_license_scan": licensed,
    "op11_merkle_manifest": manifest,
    "op12_conversation_repair": repaired,
    "op13_sentencepiece_bpe": pieced,
}
