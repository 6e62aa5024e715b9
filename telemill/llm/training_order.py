"""Token sequences in training order: a keyed permutation gives every sequence its place in fixed-stride shards."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from telemill.llm.words import mixed, text_batches

#: How the vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 512  # tokens of a sequence
END = 50256  # ends a document, and fills up its last sequence
SHARD = 1024  # sequences of a shard
TOGETHER = 16  # shards that one task writes
ROUNDS = 6
BITS = 16  # first bits of a row's hash by which rows are numbered
SECTION = 1 << 20  # characters tokenised at once; cut where white space begins, which no token spans


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The place of every index below ``size``, in a permutation of 0 to size - 1 that ``key`` chooses.

    A Feistel network permutes the least domain of an even number of bits that holds ``size``; what falls beyond
    ``size`` walks on along its cycle until it comes back below, which takes fewer than four steps on average.
    """
    half = max(1, -(-max(size - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mixed(np.array([key & (1 << 64) - 1], dtype=np.uint64)))
    out = index.astype(np.uint64)
    beyond = np.ones(len(out), dtype=bool)
    while beyond.any():
        left, right = out[beyond] >> np.uint64(half), out[beyond] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[beyond] = (left << np.uint64(half)) | right
        beyond[beyond] = out[beyond] >= size
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens_of(text: str | None, path: str) -> np.ndarray:
    """Token ids of a whole text, and ``END``."""
    bpe, ids, at, text = vocabulary(path), [], 0, text or ""
    while at < len(text):
        to = at + SECTION
        while to < len(text) and not (text[to].isspace() and not text[to - 1].isspace()):
            to += 1
        ids.append(np.array(bpe.encode_ordinary(text[at:to]), dtype=np.uint16))
        at = to
    return np.concatenate([*ids, np.array([END], dtype=np.uint16)])


def sequences(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Per sequence: index (gapless from 0), size (how many there are), doc_id, part (from 0), n_tokens, record (``length`` little-endian 16-bit ids).

    A document's tokens and ``END`` are cut into sequences of ``length``, the last one filled up with ``END``; null
    and empty texts give one sequence. The index follows a hash of doc_id and text, then doc_id, part and record, so it depends on the rows alone,
    not on how they are read: rows are dealt by the hash's first bits, numbered among those, and
    the numbers before are added, one per value of these bits. Rows alike in all that are alike in every way.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                hashes, ids, parts, counts, records = [], [], [], [], []
                columns = (part.column(c).to_pylist() for c in ("hash", "doc_id", "text"))
                for value, doc_id, text in zip(*columns, strict=True):
                    tokens = tokens_of(text, path)
                    rows = -(-len(tokens) // length)
                    filled = np.full(rows * length, END, dtype="<u2")
                    filled[: len(tokens)] = tokens
                    raw = filled.tobytes()
                    hashes += [value] * rows
                    ids += [doc_id] * rows
                    parts += range(rows)
                    counts += [min(length, len(tokens) - k * length) for k in range(rows)]
                    records += [raw[2 * length * k : 2 * length * (k + 1)] for k in range(rows)]
                kinds = (hashes, pa.int64()), (ids, pa.int64()), (parts, pa.int32()), (counts, pa.int32()), (records, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in kinds], ["hash", "doc_id", "part", "n_tokens", "record"])

    cut = docs.select(F.xxhash64("doc_id", "text").alias("hash"), "doc_id", "text").mapInArrow(
        run, "hash long not null, doc_id long, part int, n_tokens int not null, record binary"
    ).withColumn("bucket", F.shiftrightunsigned("hash", 64 - BITS))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("hash", "doc_id", "part", "record"))
    numbered = cut.withColumn("place", place)
    # the counts look at all columns that the numbers need, so that one shuffle serves both and texts are tokenised once
    counts = numbered.groupBy("bucket").agg(F.max("place").alias("rows"), F.max("n_tokens").alias("most"))
    along = Window.orderBy("bucket")  # 2^BITS rows at most
    starts = counts.where("most > 0").select(
        "bucket", (F.sum("rows").over(along) - F.col("rows")).alias("start"), F.sum("rows").over(Window.partitionBy()).alias("size")
    )
    return numbered.join(F.broadcast(starts), "bucket").select(
        (F.col("start") + F.col("place") - 1).alias("index"), "size", "doc_id", "part", "n_tokens", "record"
    )


def placed(rows: DataFrame, key: int, shard: int = SHARD) -> DataFrame:
    """``rows`` of ``sequences`` with slot (their place among all) and shard."""
    @pandas_udf("long")
    def slot(index: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), int(size.iloc[0]), key) if len(index) else index)

    return rows.withColumn("slot", slot("index", "size")).withColumn("shard", F.floor(F.col("slot") / shard).cast("long")).drop("index", "size")


def shards(docs: DataFrame, path: str, key: int = 20240607, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """A row per shard, in training order: shard, first_slot, stride (bytes), doc_ids, parts, n_tokens, payload.

    Sequence s of the order lies in shard s // ``shard`` at byte (s % ``shard``) * ``stride`` of its payload. All
    shards but the last hold equally many sequences. Ranges of shards go to a task together; the same rows,
    key and lengths give the same shards, however the rows are split when read.
    """
    ranges = F.expr(f"shard div {TOGETHER}")
    ordered = placed(sequences(docs, path, length), key, shard).repartition(ranges).sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            number = batch.column("shard").to_numpy()
            for end in [*(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]:
                if end > at:
                    if held and held[0].column("shard")[0].as_py() != number[at]:
                        yield _shard(held, 2 * length)
                        held = []
                    held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield _shard(held, 2 * length)

    return ordered.mapInArrow(run, "shard long, first_slot long, stride int, doc_ids array<long>, parts array<int>, n_tokens array<int>, payload binary")


def _shard(held: list[pa.RecordBatch], stride: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    lists = [pa.array([rows.column(c).to_pylist()], kind) for c, kind in (("doc_id", pa.list_(pa.int64())), ("part", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int32())))]
    payload = b"".join(rows.column("record").to_pylist())
    first = rows.column("slot")[0].as_py()
    return pa.RecordBatch.from_arrays(
        [pa.array([rows.column("shard")[0].as_py()], pa.int64()), pa.array([first], pa.int64()), pa.array([stride], pa.int32()), *lists, pa.array([payload], pa.binary())],
        ["shard", "first_slot", "stride", "doc_ids", "parts", "n_tokens", "payload"],
    )


def write(found: DataFrame, path: str) -> None:
    """Adds the shards that ``path`` does not hold yet, so that a write that broke off can be taken up again.

    ``found`` must come from the same rows, key and lengths as before; how they are split when read does not matter.
    """
    try:
        done = found.sparkSession.read.parquet(path).select("shard")
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        found.write.mode("append").parquet(path)
        return
    found.join(done.distinct(), "shard", "left_anti").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, slot: int = 0, shard: int = SHARD) -> DataFrame:
    """Sequences from ``slot`` on, in order: slot, doc_id, part, n_tokens, record. Earlier shards are not read."""
    rows = spark.read.parquet(path).where(F.col("shard") >= slot // shard)
    one = rows.select("first_slot", "stride", "payload", F.posexplode(F.arrays_zip("doc_ids", "parts", "n_tokens")).alias("k", "about"))
    record = F.substring(F.col("payload"), F.col("k") * F.col("stride") + 1, F.col("stride"))
    return one.select(
        (F.col("first_slot") + F.col("k")).alias("slot"), F.col("about.doc_ids").alias("doc_id"), F.col("about.parts").alias("part"), "about.n_tokens", record.alias("record")
    ).where(F.col("slot") >= slot).orderBy("slot")
