"""N-gram Jaccard join by prefix filters under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.graph import components
from telemill.llm.tables import only, stored
from telemill.llm.words import Words, mixed, shingles, text_batches, utf8

ORDERS = 3
SKETCH = 8  # longs of parity bits per document
FINEST = 256  # longs of the sketches of the largest sets
CHUNK = 1 << 20  # shingles counted at once for the frequency order
LOCAL = 4  # documents of a chunk that a shingle must be in to be reported as frequent
SHARE = 2000  # a shingle is frequent when more than one document in so many is known to hold it
BITS = [f"bits{k}" for k in range(SKETCH)]
PREFIXES = [f"prefix{k}" for k in range(1, ORDERS)]
GROUP = 1000  # rows of a token that one salt holds


class Join:
    """Parameters: words per shingle, and the least similarity as ``percent`` (of 100).

    A document's set holds its distinct shingles; with fewer words, the whole sequence as one; without words
    it is empty and linked with nothing. Null texts count as empty. Rows with a null ``doc_id`` get a set size
    but no component; rows with the same ``doc_id`` are one document. Other columns are not looked at.
    """

    def __init__(self, words: int = 5, percent: int = 80):
        if not 50 <= percent <= 100:
            raise ValueError("percent must lie between 50 and 100")
        self.words, self.percent = words, percent

    # -- sets ------------------------------------------------------------------------------------------

    def _sets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in batches:
            for part in text_batches(batch):
                found = Words(*utf8(part.column("text")))
                hashes, first = found.hashes()[0], found.first
                yield part, [np.unique(shingles(hashes[a:b], self.words)) for a, b in zip(first[:-1], first[1:], strict=True)]

    def order(self, docs: DataFrame) -> Broadcast:
        """(frequent shingles, their ranks): frequent ones come last in every order, all others count as rare.

        Each chunk of documents reports shingles that several of its documents hold; of these, the ones that
        reach one document in ``SHARE`` in all stay. Every document is counted; the table has at most
        ``SHARE`` times as many entries as the average document has shingles, and the order built from it is
        right for whatever it holds.
        """
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            docs = size = 0

            def report() -> pa.RecordBatch:
                tokens, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
                often = n >= LOCAL
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.append(tokens[often].view(np.int64), 0)), pa.array(np.append(n[often], docs)), pa.array(np.append(np.zeros(often.sum(), bool), True))],
                    ["token", "n", "total"],
                )

            for _, sets in self._sets(batches):
                for tokens in sets:
                    held.append(tokens)
                    docs, size = docs + 1, size + len(tokens)
                    if size >= CHUNK:
                        yield report()
                        held, docs, size = [], 0, 0
            yield report()

        counts = stored(
            docs.select("text").mapInArrow(count, "token long, n long, total boolean").groupBy("token", "total").agg(F.sum("n").alias("n")), "frequent"
        )
        total = counts.where("total").agg(F.sum("n")).first()[0] or 0
        often = counts.where(~F.col("total") & (F.col("n") * SHARE > total) & (F.col("n") >= 2 * LOCAL))
        table = {r["token"] & (1 << 64) - 1: r["n"].bit_length() for r in often.select("token", "n").toLocalIterator()}
        tokens = np.array(sorted(table), dtype=np.uint64)
        return docs.sparkSession.sparkContext.broadcast((tokens, np.array([table[t] for t in tokens.tolist()], dtype=np.uint64)))

    def signatures(self, docs: DataFrame, order: Broadcast) -> DataFrame:
        """Per row: doc_id, n (set size), high and low (a digest of the set), prefix tokens under the first order, sketch."""
        percent = self.percent

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, sets in self._sets(batches):
                digests, bits = [_digest(s) for s in sets], [_sketch(s, SKETCH) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                    + [pa.array([d[k] for d in digests], pa.int64()) for k in range(2)]
                    + [_lists([_prefix(s, 0, percent, *order.value).view(np.int64) for s in sets])]
                    + [pa.array([b[k] for b in bits], pa.int64()) for k in range(SKETCH)]
                    + [_lists([_fine(s) for s in sets])],
                    ["doc_id", "n", "high", "low", "prefix0", *BITS, "fine"],
                )

        kinds = "doc_id long, n long, high long, low long, prefix0 array<long>" + "".join(f", {b} long" for b in BITS) + ", fine array<long>"
        return docs.select("doc_id", "text").mapInArrow(describe, kinds)

    def sets(self, docs: DataFrame, order: Broadcast) -> DataFrame:
        """(doc_id, tokens, prefix1, ...): the whole sets and their prefixes under the other orders."""
        percent = self.percent

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, sets in self._sets(batches):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), _lists([s.view(np.int64) for s in sets])]
                    + [_lists([_prefix(s, k, percent, *order.value).view(np.int64) for s in sets]) for k in range(1, ORDERS)],
                    ["doc_id", "tokens", *PREFIXES],
                )

        return docs.select("doc_id", "text").mapInArrow(whole, "doc_id long, tokens array<long>" + "".join(f", {p} array<long>" for p in PREFIXES))

    # -- pairs -----------------------------------------------------------------------------------------

    def _sized(self, x: str, y: str) -> Column:
        """Whether set sizes and places in the prefix allow the similarity for two rows of one token.

        If the token is the first that both share, no more than what follows it in either set can be common.
        """
        n, m, t = F.col(f"{x}.n"), F.col(f"{y}.n"), self.percent
        most = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * t) & (most * (100 + t) >= (n + m) * t)

    def _sketched(self, n: Column, m: Column, differ: Column) -> Column:
        """Whether so many differing bits allow the similarity: a token of only one set flips one bit."""
        return differ * (100 + self.percent) <= (n + m) * (100 - self.percent)

    def _verified(self, pairs: DataFrame, docs: DataFrame, heads: DataFrame, order: Broadcast) -> DataFrame:
        """Pairs that share prefix tokens under all other orders too and whose whole sets are similar.

        Sketches go first, because they are short; the sets and the prefixes of what is left are read from the texts.
        """
        about = heads.select("doc_id", "n", *BITS, "fine")
        both = pairs.join(_named(about, "a"), "a").join(_named(about, "b"), "b")
        short = sum((F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in BITS), F.lit(0))
        k = F.least(F.size("a_fine"), F.size("b_fine"))
        flips = F.zip_with(_folded("a_fine", k), _folded("b_fine", k), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        for differ in (short, F.aggregate(flips, F.lit(0), lambda x, y: x + y)):
            both = both.where(self._sketched(F.col("a_n"), F.col("b_n"), differ))
        pairs = stored(both.select("a", "b"), "pairs")

        needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = stored(self.sets(only(docs.where("doc_id is not null"), needed, "doc_id"), order), "sets")
        both = pairs.join(_named(sets, "a"), "a").join(_named(sets, "b"), "b")
        for p in PREFIXES:
            both = both.where(F.arrays_overlap(f"a_{p}", f"b_{p}"))
        common = F.size(F.array_intersect("a_tokens", "b_tokens"))
        similar = common * 100 >= self.percent * (F.size("a_tokens") + F.size("b_tokens") - common)
        return stored(both.where(similar).select("a", "b").distinct(), "links")

    def links(self, docs: DataFrame, heads: DataFrame, order: Broadcast) -> DataFrame:
        """(a, b): links between class representatives that join all linked ones, though not every link in a cluster.

        This is for callers that need components alone; ``all_links`` has every link.

        Rows of the first order's prefix tokens meet by token. First each is compared with one pivot of its token,
        the one that shares most; what that links is one cluster and needs no more comparing. Then all rows of a
        token that lie in different clusters are compared, so no link between clusters is missed.
        """
        post = heads.select("doc_id", "n", F.posexplode("prefix0").alias("at", "token"))
        often = post.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
        known = stored(post.join(often, "token"), "postings")
        weight = known.groupBy("doc_id").agg(F.sum("held").alias("weight"))
        pivot = known.join(weight, "doc_id").groupBy("token").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("order"), "n", "at")).alias("p"))
        pivot = pivot.select("token", (-F.col("p.order")).alias("doc_id"), "p.n", "p.at")
        near = known.alias("x").join(pivot.alias("y"), F.expr("x.token = y.token and x.doc_id <> y.doc_id") & self._sized("x", "y"))
        first = self._verified(_ordered(near), docs, heads, order)

        rows = known.drop("held").join(components(first).withColumnRenamed("node", "doc_id"), "doc_id", "left")
        rows = stored(rows.withColumn("component", F.coalesce("component", "doc_id")), "rows")
        spread = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held"))
        rest = self._met(rows, spread.where("low < high"), heads, "component")
        return first.unionByName(self._verified(_ordered(rest), docs, heads, order))

    def all_links(self, docs: DataFrame, heads: DataFrame, order: Broadcast) -> DataFrame:
        """(a, b): every link between class representatives, a < b. All rows of a token are compared."""
        post = heads.select("doc_id", "n", F.posexplode("prefix0").alias("at", "token"))
        often = post.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
        return self._verified(_ordered(self._met(post, often, heads, "doc_id")), docs, heads, order)

    def _met(self, rows: DataFrame, tokens: DataFrame, heads: DataFrame, apart: str) -> DataFrame:
        """Pairs x, y of rows of one of ``tokens`` (token, held) that sizes, places and sketches allow, with x.apart < y.apart.

        A token's rows are dealt to parts; each part meets all of them.
        """
        parts = ((F.col("held") / GROUP).cast("int") + 1).alias("parts")
        open_rows = rows.join(tokens.select("token", parts), "token")
        open_rows = stored(open_rows.join(heads.select("doc_id", *BITS), "doc_id"), "open")
        left = open_rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        right = open_rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in BITS), F.lit(0))
        return left.alias("x").join(
            right.alias("y"),
            F.expr(f"x.token = y.token and x.part = y.part and x.{apart} < y.{apart}")
            & self._sized("x", "y") & self._sketched(F.col("x.n"), F.col("y.n"), differ),
        )

    # -- results ---------------------------------------------------------------------------------------

    def _classes(self, docs: DataFrame, order: Broadcast) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Signatures of all rows, those that have words and an id, the classes of equal sets, and one signature per class."""
        rows = stored(self.signatures(docs, order).withColumn("row", F.monotonically_increasing_id()), "signatures")
        full = rows.where("doc_id is not null and n > 0")
        classes = stored(full.groupBy("high", "low", "n").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("high", "low", "n", "m.*"), "classes")
        heads = stored(full.drop("high", "low").join(classes.select("row"), "row", "left_semi").drop("row"), "heads")
        return rows, full, classes, heads

    def _paired(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(doc_id, n) of every row; members (doc_id, class); all pairs (a, b) of similar classes."""
        # a class is named by one row's hash, because an id with several texts may come first in several classes
        uid = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), "text"))
        named = docs.select(uid.alias("doc_id"), F.col("doc_id").cast("long").alias("id"), "text")
        order = self.order(docs)
        rows, full, classes, heads = self._classes(named, order)
        ids = stored(named.where("id is not null").select(F.col("doc_id").alias("uid"), "id").distinct(), "ids")
        sizes = rows.select(F.col("doc_id").alias("uid"), "n").join(ids, "uid", "left").select(F.col("id").alias("doc_id"), "n")
        head = classes.select("high", "low", "n", F.col("doc_id").alias("class"))
        member = full.select(F.col("doc_id").alias("uid"), "high", "low", "n").join(head, ["high", "low", "n"]).join(ids, "uid")
        member = stored(member.select(F.col("id").alias("doc_id"), "class").distinct(), "members")
        return sizes, member, self.all_links(named, heads, order)

    def pairs(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links without loss: members (doc_id, class) and pairs (a, b) of classes, a < b.

        Documents are linked if they share a class (their sets are equal) or if their classes are a pair. Empty
        sets have no class, and an id with several texts is in a class for each set.
        """
        return self._paired(docs)[1:]

    def linked(self, docs: DataFrame) -> DataFrame:
        """Per row of ``docs``: doc_id, n_shingles, component_id as ``clusters`` has it, n_links (other documents similar to it)."""
        sizes, member, links = self._paired(docs)
        several = member.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("last")).where("a < last")
        several = stored(member.join(several.select("doc_id", "a"), "doc_id"), "several")
        single = stored(member.join(several.select("doc_id").distinct(), "doc_id", "left_anti"), "single")
        own = single.groupBy("class").agg(F.count("*").alias("held"))
        each = member.select(F.col("class").alias("a"), F.col("class").alias("b")).distinct()
        sight = each.unionByName(links).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def seen(sight: DataFrame, by: str) -> DataFrame:
            """Documents in the classes ``b`` of each ``by``, those of several classes counted once, without itself."""
            known = sight.join(own, sight["b"] == own["class"]).groupBy(by).agg(F.sum("held").alias("held"))
            more = sight.join(several.select(F.col("class").alias("b"), F.col("doc_id").alias("other")), "b")
            more = more.groupBy(by).agg(F.countDistinct("other").alias("more"))
            n = F.coalesce("held", F.lit(0)) + F.coalesce("more", F.lit(0)) - 1
            return known.join(more, by, "full_outer").select(by, n.alias("n_links"))

        by_class = single.join(seen(sight, "a").withColumnRenamed("a", "class"), "class").select("doc_id", "n_links")
        by_doc = several.select("doc_id", F.col("class").alias("a")).join(sight, "a").select("doc_id", "b").distinct()
        counts = by_class.unionByName(seen(by_doc, "doc_id"))

        found = components(links.unionByName(several.select("a", F.col("class").alias("b")))).withColumnRenamed("node", "class")
        within = stored(member.join(found, "class", "left").withColumn("component", F.coalesce("component", "class")), "within")
        least = within.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        least = within.select("doc_id", "component").distinct().join(least, "component").drop("component")
        return sizes.join(counts, "doc_id", "left").join(least, "doc_id", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        )

    def clusters(self, docs: DataFrame) -> DataFrame:
        """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
        order = self.order(docs)
        rows, full, classes, heads = self._classes(docs, order)
        links = self.links(docs, heads, order)

        head = classes.select("high", "low", "n", F.col("doc_id").alias("head"))
        member = stored(full.select("doc_id", "high", "low", "n").join(head, ["high", "low", "n"]).select("doc_id", "head").distinct(), "members")
        node = member.groupBy("doc_id").agg(F.min("head").alias("node"), F.max("head").alias("last"))
        # a doc_id with several texts belongs to all their classes
        several = member.join(node.where("node < last").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
        found = components(links.unionByName(several))
        ids = node.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
        return rows.select("doc_id", F.col("n").alias("n_shingles")).join(ids, "doc_id", "left").select(
            "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
        )


def _named(df: DataFrame, end: str) -> DataFrame:
    return df.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in df.columns if c != "doc_id"])


def _folded(sketch: str, longs: Column) -> Column:
    """A sketch of twice as many longs brought to ``longs``; similar sets' sizes lie less than a factor of two apart."""
    half = F.zip_with(F.slice(sketch, F.lit(1), longs), F.slice(sketch, longs + 1, longs), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > longs, F.when(longs > 0, half).otherwise(F.array().cast("array<bigint>"))).otherwise(F.col(sketch))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _digest(tokens: np.ndarray) -> list[int]:
    return [int(np.bitwise_xor.reduce(mixed(tokens * np.uint64(k)), initial=np.uint64(len(tokens))).view(np.int64)) for k in (3, 5)]


def _sketch(tokens: np.ndarray, longs: int) -> np.ndarray:
    """Parity bits of the tokens that fall on each of ``64 * longs`` places; halves xor to the sketch of half as many."""
    bits = np.bincount((tokens & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs)
    return np.packbits(bits.astype(np.uint8) & 1).view(np.int64)


def _fine(tokens: np.ndarray) -> np.ndarray:
    """The sketch of a set too large for the short one, with a bit for about two tokens; empty for others."""
    longs = min(FINEST, 1 << (max(len(tokens) - 1, 0) // 128).bit_length())
    return _sketch(tokens, longs) if longs > SKETCH else np.zeros(0, np.int64)


def _prefix(tokens: np.ndarray, k: int, percent: int, often: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first tokens of a set in order ``k``, as many as a similar set must share one of."""
    n = len(tokens)
    length = n - -(-n * percent // 100) + 1 if n else 0
    # each order is another shuffle of all shingles, with the frequent ones last
    key = mixed(tokens ^ np.uint64(0xD1B54A32D192ED03 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(8)
    if len(often):
        at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
        key |= np.where(often[at] == tokens, ranks[at], np.uint64(0)) << np.uint64(56)
    first = np.argpartition(key, length - 1)[:length] if 0 < length < n else np.arange(length)
    return tokens[first[np.argsort(key[first], kind="stable")]]
