"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.logistic import fit, logit, sigmoid
from telemill.llm.tables import stored
from telemill.llm.words import NON_SPACE, Words, text_batches, utf8

SAMPLE = 20_000  # labelled rows that classifiers are fitted on, at most
PSEUDO = 4_000  # pseudo-labelled rows of a class that one view hands to the other in a round, at most
ROUNDS = 3
SURE = 0.97  # probability from which a view's label is handed on
REJECT = 0.3  # score below which a document goes: clean ones shall stay, so doubtful ones do
BINS = 12  # equal shares of the labelled rows that each measure is cut into
HASHED = 32  # places for names of languages and of sources

CONTENT = (
    "upper", "digits", "marks", "shouts", "symbols", "bars", "spaces", "beyond_ascii", "word_length", "word_spread", "long_words",
    "distinct_words", "most_frequent", "repeated_pairs", "marked_words", "capital_words", "short_words", "sentence_ends",
)
METADATA = ("size", "lines", "line_size", "listed_size", "repeated_lines")

_UPPER, _DIGITS, _MARKS, _SHOUTS, _SYMBOLS, _BARS, _ENDS = (
    np.isin(np.arange(256), np.frombuffer(b, np.uint8))
    for b in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b",;:'\"-()", b"!?", b"#$%&*@^~=+<>{}[]_\\/", b"|", b".!?")
)


def measures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, content and metadata (a number per measure of the whole text), lang and source as places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                listed = part.column("n_chars").cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
                content, metadata = _measured(*utf8(part.column("text")), listed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64())]
                    + [pa.FixedSizeListArray.from_arrays(pa.array(m.astype(np.float32).ravel()), m.shape[1]).cast(pa.list_(pa.float32())) for m in (content, metadata)]
                    + [part.column("lang_at"), part.column("source_at")],
                    ["doc_id", "content", "metadata", "lang_at", "source_at"],
                )

    names = {c.lower() for c in docs.columns}

    def place(name: str) -> Column:
        held = F.col(name).cast("string") if name in names else F.lit(None)
        return F.coalesce(F.pmod(F.xxhash64(held), F.lit(HASHED - 1)) + 1, F.lit(0)).cast("int")

    listed = F.col("n_chars").cast("double") if "n_chars" in names else F.lit(None).cast("double")
    named = docs.select("doc_id", "text", listed.alias("n_chars"), place("lang").alias("lang_at"), place("source").alias("source_at"))
    return named.mapInArrow(run, "doc_id long, content array<float>, metadata array<float>, lang_at int, source_at int")


def _measured(data: np.ndarray, offsets: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offsets)
    words = Words(data, offsets, NON_SPACE)
    hashes = words.hashes()[0]

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def by_word(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
        return sums[words.first[1:]] - sums[words.first[:-1]]

    n, chars = np.maximum(words.count, 1), np.maximum(size, 1)
    length = (words.end - words.start).astype(np.float64)
    last = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    before = data[np.maximum(words.end - 2, words.start)] if len(words.end) else last
    first = data[words.start] if len(words.start) else last
    mean = by_word(length) / n
    lines = [data[a:b].tobytes().split(b"\n") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    distinct, top, pairs = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
    for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b > a:
            own = hashes[a:b]
            found, often = np.unique(own, return_counts=True)
            distinct[k], top[k] = len(found) / (b - a), often.max() / (b - a)
            if b - a > 1:
                both = own[:-1] * np.uint64(3) + own[1:]
                pairs[k] = 1 - len(np.unique(both)) / len(both)
    content = np.column_stack([
        count(_UPPER[data]) / chars, count(_DIGITS[data]) / chars, count(_MARKS[data]) / chars, count(_SHOUTS[data]) / chars,
        count(_SYMBOLS[data]) / chars, count(_BARS[data]) / chars, count(~NON_SPACE[data]) / chars, count(data >= 128) / chars,
        mean, np.sqrt(np.maximum(by_word(length**2) / n - mean**2, 0)), by_word(length > 15) / n,
        distinct, top, pairs, by_word(_SYMBOLS[last] & _SYMBOLS[before]) / n, by_word(_UPPER[first] & (length > 1)) / n, by_word(length <= 2) / n,
        count(_ENDS[data]) / n,
    ])
    n_lines = np.array([len(x) for x in lines])
    repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
    metadata = np.column_stack([np.log1p(size), np.log1p(n_lines), np.log1p(size / np.maximum(n_lines, 1)), np.log1p(np.maximum(listed, -0.5)), repeated])
    return content, metadata


class View:
    """A classifier of one view: measures cut into bins, each bin with a weight of its own."""

    def __init__(self, name: str, edges: np.ndarray):
        self.name, self.edges = name, edges
        self.columns = len(edges) * BINS + (2 * HASHED if name == "metadata" else 0)
        self.weights = np.zeros(self.columns + 1)
        self.scale = (1.0, 0.0)

    def active(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        """The active columns of each row."""
        values = _flat(batch.column(self.name)).reshape(-1, len(self.edges))
        parts = [k * BINS + np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(self.edges)]
        if self.name == "metadata":
            at = len(self.edges) * BINS
            parts += [at + _flat(batch.column("lang_at")), at + HASHED + _flat(batch.column("source_at"))]
        return np.column_stack(parts).astype(np.int64)

    def raw(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        return self.weights[self.active(batch)].sum(axis=1) + self.weights[-1]

    def calibrated(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        """Log-odds of good quality."""
        return self.scale[0] * self.raw(batch) + self.scale[1]

    def learn(self, active: np.ndarray, y: np.ndarray) -> None:
        row = np.repeat(np.arange(len(active)), active.shape[1])
        self.weights = fit(row, active.ravel(), len(active), self.columns, y, ridge=2.0)

    def calibrate(self, batch: pa.Table, y: np.ndarray) -> None:
        """Fits slope and intercept to labelled rows that the weights were not fitted to, held near 1 and 0 while rows are few."""
        raw, self.scale = self.raw(batch), (1.0, 0.0)
        good = y.sum()
        # no row counts as quite certain, so that rows that fall apart cleanly leave finite odds
        target = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
        at = np.array([1.0, 0.0])

        def loss(x: np.ndarray) -> float:
            odds = np.clip(x[0] * raw + x[1], -40, 40)
            return float((np.logaddexp(0, odds) - target * odds).sum() + 0.1 * ((x - [1, 0]) ** 2).sum())

        for _ in range(50):
            p = sigmoid(at[0] * raw + at[1])
            curve = np.maximum(p * (1 - p), 1e-6)
            gradient = np.array([((p - target) * raw).sum(), (p - target).sum()]) + 0.2 * (at - [1, 0])
            hessian = np.array([[(curve * raw**2).sum() + 0.2, (curve * raw).sum()], [(curve * raw).sum(), curve.sum() + 0.2]])
            step = np.linalg.solve(hessian, gradient)
            while np.abs(step).max() > 1e-9 and loss(at - step) > loss(at):
                step /= 2
            at = at - step
            if np.abs(step).max() < 1e-8:
                break
        self.scale = (max(float(at[0]), 0.0), float(at[1]))


def _flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Per row of ``docs``: doc_id, score (0 to 1, higher: better), keep, and each view's own probability.

    Up to ``SAMPLE`` labelled rows, chosen by a hash of their id, are fitted on; a quarter of them only calibrates.
    In each round both views judge every document; the ones that a view is sure of become labels for the other, up
    to ``PSEUDO`` a class, chosen by a hash from all such documents. At last the calibrated log-odds of both views
    are added, the prior counted once, and a score below ``REJECT`` drops the document. Rows without an own label count
    whatever a view says of them; labels never change. Without labels of both classes everything is kept with
    the share of good rows, 0.5 if there are none, as score. Null texts count as empty; null ids are scored too.
    """
    rows = stored(measures(docs), "measures")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(label).alias("y")).where("y in (0, 1)")
    known = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "labelled")
    sample = rows.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toArrow()
    y = sample.column("y").to_numpy().astype(np.float64) if sample.num_rows else np.zeros(0)
    if len(np.unique(y)) < 2:
        score = float(y.mean()) if len(y) else 0.5
        return rows.select("doc_id", F.lit(score).alias("score"), F.lit(True).alias("keep"), F.lit(score).alias("content_score"), F.lit(score).alias("metadata_score"))
    views = [View(name, np.quantile(_flat(sample.column(name)).reshape(len(y), -1), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T) for name in ("content", "metadata")]
    place = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    apart = place % 4 == 0  # a quarter of either class
    held, own = sample.filter(pa.array(apart)), [v.active(sample)[~apart] for v in views]
    taught: list[tuple[np.ndarray, np.ndarray]] = [(a, y[~apart]) for a in own]
    for turn in range(ROUNDS + 1):
        for view, (active, target) in zip(views, taught, strict=True):
            view.learn(active, target)
            view.calibrate(held, y[apart])
        if turn < ROUNDS:
            gained = [_pseudo(rows, known, view, turn) for view in views]
            # what one view is sure of teaches the other
            for k, (view, other) in enumerate(zip(views, gained[::-1], strict=True)):
                for batch, target in other:
                    if batch.num_rows:
                        taught[k] = (np.vstack([taught[k][0], view.active(batch)]), np.append(taught[k][1], np.full(batch.num_rows, target)))
    prior = logit(y.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (v.calibrated(batch) for v in views)
            score = sigmoid(a + b - prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(score >= REJECT), pa.array(sigmoid(a)), pa.array(sigmoid(b))], ["doc_id", "score", "keep", "content_score", "metadata_score"])

    return rows.mapInArrow(run, "doc_id long, score double, keep boolean, content_score double, metadata_score double")


def _pseudo(rows: DataFrame, known: DataFrame, view: View, turn: int) -> list[tuple[pa.Table, float]]:
    """Rows without a label that the view is sure of, for each class, and the class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sigmoid(view.calibrated(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "p"])

    judged = rows.mapInArrow(run, "doc_id long, content array<float>, metadata array<float>, lang_at int, source_at int, p double")
    judged = judged.join(F.broadcast(known), "doc_id", "left_anti")
    order = [F.xxhash64(F.lit(turn), "doc_id"), "doc_id"]
    return [(judged.where(sure).orderBy(*order).limit(PSEUDO).toArrow(), y) for sure, y in ((F.col("p") >= SURE, 1.0), (F.col("p") <= 1 - SURE, 0.0))]
