"""Toxicity by weak supervision: many voters, a generative model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.logistic import fit, logit, sigmoid
from telemill.llm.tables import only, stored
from telemill.llm.words import ALPHANUMERIC, Words, mixed, text_batches, utf8

SAMPLE = 20_000  # labelled rows that lexicons are mined from, and rows that the classifier is fitted on
PREFIXES = (4, 5, 6)  # bytes of a word's beginning that count as features beside the whole word
MINED = 600  # features that lexicons and classifier use at most
LEAST = 6  # toxic rows of the sample that a mined feature must be in
MINED_VOTERS = 16
PRIOR = 0.05  # share of toxic texts while no labels say otherwise

#: Fixed lexicons, one voter each.
LEXICONS = {
    "stupidity": "idiot idiots moron morons stupid dumb imbecile retard fool idiota estupido dumm idiotin imbécile stupide",
    "contempt": "loser losers pathetic worthless scum trash garbage filth vermin clown abschaum basura ordure",
    "disgust": "disgusting gross vile repulsive revolting sickening",
    "threat": "kill die hang strangle murder destroy",
    "hate": "hate hated despise loathe hass odio haine",
    "obscenity": "fuck fucking shit bitch bastard asshole crap damn mierda merde scheisse",
}
#: Shapes of the text, one voter each: masked letters, shouting, repeated marks.
PATTERNS = ("masked", "shouting", "repeated")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct features of each text: whole words and their beginnings, told apart by their kind."""
    words = Words(data, offsets, ALPHANUMERIC)
    kinds = [mixed(h + np.uint64(k)) for k, h in enumerate(words.hashes(*PREFIXES))]
    return [np.unique(np.concatenate([h[a:b] for h in kinds])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _fixed() -> list[np.ndarray]:
    """The features of each lexicon's whole words."""
    out = []
    for words in LEXICONS.values():
        raw = words.encode()
        out.append(np.unique(mixed(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALPHANUMERIC).hashes()[0])))
    return out


def _patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A column per pattern of which texts show it."""
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letter = upper | lower
    mark = np.isin(data, np.frombuffer(b"*@#$%&", np.uint8))
    last = np.zeros(len(data) + 2, dtype=bool)
    masked, repeated = last.copy(), last.copy()
    if len(data) > 2:
        masked[: len(data) - 2] = letter[:-2] & mark[1:-1] & letter[2:]
        shout = np.isin(data, np.frombuffer(b"!?", np.uint8))
        repeated[: len(data) - 1] = shout[:-1] & shout[1:]

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    letters = count(letter)
    return np.column_stack([count(masked[: len(data)]) > 0, (letters >= 20) & (2 * count(upper) > letters), count(repeated[: len(data)]) > 0])


@dataclass
class Lexicon:
    """Features that votes and scores look at, sorted, and the voter each belongs to (-1: none)."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    voter: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def columns(self) -> int:
        return len(self.features) + len(PATTERNS)

    @property
    def voters(self) -> int:
        return len(LEXICONS) + MINED_VOTERS + len(PATTERNS)


def mined(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Lexicon, float]:
    """The lexicon that labelled rows show, joined with the fixed ones, and the share of toxic rows.

    Labels of held-out rows are left out before anything else. Of the others, up to ``SAMPLE`` rows chosen by a hash
    of their id are read; several labels of one id count as toxic if one does.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")).where("y in (0, 1)")
    share = known.agg(F.avg("y")).first()[0]
    known = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "labelled")
    texts = stored(only(docs.select("doc_id", "text"), known, "doc_id").join(F.broadcast(known), "doc_id").select("text", "y"), "sample")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, 1 << 19):
                sets = _features(*utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], ["feature"])

    often = texts.where("y = 1").mapInArrow(spread, "feature long").groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    often = stored(often, "often")
    candidates = np.sort(np.array([r[0] for r in often.select("feature").toLocalIterator()], dtype=np.int64).view(np.uint64))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, len(candidates)), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in text_batches(batch, 1 << 19):
                sets = _features(*utf8(part.column("text")))
                for y, s in zip(part.column("y").to_numpy(zero_copy_only=False).astype(int), sets, strict=True):
                    seen[y, _places(candidates, s)] += 1
                    rows[y] += 1
        for y in (0, 1):
            at = np.append(np.flatnonzero(seen[y]), len(candidates))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), y), pa.int32()), pa.array(at, pa.int64()), pa.array(np.append(seen[y], rows[y])[at], pa.int64())], ["y", "place", "n"])

    counts = np.zeros((2, len(candidates) + 1))
    for r in texts.mapInArrow(tally, "y int, place long, n long").groupBy("y", "place").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["y"], r["place"]] = r["n"]
    (clean, toxic), rows = counts[:, :-1], counts[:, -1]
    p1, p0 = (toxic + 0.5) / (rows[1] + 1), (clean + 0.5) / (rows[0] + 1)
    pooled = (toxic + clean + 0.5) / (rows.sum() + 1)
    strength = (p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / max(rows[1], 1) + 1 / max(rows[0], 1)))
    chosen = np.argsort(-strength, kind="stable")[:MINED]
    chosen = chosen[strength[chosen] > 4]
    # features of which most rows are toxic vote; the others only inform the classifier
    sure = toxic[chosen] > clean[chosen]
    voter = dict(zip(candidates[chosen].tolist(), np.where(sure, len(LEXICONS) + (candidates[chosen] % np.uint64(MINED_VOTERS)).astype(np.int64), -1).tolist(), strict=True))
    for k, fixed in enumerate(_fixed()):
        voter.update(dict.fromkeys(fixed.tolist(), k))
    features = np.array(sorted(voter), dtype=np.uint64)
    return Lexicon(features, np.array([voter[f] for f in features.tolist()], dtype=np.int64)), PRIOR if share is None else float(share)


def _places(table: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Where in ``table`` those of ``features`` stand that it holds."""
    if not len(table):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, features), len(table) - 1)
    return at[table[at] == features]


def voted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row: doc_id, columns (features of the lexicon and patterns that the whole text shows) and votes (a bit per voter)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                data, offsets = utf8(part.column("text"))
                patterns = _patterns(data, offsets)
                columns, votes = [], []
                for k, features in enumerate(_features(data, offsets)):
                    at = _places(lexicon.features, features)
                    own = np.flatnonzero(patterns[k])
                    columns.append(np.concatenate([at, len(lexicon.features) + own]).astype(np.int32))
                    who = np.concatenate([lexicon.voter[at], lexicon.voters - len(PATTERNS) + own])
                    votes.append(int(np.bitwise_or.reduce(1 << who[who >= 0], initial=0)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(columns, pa.list_(pa.int32())), pa.array(votes, pa.int64())], ["doc_id", "columns", "votes"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, columns array<int>, votes long")


@dataclass
class LabelModel:
    """Rates of a vote among toxic and clean texts, and how much each voter's word counts beside correlated ones."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) for rows of 0/1 votes."""
        yes, no = np.log(self.toxic / self.clean), np.log((1 - self.toxic) / (1 - self.clean))
        return sigmoid(logit(self.prior) + votes @ (self.share * yes) + (1 - votes) @ (self.share * no))


def label_model(rows: DataFrame, voters: int, prior: float) -> LabelModel:
    """Fits the model to how often voters agree over all rows of ``voted``; no label is looked at.

    Voters that are independent given the class covary as prior * (1 - prior) times the product of what the class
    does to each one's rate. Those effects are fitted to all pairs, with less weight for pairs that do not fit; what
    such pairs covary beyond is their own correlation.
    """
    patterns = rows.groupBy("votes").agg(F.count("*").alias("n"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((voters + 1, voters + 1))
        for batch in batches:
            bits = _bits(batch.column("votes").to_numpy(zero_copy_only=False), voters + 1)
            bits[:, voters] = 1
            total += (bits * batch.column("n").to_numpy(zero_copy_only=False)[:, None]).T @ bits
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total[i, j])], ["i", "j", "n"])

    total = np.zeros((voters + 1, voters + 1))
    for r in patterns.mapInArrow(moments, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        total[r["i"], r["j"]] = r["n"]
    n = max(total[-1, -1], 1.0)
    rate = total[-1, :-1] / n
    covariance = total[:-1, :-1] / n - np.outer(rate, rate)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    apart = 1.0 - np.eye(voters)
    unit = prior * (1 - prior)
    effect, weight = np.sqrt(np.maximum((covariance * apart).max(axis=1), 0) / unit), apart.copy()
    for _ in range(200):
        for i in range(voters):
            below = (weight[i] * effect**2).sum()
            effect[i] = max(0.0, (weight[i] * effect * covariance[i] / unit).sum() / below) if below > 0 else 0.0
        effect = np.minimum(effect, rate / prior)
        left = (covariance - unit * np.outer(effect, effect)) / np.outer(spread, spread)
        weight = apart / (1 + (np.abs(left) / 0.05) ** 2)
    correlated = np.where((left > 0.1) & (apart > 0), left, 0)
    toxic = np.clip(rate + (1 - prior) * effect, 1e-4, 1 - 1e-4)
    clean = np.clip(rate - prior * effect, 1e-5, 1 - 1e-4)
    return LabelModel(prior, np.maximum(toxic, clean), clean, 1 / (1 + correlated.sum(axis=1)))


def _bits(votes: np.ndarray, voters: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(voters)) & 1).astype(np.float64)


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if the score is at least 0.5) and posterior.

    Scores come from the text alone; null and empty texts get the score of a text without any feature. Without
    labels only the fixed lexicons and patterns vote. Rows with a null ``doc_id`` are scored and not held out.
    """
    lexicon, share = mined(docs, labels, label)
    rows = stored(voted(docs, lexicon), "votes")
    model = label_model(rows, lexicon.voters, min(max(share, 0.005), 0.5))
    sample = rows.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", "votes"), "doc_id").limit(SAMPLE).select("columns", "votes").toArrow()
    found = sample.column("columns").combine_chunks()
    lengths = found.value_lengths().to_numpy(zero_copy_only=False)
    target = model.posterior(_bits(sample.column("votes").to_numpy(), lexicon.voters))
    row = np.repeat(np.arange(len(lengths)), lengths)
    weights = fit(row, found.flatten().to_numpy(zero_copy_only=False), len(lengths), lexicon.columns, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("columns")
            row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
            sums = np.bincount(row, weights[own.flatten().to_numpy(zero_copy_only=False)], len(own)) + weights[-1]
            posterior = model.posterior(_bits(batch.column("votes").to_numpy(zero_copy_only=False), lexicon.voters))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(sums)), pa.array(posterior)], ["doc_id", "score", "posterior"])

    return rows.mapInArrow(run, "doc_id long, score double, posterior double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "posterior"
    )
