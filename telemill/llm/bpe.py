"""BPE encoding and decoding with a contiguous array of part boundaries and ranks per word."""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from telemill.llm.words import text_batches

NO_RANK = 1 << 62
WIDTHS = (8, 16, 32)  # bytes of words that are merged together
SHORT = 96  # parts up to which a word's array is scanned; longer words keep a heap of the same ranks
KEPT = 100_000  # stretches whose ids a Python worker remembers at most

#: Letters and digits of Unicode 17 and later, which the vocabulary's library takes for neither.
LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: How text is cut before merging.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{LATER}]]+|[\p{{N}}--[{LATER}]]|[^\s[[\p{{L}}\p{{N}}]--[{LATER}]]]+"
#: Capitals of Unicode 16 and 17 whose small letters Python does not know.
LATER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
LATER_CAPITALS_IN = re.compile("[" + "".join(map(chr, LATER_CAPITALS)) + "]")
#: Printable bytes stand for themselves in a byte-level vocabulary, the others for the characters from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


MARKS = frozenset(".,;:!?()")
CONTROLS = re.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    moved = {b: chr(256 + k) for k, b in enumerate(others)}
    return [moved.get(b, chr(b)) for b in range(256)]


class WordBpe:
    """A byte-level BPE vocabulary with word ends, as in the json file of the tokenizers library.

    Texts are brought to NFC, lower-cased and cut by ``PATTERN``; white space is dropped. Special tokens keep
    their ids where their strings occur in a text. Null counts as the empty text, which has no tokens.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        vocabulary, model = about["model"]["vocab"], about["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in about["added_tokens"]}
        self.tokens = {i: t for t, i in (*vocabulary.items(), *self.special.items())}
        #: (left id, right id) -> rank, and rank -> id of the merged token
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocabulary[left], vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        pairs = sorted((left * len(self.tokens) + right, rank) for (left, right), rank in self.ranks.items())
        self.pairs, self.pair_ranks = np.array(pairs, dtype=np.int64).T.copy()
        characters = byte_characters()
        self.inner = [vocabulary[c] for c in characters]
        self.last = [vocabulary[c + self.end] for c in characters]
        self.inner_ids, self.last_ids, self.made_ids = np.array(self.inner), np.array(self.last), np.array(self.made)
        self.cut = regex.compile(PATTERN, regex.V1)
        # characters are told apart as the pattern's own classes do, not as Python's split does
        self.space = regex.compile(r"\s+")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank_of, made = self.ranks.get, self.made
        # ranks[i] is that of joining part i with the next; the last part has no next
        ranks = [rank_of(pair, NO_RANK) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != NO_RANK:
            at = ranks.index(least)
            parts[at] = made[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), NO_RANK)
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, where scanning would cost the square of the length."""
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(self.ranks[pair], at) for at, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            if right < 0 or parts[at] < 0 or self.ranks.get((parts[at], parts[right])) != rank:
                continue  # one of its parts has been merged since
            parts[at], parts[right], after[at] = self.made[rank], -1, after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0 and (found := self.ranks.get((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(heap, (found, left))
        return [p for p in parts if p >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many words: the arrays of words of like length stand below each other and take their merges together."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        for low, high in pairwise((0, *WIDTHS)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(rows):
                for row, ids in zip(rows.tolist(), self._merge_rows([words[r] for r in rows], lengths[rows], high), strict=True):
                    out[row] = ids
        for row in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            out[row] = self.merge(words[row])
        return out

    def _merge_rows(self, words: list[bytes], lengths: np.ndarray, width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(-1, width)
        column = np.arange(width)
        parts = np.where(column < lengths[:, None], self.inner_ids[raw], -1)
        parts[np.arange(len(words)), lengths - 1] = self.last_ids[raw[np.arange(len(words)), lengths - 1]]
        count, at_work = lengths.copy(), np.arange(len(words))
        now, ranks = parts, np.full((len(words), width), NO_RANK)
        ranks[:, :-1] = self._rank_of(parts[:, :-1], parts[:, 1:])
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(ranks)), at]
            more = least < NO_RANK
            if not more.all():
                parts[at_work] = now
                at_work, now, ranks, at, least = at_work[more], now[more], ranks[more], at[more], least[more]
                if not len(at_work):
                    break
            row = np.arange(len(at_work))
            now[row, at] = self.made_ids[least]
            count[at_work] -= 1
            # the boundary after the merged part goes, and everything behind it moves up
            now[:, :-1] = np.where(column[:-1] > at[:, None], now[:, 1:], now[:, :-1])
            now[:, -1] = -1
            ranks[:, :-1] = np.where(column[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            ranks[row, at] = self._rank_of(now[row, at], now[row, np.minimum(at + 1, width - 1)])
            before = np.flatnonzero(at)
            ranks[before, at[before] - 1] = self._rank_of(now[before, at[before] - 1], now[before, at[before]])
        return [ids[:n] for ids, n in zip(parts.tolist(), count.tolist(), strict=True)]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * len(self.tokens) + right
        slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[slot] == pair) & (right >= 0), self.pair_ranks[slot], NO_RANK)

    def normalised(self, text: str) -> str:
        if not text.isascii():
            # lower-casing goes by character: a sigma at a word's end gets no form of its own
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
            if LATER_CAPITALS_IN.search(text):
                text = text.translate(LATER_CAPITALS)
        return text.lower()

    def stretches(self, text: str) -> list[str]:
        """A text cut at white space and around special tokens, which begin with a blank here."""
        if not self.marks or "<|" not in text:
            return self._plain(text)
        found, at = [], 0
        for mark in self.marks.finditer(text):
            found += [*self._plain(text[at : mark.start()]), " " + mark[0]]
            at = mark.end()
        return found + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        text = self.normalised(text)
        # separator controls are white space for Python alone
        return [s for s in self.space.split(text) if s] if CONTROLS.search(text) else text.split()

    def _words(self, stretch: str) -> list[str]:
        """What ``cut`` finds; a run of letters, with a mark behind it or not, needs no pattern."""
        if stretch.isalpha():
            return [stretch]
        if stretch[-1] in MARKS and stretch[:-1].isalpha():
            return [stretch[:-1], stretch[-1]]
        return self.cut.findall(stretch)

    def _learn(self, new: set[str]) -> None:
        words = {s: self._words(s) for s in new if s[0] != " "}
        distinct = list(set(chain.from_iterable(words.values())))
        tokens = self.tokens.__getitem__
        of = {
            w: (struct.pack(f"<{len(ids)}I", *ids), " ".join(map(tokens, ids)))
            for w, ids in zip(distinct, self.merge_many([w.encode() for w in distinct]), strict=True)
        }
        for s, found in words.items():
            self.known[s] = of[found[0]] if len(found) == 1 else (b"".join([of[w][0] for w in found]), " ".join([of[w][1] for w in found]))
        for s in new.difference(words):
            self.known[s] = struct.pack("<I", self.special[s[1:]]), s[1:]

    def both(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        cut = [self.stretches(t or "") for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = set().union(*cut)
        self._learn(new)
        for stretches in cut:
            found = [self.known[s] for s in stretches]
            yield b"".join([ids for ids, _ in found]), " ".join([decoded for _, decoded in found])

    def encode(self, text: str | None) -> list[int]:
        ids = next(self.both([text]))[0]
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens in a row with blanks between: the vocabulary names no decoder."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The vocabulary at ``path``, read once per Python worker."""
    return WordBpe(path)


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the token ids (array<long>) and the decoded text of the column ``text``; columns of those names are replaced.

    ``path`` must be readable on every executor. Null texts have no tokens and decode to the empty text.
    """
    return _coded(docs, path, text, {ids: "array<long>", decoded: "string"}, (), lambda codes, text: (np.frombuffer(codes, "<u4").tolist(), text))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256 (UTF-8)."""
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return _coded(docs, path, text, kinds, (text,), lambda codes, text: (len(codes) // 4, sha256(codes).hexdigest(), sha256(text.encode()).hexdigest()))


def _coded(docs: DataFrame, path: str, text: str, kinds: dict[str, str], without: tuple[str, ...], of: Callable[[bytes, str], tuple]) -> DataFrame:
    taken = {k.lower() for k in (*kinds, *without)}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    # the caller's columns travel in one struct, so that none can meet a working name
    rows = docs.select(F.struct(*kept).alias("row") if kept else F.lit(0).alias("row"), F.col(f"`{text}`").alias("text"))
    new = StructType.fromDDL(", ".join(f"_{n} {v}" for n, v in enumerate(kinds.values())))
    schema = StructType([rows.schema["row"], *new.fields])
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for part in text_batches(batch):
                found = [of(*codes) for codes in bpe.both(part.column("text").to_pylist())]
                columns = [pa.array([r[k] for r in found], fields.field(k + 1).type) for k in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([part.column("row"), *columns], fields.names)

    coded = rows.mapInArrow(run, schema)
    return coded.select(*(["row.*"] if kept else []), *[F.col(f"_{n}").alias(k) for n, k in enumerate(kinds)])
