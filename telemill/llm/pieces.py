"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

All symbols of a batch's distinct words stand in one flat numpy array. A round finds the best pair of every word
(the smallest rank, the leftmost of equals), merges all of them at once, closes the gaps and looks up only the
pairs that are new; words without a pair leave. Rounds go on until no pair remains.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from telemill.llm.words import mixed, text_batches

NO_RANK = np.int64(1 << 62)
BLANK = "▁"  # stands for a space inside pieces
LONG = 2_048  # symbols beyond which a word is merged from a queue of the same ranks, since rounds would cost the square
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


class PieceBpe:
    """A BPE vocabulary of the sentencepiece library with byte fallback.

    Characters are joined to the piece with the best score, the leftmost of equals first; characters without a
    piece become bytes. User-defined pieces are not supported. Null counts as the empty text.
    """

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = library.normalize
        count = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(count)]
        self.end, self.unknown = library.eos_id(), library.unk_id()
        marked = [library.is_byte(i) or library.is_control(i) or library.is_unknown(i) for i in range(count)]
        byte_ids = [i for i in range(count) if library.is_byte(i)]
        #: id of each byte, or of the unknown piece where the vocabulary has no bytes
        self.byte_ids = np.array(byte_ids if len(byte_ids) == 256 else [self.unknown] * 256)
        # what a piece stands for in a decoded text
        self.surface = [b"" if marked[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        for value, i in enumerate(byte_ids):
            self.surface[i] = bytes([value])
        if self.unknown >= 0:
            self.surface[self.unknown] = " ⁇ ".encode()
        #: pieces that begin with a blank
        self.led = {i for i, p in enumerate(pieces) if not marked[i] and p[0] == BLANK}
        self.digits = [str(i) for i in range(count)]
        ids = {p: i for i, p in enumerate(pieces) if not marked[i]}
        # characters that occur inside pieces only are symbols, too
        inside = sorted({c for p in ids for c in p}.difference(ids))
        symbols = ids | {c: count + k for k, c in enumerate(inside)}
        self.strings = {i: s for s, i in symbols.items()}
        self.width = count + len(inside)
        self.of_character = np.full(0x110000, -1, dtype=np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_character[ord(c)] = i
        scores = np.array([library.get_score(i) for i in ids.values()])
        ranks = dict(zip(ids, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        found: list[tuple[int, int, int]] = []
        for piece, i in ids.items():
            for at in range(1, len(piece)):
                left, right = symbols.get(piece[:at]), symbols.get(piece[at:])
                if left is not None and right is not None:
                    found.append((left * self.width + right, ranks[piece], i))
        self.pairs, self.pair_ranks, self.made = (np.array(x, dtype=np.int64) for x in zip(*sorted(found), strict=True))
        # two characters that no piece holds next to each other are never joined: words end between them
        neighbours = {pair for p in ids for pair in zip(p, p[1:], strict=False)}
        some = sorted({c for pair in neighbours for c in pair})
        self.place = np.zeros(0x110000, dtype=np.int32)
        self.place[[ord(c) for c in some]] = np.arange(1, len(some) + 1)
        self.meet = np.zeros((len(some) + 1, len(some) + 1), dtype=bool)
        for a, b in neighbours:
            self.meet[self.place[ord(a)], self.place[ord(b)]] = True

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; ``NO_RANK`` for those that make no piece."""
        pair = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[slot] == pair, self.pair_ranks[slot], NO_RANK), self.made[slot]

    def _merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words after all merges, and how many each word has left."""
        out = np.full(len(symbols), -1, dtype=np.int64)
        first = np.cumsum(counts) - counts  # where a word's result begins in ``out``
        left_over = counts.copy()
        word = np.repeat(np.arange(len(counts)), counts)
        now = symbols.copy()
        rank, made = np.full(len(now), NO_RANK), np.zeros(len(now), dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self._look_up(now[inner], now[inner + 1])
        while len(now):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(now)))
            least = np.minimum.reduceat(rank, starts)
            done = least == NO_RANK
            if done.any():
                finished = np.repeat(done, sizes)
                at = np.flatnonzero(finished)
                place = at - np.repeat(starts, sizes)[at]
                out[first[word[at]] + place] = now[at]
                left_over[word[starts[done]]] = sizes[done]
                now, word, rank, made = now[~finished], word[~finished], rank[~finished], made[~finished]
                continue
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            # the leftmost of the word's best pairs
            hits = hits[np.concatenate(([True], word[hits[1:]] != word[hits[:-1]]))]
            now[hits] = made[hits]
            keep = np.ones(len(now), dtype=bool)
            keep[hits + 1] = False
            now, word, rank, made = now[keep], word[keep], rank[keep], made[keep]
            hits = hits - np.arange(len(hits))  # every hit before closed one gap
            fresh = np.concatenate((hits, hits[hits > 0] - 1))
            same = np.zeros(len(fresh), dtype=bool)
            inside = fresh + 1 < len(now)
            same[inside] = word[fresh[inside]] == word[fresh[inside] + 1]
            rank[fresh[~same]] = NO_RANK
            fresh = fresh[same]
            rank[fresh], made[fresh] = self._look_up(now[fresh], now[fresh + 1])
        return out[np.arange(len(out)) - np.repeat(first, counts) < np.repeat(left_over, counts)], left_over

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges in the same order from a queue."""
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        found = self._look_up(np.array(symbols[:-1]), np.array(symbols[1:]))
        queue = [(r, at, symbols[at], symbols[at + 1], m) for at, (r, m) in enumerate(zip(*(x.tolist() for x in found), strict=True)) if r != NO_RANK]
        heapq.heapify(queue)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        while queue:
            _, at, left, right, merged = heapq.heappop(queue)
            follower = after[at]
            if symbols[at] != left or follower < 0 or symbols[follower] != right:
                continue  # one of the two has been merged since
            symbols[at], symbols[follower], after[at] = merged, -2, after[follower]
            if after[at] >= 0:
                before[after[at]] = at
            for one in (before[at], at):
                if one >= 0 and after[one] >= 0:
                    pair = symbols[one], symbols[after[one]]
                    if pair not in known:
                        r, m = self._look_up(np.array([pair[0]]), np.array([pair[1]]))
                        known[pair] = int(r[0]), int(m[0])
                    r, m = known[pair]
                    if r != NO_RANK:
                        heapq.heappush(queue, (r, one, *pair, m))
        at, out = 0, []
        while at >= 0:
            out.append(symbols[at])
            at = after[at]
        return out

    def _spelled(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many each word has: what has no piece is written in UTF-8 bytes."""
        lone = np.flatnonzero((symbols < 0) | (symbols >= len(self.digits)))
        if not len(lone):
            return symbols, counts
        spelled = [(chr(-1 - s) if s < 0 else self.strings[s]).encode() for s in symbols[lone].tolist()]
        if self.byte_ids[0] == self.byte_ids[1]:  # no bytes in the vocabulary: one unknown piece
            spelled = [b"\0" for _ in spelled]
        size = np.ones(len(symbols), dtype=np.int64)
        size[lone] = [len(s) for s in spelled]
        out = np.repeat(symbols, size)
        ends = np.cumsum(size)
        into = np.concatenate([np.arange(ends[k] - size[k], ends[k]) for k in lone])
        out[into] = self.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        word = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(word, weights=size, minlength=len(counts)).astype(np.int64)

    def encode_many(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        texts = [self.normalise(t) if t else "" for t in texts]
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            return [np.zeros(0, dtype=np.int64) for _ in texts]
        begins = np.ones(len(points), dtype=bool)
        place = self.place[points]
        begins[1:] = ~self.meet[place[:-1], place[1:]]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        begins[offsets[:-1][lengths > 0]] = True
        starts = np.flatnonzero(begins)
        counts = np.diff(np.append(starts, len(points)))
        one, other = _hashes(points, starts, counts)
        _, kept, which = np.unique(one, return_index=True, return_inverse=True)
        if not (other == other[kept][which]).all():  # two words with the same hash: every word for itself
            kept = which = np.arange(len(starts))
        symbols = self.of_character[points]
        symbols = np.where(symbols < 0, -1 - points.astype(np.int64), symbols)
        chosen = counts[kept]
        long = chosen > LONG
        flat, size = _slices(symbols, starts[kept][~long], chosen[~long])
        ids, left = self._spelled(*self._merge(flat, size))
        if long.any():
            rows = [self._merge_long(symbols[starts[k] : starts[k] + counts[k]].tolist()) for k in kept[long]]
            more, more_left = self._spelled(np.array([s for r in rows for s in r]), np.array([len(r) for r in rows]))
            ids, left = np.concatenate((ids, more)), np.concatenate((left, more_left))
        order = np.empty(len(kept), dtype=np.int64)  # place of each distinct word among the results
        order[np.concatenate((np.flatnonzero(~long), np.flatnonzero(long)))] = np.arange(len(kept))
        begin, which = np.cumsum(left) - left, order[which]
        flat, _ = _slices(ids, begin[which], left[which])
        ends = np.concatenate(([0], np.cumsum(left[which])))[np.searchsorted(starts, offsets)]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decoded(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of the text that ids stand for; the blank put before every text goes."""
        ids = list(ids)
        joined = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        return joined[1:] if first in self.led else joined

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoded(ids).decode(errors="each_byte")


def _slices(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``values`` one after the other, and their lengths."""
    begin = np.cumsum(counts) - counts
    return values[np.repeat(starts - begin, counts) + np.arange(counts.sum())], counts


def _hashes(points: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word."""
    place = (np.arange(len(points)) - np.repeat(starts, counts)).astype(np.uint64)
    seeded = mixed(points.astype(np.uint64) * _BASE + place * np.uint64(0xD1B54A32D192ED03) + _BASE)
    size = counts.astype(np.uint64)
    return mixed(np.add.reduceat(seeded, starts) + size), mixed(np.add.reduceat(mixed(seeded ^ _BASE), starts) ^ size)


@lru_cache(maxsize=2)
def piece_bpe(path: str) -> PieceBpe:
    """The vocabulary at ``path``, read once per Python worker."""
    return PieceBpe(path)


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", end: bool = True) -> DataFrame:
    """``docs`` with the token ids (array<long>, closed by the end id unless ``end`` is false) and the decoded text.

    Columns of those names are replaced, others may have any name. ``path`` must be readable on every executor. Null and
    empty texts have the end id alone and decode to the empty text; texts of any length are taken whole.
    """
    return _coded(docs, path, text, end, {ids: "array<bigint>", decoded: "string"}, False, ())


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (UTF-8); ids end with the end id."""
    return _coded(docs, path, text, True, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, True, (text,))


def _coded(docs: DataFrame, path: str, text: str, end: bool, kinds: dict[str, str], hashed: bool, without: tuple[str, ...]) -> DataFrame:
    taken = {k.lower() for k in (*kinds, *without)}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    # the caller's columns travel in one struct, so that none can meet a working name
    rows = docs.select(F.struct(*kept).alias("row") if kept else F.lit(0).alias("row"), F.col(f"`{text}`").alias("text"))
    new = StructType.fromDDL(", ".join(f"_{n} {v}" for n, v in enumerate(kinds.values())))
    schema = StructType([rows.schema["row"], *new.fields])
    kinds_of = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(path)
        tail, digits = [bpe.end] if end else [], bpe.digits.__getitem__
        for batch in batches:
            for part in text_batches(batch):
                out: list[tuple] = []
                for found in bpe.encode_many(part.column("text").to_pylist()):
                    listed = found.tolist() + tail
                    if hashed:
                        out.append((len(listed), sha256(" ".join(map(digits, listed)).encode()).hexdigest(), sha256(bpe.decoded(listed)).hexdigest()))
                    else:
                        out.append((listed, bpe.decode(listed)))
                columns = [pa.array([r[k] for r in out], kinds_of.field(k + 1).type) for k in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([part.column("row"), *columns], kinds_of.names)

    coded = rows.mapInArrow(run, schema)
    return coded.select(*(["row.*"] if kept else []), *[F.col(f"_{n}").alias(k) for n, k in enumerate(kinds)])
