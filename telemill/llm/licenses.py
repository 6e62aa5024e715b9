"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from telemill.llm.words import ALPHANUMERIC, LOWER, Words, text_batches, utf8

#: Notice phrases (as words) and the label each stands for.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: More notices, in the same form.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: How free a licence family leaves its user: 1 no more than a notice, 0 no use at all.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "0bsd": 1.0, "cc0": 1.0, "cc-by": 0.9, "mpl": 0.7,
    "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "reserved": 0.0,
}
EXCEPTION = 0.3  # what an exception adds: it only widens what its licence allows
UNKNOWN = 0.5
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_AFTER_TAG = re.compile(rb"[ \t:]*([ \t()A-Za-z0-9.+:-]*)")
_STRENGTH = {"OR": 1, "AND": 2, "WITH": 3}

_LABELLED = {**BASE, **NOTICES}


def freedom(licence: str) -> float:
    """Of the longest family that an identifier begins with."""
    name = licence.lower()
    fits = [f for f in FREEDOM if name == f or name.startswith((f + "-", f + "+"))]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN


def expression(text: str) -> list[str]:
    """The tokens of the longest well-formed expression that ``text`` begins with, in postfix order; empty if there is none.

    WITH binds closest, then AND, then OR; operators of one strength bind to the left and are read in any case.
    """
    best: list[str] = []
    out: list[str] = []
    wait: list[str] = []
    operand = True  # whether an operand or an opening bracket comes next
    at = 0
    while found := _TOKEN.match(text, at):
        token, at = found[1], found.end()
        operator = token.upper()
        if operator in _STRENGTH:
            if operand:
                break
            while wait and wait[-1] != "(" and _STRENGTH[wait[-1]] >= _STRENGTH[operator]:
                out.append(wait.pop())
            wait.append(operator)
            operand = True
        elif token == "(":
            if not operand:
                break
            wait.append(token)
        elif token == ")":
            if operand or "(" not in wait:
                break
            while wait[-1] != "(":
                out.append(wait.pop())
            wait.pop()
        else:
            if not operand:
                break
            out.append(token.rstrip(".:"))
            operand = False
        if not operand and "(" not in wait:
            best = out + wait[::-1]
    return best


def evaluate(postfix: list[str]) -> float:
    """0 to 1: OR leaves the choice, AND binds to both, WITH adds an exception to its licence."""
    stack: list[float] = []
    for token in postfix:
        if token not in _STRENGTH:
            stack.append(freedom(token))
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(max(left, right) if token == "OR" else min(left, right) if token == "AND" else min(1.0, left + EXCEPTION))
    return stack[0] if stack else UNKNOWN


def licences(postfix: list[str]) -> list[str]:
    """The identifiers of an expression, without its exceptions, in lower case."""
    stack: list[list[str]] = []
    for token in postfix:
        if token not in _STRENGTH:
            stack.append([token.lower()])
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if token == "WITH" else left + right)
    return stack[0] if stack else []


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Finds phrases as whole words in texts whose words have one blank before and after each."""
    found = ahocorasick.Automaton()
    for phrase in (*_LABELLED, TAG):
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


class Found:
    """What a scan found in one text: ``places`` (first word, phrase) and ``expressions`` (postfix)."""

    def __init__(self, places: list[tuple[int, str]], expressions: list[list[str]]):
        self.places, self.expressions = places, expressions

    def labels(self) -> list[str]:
        return sorted({*(_LABELLED[p] for _, p in self.places if p != TAG), *(i for e in self.expressions for i in licences(e))})

    def base(self) -> list[tuple[int, str]]:
        return [(at, BASE[p]) for at, p in self.places if p in BASE]

    def score(self) -> float:
        """How free the text's use is by the strictest thing found; 0.5 when nothing is."""
        found = [freedom(_LABELLED[p]) for _, p in self.places if p != TAG] + [evaluate(e) for e in self.expressions]
        return min(found, default=UNKNOWN)


NOTHING = Found([], [])


def scan(raw: bytes) -> Found:
    """Finds every phrase and tag of one text, from its UTF-8 bytes."""
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALPHANUMERIC)
    low = LOWER[np.frombuffer(raw, np.uint8)].tobytes()
    plain = " " + " ".join([low[a:b].decode() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]) + " "
    blanks = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le"), np.uint32) == 32)
    places = []
    for last, phrase in automaton().iter(plain):
        places.append((int(np.searchsorted(blanks, last - len(phrase) - 1)), phrase))
    tags = [_AFTER_TAG.match(raw, int(words.end[at + 2]))[1].decode() for at, phrase in places if phrase == TAG]
    return Found(sorted(places), [e for e in map(expression, tags) if e])


#: Bytes that all phrases and tags of ``scan`` contain one of; texts without them need no scan.
_HINT = re.compile(rb"(?i)licen[sc]e|cc[^0-9a-z]+by|rights|hereby|redistribution|creative")


def scanned(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, places (word, phrase), expressions, base_labels, labels, score and the base places.

    Null texts count as empty: no words, no labels, score 0.5. Other columns are not looked at.
    """
    kinds = (
        "doc_id long, n_words long, places array<struct<word: long, phrase: string>>, expressions array<array<string>>,"
        " n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                data, offsets = utf8(part.column("text"))
                raw = data.tobytes()
                found = [scan(raw[a:b]) if _HINT.search(raw, a, b) else NOTHING for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                base = [f.base() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(Words(data, offsets, ALPHANUMERIC).count, pa.int64()),
                        pa.array([[{"word": w, "phrase": p} for w, p in f.places] for f in found], pa.list_(pa.struct({"word": pa.int64(), "phrase": pa.string()}))),
                        pa.array([f.expressions for f in found], pa.list_(pa.list_(pa.string()))),
                        pa.array([len(b) for b in base], pa.int64()),
                        pa.array([min((w for w, _ in b), default=None) for b in base], pa.int64()),
                        pa.array([max((w for w, _ in b), default=None) for b in base], pa.int64()),
                        pa.array([",".join(sorted({label for _, label in b})) for b in base], pa.string()),
                        pa.array([",".join(f.labels()) for f in found], pa.string()),
                        pa.array([f.score() for f in found], pa.float64()),
                    ],
                    ["doc_id", "n_words", "places", "expressions", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, kinds)
