import hashlib
import random
import re

import numpy as np
import public_tokenizers
import collections

import pytest
from tokenizers import Tokenizer

from telemill.llm import bpe, licenses, training_order
from telemill.llm.catalog import encoded, licensed

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_codes_as_the_library(library):
    own, pick = bpe.word_bpe(WORDS), random.Random(1)
    letters = "ab'sS tT''llẞßΣσςİıI <|endoftext|> 12²½́éǅ\x85\xa0\u200b\u3000\x1c漢字🙂-_.,!?\n\t"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(0, 60))) for _ in range(1500)]
    texts += ["", " ", "<|endoftext|>", "x<|startoftext|>y<|endoftext|>", "<|ENDOFTEXT|>", "ab" * 3000 + "!?" * 400, "é" * 500, "isn't I'LL 'D", "q" * 33, "zy" * 16]
    for text, (ids, decoded) in zip(texts, own.both(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert decoded == library.decode(want, skip_special_tokens=False)
    word = "".join(pick.choice("abcdefgh") for _ in range(300)).encode()
    assert own.merge(word) == own._merge_long([*(own.inner[b] for b in word[:-1]), own.last[word[-1]]])
    assert own.merge_many([b"them", word]) == [own.merge(b"them"), own.merge(word)]


def test_encoding_query(spark, sf_dir, documents, library):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = encoded(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_encoding_odd_rows(odd, library):
    rows = bpe.encoded(odd.withColumnRenamed("score", "ids"), WORDS).collect()
    assert len(rows) == odd.count() and "uid" in rows[0]
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    assert bpe.digests(odd.limit(0), WORDS).collect() == []


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_places_are_brute_force(spark, sf_dir, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = licensed(spark, sf_dir).collect()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_scan(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert len(rows) == len(texts)


def test_license_texts(spark, odd):
    texts = [
        "Under the MIT-license, under the mit license under the MIT License", "apache license version 2 cc by nc CC-BY-NC 4.0", "éunder the mit license", "under the mit licenses",
        "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception", "spdx-license-identifier: AGPL-3.0 and ( MIT", "// SPDX-License-Identifier:\nMIT",
        "All rights reserved. Permission is hereby granted, free of charge",
    ]
    rows = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows] == [brute_scan(t) for t in texts]
    assert rows[4]["labels"] == "apache-2.0,gpl-2.0-only,mit" and rows[4]["score"] == 1.0
    assert rows[4]["expressions"] == [["MIT", "GPL-2.0-only", "OR", "Apache-2.0", "LLVM-exception", "WITH", "AND"]]
    assert rows[5]["labels"] == "agpl-3.0" and rows[5]["score"] == 0.2
    assert rows[6]["labels"] == "" and rows[6]["score"] == 0.5
    assert rows[7]["labels"] == "mit,reserved" and rows[7]["score"] == 0.0
    found = {r["doc_id"]: r for r in licenses.scanned(odd).collect()}
    assert found[1]["n_words"] == found[3]["n_words"] == 0 and found[8]["n_words"] == 8000 and found[1]["score"] == 0.5
    assert licenses.scanned(odd.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["", "AND MIT", "()", "MIT)", "(MIT", "MIT Apache-2.0"])
def test_broken_expressions(text):
    assert licenses.expression(text) in ([], ["MIT"])


def test_expressions_bind():
    assert licenses.expression("A OR B AND C WITH D") == ["A", "B", "C", "D", "WITH", "AND", "OR"]
    assert licenses.evaluate(licenses.expression("MIT AND AGPL-3.0 OR GPL-2.0+")) == 0.3
    assert licenses.licences(licenses.expression("GPL-2.0 with Classpath-exception-2.0 or MIT")) == ["gpl-2.0", "mit"]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_permutes(size):
    places = training_order.feistel(np.arange(size), size, 9)
    assert sorted(places.tolist()) == list(range(size))
    assert size < 64 or (places != training_order.feistel(np.arange(size), size, 10)).any()
    one_by_one = [int(training_order.feistel(np.array([k]), size, 9)[0]) for k in range(min(size, 50))]
    assert one_by_one == places[:50].tolist()


def test_shards_hold_every_token_once(spark, documents, odd, tmp_path):
    docs = documents.select("doc_id", "text").unionByName(odd.where("doc_id in (1, 2, 5, 7, 8)").selectExpr("-doc_id as doc_id", "text"))
    found = training_order.shards(docs, BYTES, key=4, length=64, shard=100)
    path = str(tmp_path / "shards")
    training_order.write(found.where("shard % 3 = 0"), path)  # a write that broke off
    training_order.write(found, path)
    rows = spark.read.parquet(path).collect()
    total = sum(len(r["doc_ids"]) for r in rows)
    assert sorted(r["shard"] for r in rows) == list(range(-(-total // 100)))
    assert all(r["first_slot"] == 100 * r["shard"] and len(r["payload"]) == 128 * len(r["doc_ids"]) for r in rows)
    assert all(len(r["doc_ids"]) == 100 for r in rows if r["shard"] < total // 100)
    parts = {}
    for r in training_order.read(spark, path, shard=100).collect():
        parts.setdefault(r["doc_id"], {})[r["part"]] = np.frombuffer(r["record"], "<u2")[: r["n_tokens"]]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert parts.keys() == texts.keys()
    for doc_id, own in parts.items():
        ids = np.concatenate([own[k] for k in range(len(own))]).tolist()
        assert ids[-1] == training_order.END
        assert training_order.vocabulary(BYTES).decode(ids[:-1]) == (texts[doc_id] or "")
    late = [r["slot"] for r in training_order.read(spark, path, slot=250, shard=100).collect()]
    assert late == list(range(250, total))
    assert training_order.shards(docs.limit(0), BYTES).collect() == []


def test_sections_change_no_token(monkeypatch):
    text = "It isn't  so;\n\n 12 words   and\tmore" * 40 + "\n "
    whole = training_order.tokens_of(text, BYTES).tolist()
    monkeypatch.setattr(training_order, "SECTION", 7)
    assert training_order.tokens_of(text, BYTES).tolist() == whole


def test_a_resumed_write_is_whole_however_the_rows_are_read(spark, tmp_path):
    rows = [(k % 150, f"text number {k % 150} " * (k % 40)) for k in range(300)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two, path = str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "out")
    docs.repartition(3).write.parquet(one)
    docs.orderBy("text").coalesce(1).write.parquet(two)
    first = training_order.shards(spark.read.parquet(one), BYTES, key=7, length=16, shard=10)
    second = training_order.shards(spark.read.parquet(two), BYTES, key=7, length=16, shard=10)
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))
    training_order.write(first.where("shard % 2 = 0"), path)
    training_order.write(second, path)
    found = training_order.read(spark, path, shard=10).collect()
    assert [r["slot"] for r in found] == list(range(len(found)))
    have = collections.Counter((r["doc_id"], r["part"], bytes(r["record"])) for r in found)
    want = collections.Counter((r["doc_id"], r["part"], bytes(r["record"])) for r in training_order.sequences(docs, BYTES, 16).collect())
    assert have == want and len(found) > 300
    # texts are tokenised once, though numbers and rows both need them
    assert "Reused" in first._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
