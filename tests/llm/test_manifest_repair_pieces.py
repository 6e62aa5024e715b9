"""Merkle manifest, conversation repair and sentencepiece coding against plain versions of themselves."""

import heapq
import random
import re
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from telemill.llm import conversations, merkle, ordering, pieces
from telemill.llm.catalog import tokenizer

# --- numbering -----------------------------------------------------------------------------------


def test_rows_are_numbered_across_ranges(spark):
    r = random.Random(1)
    groups = [None, "", "a", "b"] + ["hot"] * 6
    rows = [(r.choice(groups), r.choice([None, 1, 2, 3, r.randrange(10**6)]), "x") for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, o long, rest string").repartition(7)
    found = ordering.numbered(df, "g", ["o"], "numbers").collect()
    for group in set(groups):
        own = sorted((x for x in found if x["g"] == group), key=lambda x: x["_pos"])
        assert [x["_pos"] for x in own] == list(range(len(own)))
        assert [x["o"] for x in own] == sorted((o for g, o, _ in rows if g == group), key=lambda o: (o is not None, o or 0))
    assert ordering.numbered(df.limit(0), "g", ["o"], "numbers").collect() == []


# --- manifest ------------------------------------------------------------------------------------


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The last node and every node's siblings, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, i in zip(paths, at, strict=True):
            path.append(("".join(runs[i // 16][: i % 16]), "".join(runs[i // 16][i % 16 + 1 :])))
        nodes, at = [H(*r) for r in runs], [i // 16 for i in at]
    return nodes[0], paths


def plain_manifest(rows, fields):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(((row["doc_id"] is not None, row["doc_id"] or 0), H(*[value(row[f]) for f in fields])))
    subs = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        leaves = [leaf for _, leaf in sorted(groups[source])]
        subs.append((leaves, *tree(leaves)))
    root, above = tree([s[1] for s in subs]) if subs else (None, [])
    return sorted((leaf, sub, root, tuple(p + q)) for (leaves, sub, paths), q in zip(subs, above, strict=True) for leaf, p in zip(leaves, paths, strict=True))


@pytest.mark.parametrize("sizes", [[1], [16], [17], [256], [257], [3, 1, 16, 17, 256, 257, 700], [1] * 40])
def test_manifest_is_the_tree(spark, sizes):
    r = random.Random(3)
    names = [None, "", "é", "z"] + [f"s{k:02}" for k in range(40)]
    rows = [{"doc_id": r.choice([None, 7, r.randrange(10**6)]), "source": names[k], "text": r.choice([None, "", "Ab漢", str(r.random())])} for k, n in enumerate(sizes) for _ in range(n)]
    rows += [dict(rows[0])] * 3
    fields = ["doc_id", "source", "text"]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "doc_id long, source string, text string").repartition(5)
    out = merkle.manifest(df, merkle.leaf_digest([F.col(f) for f in fields]), carried=[F.col("doc_id").alias("pos"), F.lit(2).alias("g")])
    assert out.columns == ["pos", "g", "leaf", "subroot", "root", "path"]
    out = out.withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("joined", merkle.siblings(F.col("path"))).collect()
    assert sorted((x["leaf"], x["subroot"], x["root"], tuple((p["left"], p["right"]) for p in x["path"])) for x in out) == plain_manifest(rows, fields)
    assert all(x["again"] == x["root"] for x in out)
    assert all(x["joined"] == "".join(p["left"] + p["right"] for p in x["path"]) for x in out)


def test_manifest_of_odd_and_empty_tables(spark, odd):
    leaf = merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")])
    found = merkle.manifest(odd, leaf, carried=["doc_id", "shard", "uid"])
    rows = [x.asDict() for x in odd.collect()]
    want = plain_manifest(rows, ["doc_id", "source", "lang", "n_chars", "text"])
    assert sorted(x["leaf"] for x in found.collect()) == [w[0] for w in want]
    assert {x["root"] for x in found.collect()} == {want[0][2]}
    assert merkle.manifest(odd.limit(0), leaf).collect() == []
    one = merkle.manifest(odd.where("doc_id = 1"), leaf).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


def test_a_changed_row_does_not_lead_to_the_root(spark, documents):
    leaf, other = merkle.leaf_digest([F.col("doc_id"), F.col("text")]), merkle.leaf_digest([F.col("doc_id"), F.concat("text", F.lit("."))])
    proofs = merkle.manifest(documents, leaf, carried=["doc_id", other.alias("other")])
    judged = proofs.select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("good"), merkle.folded(F.col("other"), F.col("path")).alias("bad"))
    assert judged.where("good <> root or bad = root").count() == 0 and judged.count() == documents.count()


# --- conversations -------------------------------------------------------------------------------

LEGAL = re.compile(r"(s?(ua)+)?\Z")
FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_repair(rows):
    """The cheapest, then first, audit by a search over all edits, without any automaton."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], sha256(x[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(conversations.SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, out = heapq.heappop(queue)
        if i == len(rows) and LEGAL.match({"": "", "s": "s", "u": "u", "a": "ua"}[roles]):
            break
        if (i, roles) in done:
            continue
        done.add((i, roles))
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[roles]
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in may:
                heapq.heappush(queue, (cost + 5, audit + "I", i, r, (*out, (name, ""))))
                if i < len(rows) and faults[i] in ("", "truncated"):
                    heapq.heappush(queue, (cost + 1 + 5 * bool(faults[i]), audit + "R", i + 1, r, (*out, (name, rows[i][2]))))
        if i < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, roles, out))
            first = rows[i][1][:1]
            if first and first in may and faults[i] in ("", "truncated"):
                heapq.heappush(queue, (cost + 5 * bool(faults[i]), audit + "K", i + 1, first, (*out, rows[i][1:])))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    firsts = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, H("\n".join(f"{r}:{t}" for r, t in out)))


def test_repairs_are_the_cheapest(spark):
    r = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant"] * 3 + ["tool", ""]
    said = {}
    for c in [None, *range(150)]:
        n = r.choice([0, 1, 2, 3, 4, 5, 6, 7, 63, 64, 65, 128, 200])
        texts = ["a.", "b", "c?", "", "  \n", "d. ", "e. ", "f!\t"] + [f"x{r.random()}." for _ in range(n)]
        said[c] = [(None if r.random() < 0.04 else r.randint(0, 2 * n), r.choice(roles), r.choice(texts)) for _ in range(n)]
    said[999] = [(k // 2, r.choice(roles), r.choice(["", f"{k}.", f"{k}"])) for k in range(3000)]  # more blocks than are joined in one step
    rows = spark.createDataFrame([(c, *x) for c, v in said.items() for x in v], "conv_id long, turn long, role string, text string").repartition(3)
    every = spark.createDataFrame([(c,) for c in said for _ in range(2)], "conv_id long")
    found = {x["conv_id"]: tuple(x[k] for k in FOUND) for x in conversations.digests(rows, every).collect()}
    assert found == {c: plain_repair(v) for c, v in said.items()}


def test_repaired_turns_are_legal_and_named(spark):
    rows = [("one", 1, "assistant", "Hi."), ("one", 2, "user", None), ("one", 3, None, "What?"), ("two", None, "system", "S."), (None, 0, "user", "a.")]
    df = spark.createDataFrame([(*x, "x", "y") for x in rows], "Id string, At int, Who string, Said string, c string, pos string")
    out = {x["conv"]: x for x in conversations.repaired(df, "id", "at", "who", "said").collect()}
    assert [tuple(t) for t in out["one"]["turns"]] == [("user", "Hi."), ("assistant", "What?")] and out["one"]["audit"] == "RDR"
    assert out["two"]["turns"] == [] and out["two"]["audit"] == "D"
    assert out[None]["audit"] == "D" and out["one"]["cost"] == 4
    assert conversations.digests(df.limit(0), df, "Id", "At", "Who", "Said").where("cost <> 0 or audit <> ''").count() == 0
    assert conversations.digests(df.limit(0), df.limit(0), "Id", "At", "Who", "Said").collect() == []


def test_ways_are_found_once_per_shared_end():
    calls, node = [], conversations._node
    conversations._node = lambda letter, rest: calls.append(letter) or node(letter, rest)
    try:
        import pyarrow as pa

        items = sorted([".ausx", ".ausu", ".aus", ".auA", ".u"])
        list(conversations._walked(iter([pa.RecordBatch.from_arrays([pa.array(items)], ["item"])])))
    finally:
        conversations._node = node
    assert len(calls) == len({i[:k] for i in items for k in range(2, len(i) + 1)})


# --- pieces --------------------------------------------------------------------------------------

TEXTS = [
    "", " ", "  a  b ", "a\nb", "　x\xa0y", "ﬁ ① Ａ é é", "▁▁a ▁b", "<s> </s> <unk> <0x0A>", "\x00a\x01", "🙂漢字", "a\tb\r\n", "​﻿\xad", " a", "▁",
    "x" * 70_000, " " * 5000, "ab" * 3000, "many words " * 3000, "\n\n\n\n",
]


@pytest.fixture(scope="module")
def model():
    return tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def own(model):
    return pieces.PieceBpe(model)


def mixed_texts(n):
    r = random.Random(8)
    some = [" ", "  ", "▁", "a", "e", "t", "th", "in", "\n", "é", "漢", "🙂", "1", "́", "ß", "the ", "ing", "\x00", ".", "İ", "ΣΑΣ"]
    anything = lambda: chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x10FFFF)]))
    return ["".join(r.choice(some) if k % 2 else anything() for _ in range(r.randint(0, 50))) for k in range(n)]


def test_same_ids_as_the_library(library, own):
    texts = TEXTS + mixed_texts(4000)
    found = own.encode_many(texts)
    assert [f.tolist() for f in found] == library.encode(texts, num_threads=1)
    assert [own.decode([*f.tolist(), own.end]) for f in found] == [library.decode([*f.tolist(), own.end]) for f in found]


def test_long_words_merge_alike(library, own, monkeypatch):
    monkeypatch.setattr(pieces, "LONG", 3)
    texts = TEXTS[:14] + ["ab" * 300, "many words " * 50] + mixed_texts(500)
    assert [f.tolist() for f in own.encode_many(texts)] == library.encode(texts, num_threads=1)


def test_words_with_the_same_hash_stay_apart(library, own, monkeypatch):
    monkeypatch.setattr(pieces, "_hashes", lambda points, starts, counts: (np.zeros(len(starts), np.uint64), np.arange(len(starts), dtype=np.uint64)))
    texts = ["one two three", "two words", ""]
    assert [f.tolist() for f in own.encode_many(texts)] == library.encode(texts, num_threads=1)


def test_any_ids_decode_as_in_the_library(library, own):
    r = random.Random(6)
    for _ in range(3000):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(0, 259) for _ in range(r.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)


def test_documents_are_coded_whole(spark, documents, odd, library, model):
    for df in (documents, odd, odd.limit(0)):
        rows = df.select("doc_id", "text").collect()
        found = pieces.digests(df.select("doc_id", "text"), model).collect()
        ids = [library.encode(x["text"] or "", add_eos=True) for x in rows]
        want = [(x["doc_id"], len(i), H(" ".join(map(str, i))), H(library.decode(i))) for x, i in zip(rows, ids, strict=True)]
        assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_other_columns_are_kept_under_any_name(spark, model, library):
    df = spark.createDataFrame([(1, "Some text", "a", "b"), (2, None, "a", "b")], "row int, Text string, _0 string, IDS string")
    out = pieces.encoded(df, model, "text", end=False)
    assert out.columns == ["row", "Text", "_0", "ids", "decoded"]
    assert {x["row"]: (x["ids"], x["decoded"]) for x in out.collect()} == {1: (library.encode("Some text"), "Some text"), 2: ([], "")}
