import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.llm import cotraining, pivot_search, sharding, toxicity, url_rules
from telemill.llm.catalog import URL_RULES, sharded
from telemill.llm.graph import components


def test_matrix_has_exact_margins_and_the_right_law():
    matrix = sharding.communication_matrix([5, 0, 9, 1], [6, 5, 4], 3)
    assert matrix.sum(axis=1).tolist() == [5, 0, 9, 1] and matrix.sum(axis=0).tolist() == [6, 5, 4] and matrix.min() >= 0
    draws = collections.Counter(sharding._hypergeometric((k + 0.5) / 5000, 7, 5, 4) for k in range(5000))
    for k in range(5):
        assert abs(draws[k] / 5000 - math.comb(7, k) * math.comb(5, 4 - k) / math.comb(12, 4)) < 1e-3
    big = sharding.communication_matrix([3_000_000_000] * 4, sharding.shard_sizes(12_000_000_000, 8), 1)
    assert big.sum(axis=0).tolist() == [1_500_000_000] * 8


def test_shards_are_exact(spark, sf_dir, documents):
    rows = sharded(spark, sf_dir).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and set(by) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {r["doc_id"]: r["text"].encode() for r in documents.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(d, len(t) + 1, zlib.crc32(t)) for d, t in texts.items()}
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.3


def test_shards_of_odd_rows(spark, odd):
    found = sharding.uniform_shards(odd, [F.col("doc_id"), F.col("text")], 3).collect()
    assert sorted(collections.Counter(r["shard"] for r in found).values()) == [3, 3, 4]
    assert sharding.uniform_shards(odd.limit(0), [F.col("doc_id")], 3).collect() == []
    same = spark.range(500).selectExpr("7 as doc_id")
    assert sorted(collections.Counter(r["shard"] for r in sharding.uniform_shards(same, [F.col("doc_id")], 4).collect()).values()) == [125] * 4


URLS = [
    None, "", "no scheme", "https://www.example.com/en/1", "https://EXAMPLE.com/en/1?x=1", "https://shop.example.com/EN/1", "https://a.net/es/2", "https://anet/es/2", "ftp://net/es/",
    "https://b.org/fr/3", "https://b.org/fr/3/", "http://b.org", "x://c.net/en/#f", "a://b://c.net/fr/1", "https://d.org/x", "https://e.org/y", "https://examplexcom/en/",
]


def test_rules(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    have = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judged(rows, URL_RULES).collect()}
    for k, url in enumerate(URLS):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = rest.replace("?", "/").replace("#", "/").split("/")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        assert have[k] == (host.lower(), path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"), url


def test_blocks_follow_redirects(spark):
    rows = spark.createDataFrame(
        [(k, u) for k, u in enumerate(["https://a.net/es/2", "https://b.org/1/", "http://www.b.org/1.html?u=2", "https://c.org/1", "https://d.org/1", "https://ok.com/1", "https://e.org/1", None])],
        "page_id long, url string",
    )
    edges = spark.createDataFrame(
        [("https://b.org/1", "https://z.org/"), ("https://z.org", "http://a.net/es/2"), ("https://c.org/1", "https://gone.net/fr/9"), ("https://d.org/1", "https://ok.com/1"),
         ("https://d.org/1", "https://x.net/es/1"), (None, "https://a.net/es/2"), ("bad", "https://a.net/es/2")], "source string, target string",
    )
    have = [r["verdict"] for r in url_rules.judged(rows, URL_RULES, edges).orderBy("page_id").collect()]
    # an explicit allow among d's aliases outweighs the block
    assert have == ["block", "block", "block", "block", "allow", "allow", "allow", "allow"]
    assert url_rules.judged(rows.limit(0), URL_RULES, edges.limit(0)).collect() == []


def test_links_of_pages(spark):
    pages = spark.createDataFrame(
        [("https://a.org/1", '<LINK href="https://b.org/2" rel="canonical">'), ("https://a.org/2", "<meta http-equiv='refresh' content='0; url=https://c.org/3'>"),
         ("https://a.org/x/3?q", "<link rel=canonical href=/local> <link rel=canonical href=../up/./4#f> <link rel='canonical' href='//d.org/5'>"), ("https://a.org/4", None),
         ("https://a.org", '<link rel="canonical" href="page"><link rel="canonical" href="mailto:x@y"><link rel="canonical" href="">'), ("none", "<link rel=canonical href=/x>"),
         ("https://a.org/x/5", "<meta http-equiv=refresh content='0; url=?page=2'> <link rel=next href=/no>"), (None, "<link rel=canonical href=https://b.org>")], "url string, html string",
    )
    assert {tuple(r) for r in url_rules.links(pages).collect()} == {
        ("https://a.org/1", "https://b.org/2"), ("https://a.org/2", "https://c.org/3"), ("https://a.org/x/3?q", "https://a.org/local"), ("https://a.org/x/3?q", "https://a.org/up/4#f"),
        ("https://a.org/x/3?q", "https://d.org/5"), ("https://a.org", "https://a.org/page"), ("https://a.org/x/5", "https://a.org/x/5?page=2"),
    }


def test_usual_redirects_are_edges_of_the_graph(spark, monkeypatch):
    given = []
    monkeypatch.setattr(url_rules, "components", lambda edges: given.append(edges) or components(edges))
    rows = spark.createDataFrame([(1, "https://b.org/1/"), (2, "http://www.b.org/1.html"), (3, "b://b.org/1")], "page_id long, url string")
    assert {r["verdict"] for r in url_rules.judged(rows, [("block", "www.b.org", "/")]).collect()} == {"block"}
    assert given[0].count() == 3


NAMES = ["own", "url_", "fit", "blocked", "node", "component", "allow", "_plain", "_block", "_fit", "_key", "_copy", "_random", "_place", "_ends", "_cell", "_again", "_inside", "_start", "Shard", "row", "rand", "a.b"]


def test_operators_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(k, f"https://b.org/{k}", *NAMES) for k in range(7)], ["doc_id", "url", *NAMES])
    judged = url_rules.judged(rows, URL_RULES)
    assert judged.columns == [*rows.columns, "host", "path", "rule", "verdict"] and {tuple(r)[: len(rows.columns)] for r in judged.collect()} == {tuple(r) for r in rows.collect()}
    dealt = sharding.uniform_shards(rows, [F.col("doc_id")], 3)
    own = [c for c in rows.columns if c != "Shard"]
    assert dealt.columns == [*own, "shard", "slot"]
    assert {tuple(r)[: len(own)] for r in dealt.collect()} == {tuple(r) for r in rows.select(*[f"`{c}`" for c in own]).collect()}


def test_shuffle_is_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)  # many blocks, so that rows are exchanged
    rows, parts = 4000, 20
    found = sharding.uniform_shards(spark.range(rows).selectExpr("id as doc_id"), [F.col("doc_id")], 8, 5).orderBy("shard", "slot").collect()
    order = np.array([r["doc_id"] for r in found])
    assert sorted(order) == list(range(rows))
    part = order * parts // rows
    free, most = (parts - 1) ** 2, 4 * math.sqrt(2 * (parts - 1) ** 2)
    # where a row ends does not depend on where it was, nor on which row stands before it
    for a, b in ((part, np.arange(rows) * parts // rows), (part[:-1], part[1:])):
        table = np.histogram2d(a, b, bins=parts, range=[[0, parts], [0, parts]])[0]
        chance = np.outer(table.sum(1), table.sum(0)) / table.sum()
        assert abs(((table - chance) ** 2 / chance).sum() - free) < most


def test_search_is_brute_force(spark):
    pick = np.random.default_rng(2)
    vectors = [(int(k), [float(x) for x in pick.normal(size=9)]) for k in range(900)]
    vectors += [(1000 + k, vectors[5][1]) for k in range(300)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")]), (None, [1.0])]
    vectors += [(2100, [3.0]), (2101, []), (7, vectors[7][1])]
    rows = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string").repartition(6)
    ready = rows.select("vec_id", "score", pivot_search.whole_numbers(F.col("embedding")).alias("vector"))
    have = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in pivot_search.nearest(ready, F.col("vec_id") % 100 == 0, 10).collect()}
    whole = {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q, v in whole:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:10]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scored)}
    assert have == want


def test_search_of_few_and_large_numbers(spark):
    rows = spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 3]), (2, [-(2**40), 3])], "vec_id long, vector array<long>")
    small = rows.withColumn("vector", F.transform("vector", lambda x: x % 2**20))
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in pivot_search.nearest(small, F.col("vec_id") == 0, 5).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert pivot_search.nearest(rows.limit(0), F.col("vec_id") == 0, 5).collect() == []
    assert pivot_search.nearest(small, F.lit(False), 5).collect() == []
    assert pivot_search._products(np.array([[2**30, 5]]), np.array([[2**31, 7]])).tolist() == [[2**61 + 35]]


def test_search_joins_no_exploded_queries_by_broadcast(spark):
    rows = spark.range(400).selectExpr("id", "array(id, id + 1) as v", "cast(id % 2 as int) as pivot", "cast(null as long) as bound", "sequence(0, 15) as cells")
    chunks = spark.range(16).selectExpr("cast(id as int) as cell", "array(named_struct('id', id, 'v', array(id, id))) as rows")
    found = pivot_search._look(rows, chunks, 2, 3)
    assert found.groupBy("query").count().where("count = 16 or (query < 16 and count = 15)").count() == 400
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin [cell#" in plan and "BroadcastHashJoin [cell#" not in plan


def auc(y, score):
    y, rank = np.array(y), np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.fixture(scope="module")
def larger(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    return read("documents"), read("labels")


def test_toxicity_of_held_out_rows(larger):
    docs, labels = larger
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    assert auc([r["toxic"] for r in rows], [r["score"] for r in rows]) > 0.95
    assert np.mean([r["toxic"] == r["predicted"] for r in rows]) > 0.95


def test_held_out_labels_are_not_read(spark, documents, labels):
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.scored(documents, t).collect()) for t in (labels, other)]
    assert scores[0] == scores[1]
    assert [r[0] for r in documents.select(toxicity.held_out(F.col("doc_id"))).collect()] == [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in documents.select("doc_id").collect()]


def test_label_model_finds_rates_and_correlations(spark):
    pick = np.random.default_rng(4)
    y = pick.random(40_000) < 0.2
    votes = np.column_stack([pick.random(len(y)) < np.where(y, a, b) for a, b in ((0.6, 0.02), (0.5, 0.05), (0.4, 0.01), (0.3, 0.03), (0.2, 0.2))])
    votes = np.column_stack([votes, votes[:, 0]])
    bits = (votes.astype(int) << np.arange(6)).sum(axis=1)
    model = toxicity.label_model(spark.createDataFrame([(int(b),) for b in bits], "votes long"), 6, 0.2)
    assert np.allclose(model.toxic[:5], [0.6, 0.5, 0.4, 0.3, 0.2], atol=0.06) and np.allclose(model.clean[:5], [0.02, 0.05, 0.01, 0.03, 0.2], atol=0.03)
    assert model.share[0] < 0.7 and model.share[5] < 0.7 and model.share[1] > 0.8


def test_toxicity_of_odd_rows(spark, odd, labels):
    for known in (labels, labels.limit(0), spark.createDataFrame([(4, None), (None, 1), (6, 1), (6, 0)], "doc_id long, toxic int")):
        rows = toxicity.scored(odd, known).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.scored(odd.limit(0), labels).collect() == []


def test_quality_of_unseen_rows(larger):
    docs, labels = larger
    seen = labels.where("doc_id % 3 <> 0")
    rows = cotraining.scored(docs, seen).join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", "score", "keep").collect()
    assert auc([r["quality"] for r in rows], [r["score"] for r in rows]) > 0.97
    assert np.mean([r["keep"] for r in rows if r["quality"] == 1]) > 0.98
    assert np.mean([r["keep"] for r in rows if r["quality"] == 0]) < 0.3


def test_quality_of_odd_rows(spark, odd, labels):
    for known in (labels, labels.limit(0), spark.createDataFrame([(4, None), (None, 1), (6, 1), (2, 0)], "doc_id long, quality int")):
        rows = cotraining.scored(odd, known).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["keep"] for r in cotraining.scored(odd, labels.limit(0)).collect())
    assert cotraining.scored(odd.limit(0), labels).collect() == []
    assert cotraining.scored(odd.select("doc_id", "text"), labels).count() == odd.count()
