import random
import re
from itertools import combinations

import pytest

from telemill.llm import decontaminate, ngram_join
from telemill.llm.graph import components
from telemill.llm.ngram_join import Join


def sets_of(rows, n):
    out = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        out[doc_id] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    return out


def brute(sets, percent):
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d in sets}


def families(seed):
    """Texts and their copies with a few words changed, in chains whose ends are unlike."""
    pick, rows = random.Random(seed), []
    for _ in range(12):
        words = [f"w{pick.randrange(4000)}" for _ in range(pick.choice([2, 6, 40, 150, 1500]))]
        for _ in range(pick.randrange(1, 9)):
            rows.append((len(rows) + 10, pick.choice([" ", "\n", "  "]).join(words)))
            words = list(words)
            for _ in range(pick.randrange(0, 4)):
                words[pick.randrange(len(words))] = f"v{pick.randrange(4000)}"
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_join_is_brute_force(spark, words, percent):
    rows = families(words)
    sets = sets_of(rows, words)
    want = brute(sets, percent)
    have = Join(words, percent).clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in have} == {d: (len(sets[d]), want[d]) for d in sets}
    assert len(set(want.values())) < len(want)


def test_join_odd_rows(spark, odd):
    have = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in Join(3, 90).clusters(odd).collect())
    assert [(d, c) for d, _, c in have] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (6, 6), (7, 7), (8, 8)]
    assert [n for d, n, _ in have if d in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert Join(3, 90).clusters(odd.limit(0)).collect() == []


def test_join_links_all_texts_of_one_id(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "p q r s t"), (3, "p q r s t"), (4, "else")]
    have = Join(3, 90).clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in have) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def brute_links(rows, words, percent):
    """Other documents that each one is similar to by any of its texts."""
    sets, links = [(d, sets_of([(d, t)], words)[d]) for d, t in rows], {d: set() for d, _ in rows}
    for a, s in sets:
        for b, t in sets:
            if a != b and s & t and 100 * len(s & t) >= percent * len(s | t):
                links[a].add(b)
    return links


@pytest.mark.parametrize(("words", "percent", "group"), [(3, 90, 1000), (1, 60, 3)])
def test_every_link_is_found(spark, monkeypatch, words, percent, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rows = families(words)
    base = [f"u{k}" for k in range(60)]
    rows += [(500 + k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(0, 60, 3)]  # all similar, all different
    # ids with several texts, one of them first in two classes
    rows += [(1, rows[0][1]), (1, rows[9][1]), (2, "p q r s t"), (2, "t u v w x"), (3, "p q r s t"), (4, "t u v w x"), (5, rows[-4][1]), (5, rows[-2][1]), (6, None), (7, "")]
    want = brute_links(rows, words, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    members, pairs = Join(words, percent).pairs(docs)
    held = {}
    for r in members.collect():
        held.setdefault(r["class"], set()).add(r["doc_id"])
    have = {d: set() for d in want}
    for a, b in [(c, c) for c in held] + [tuple(r) for r in pairs.select("a", "b").collect()]:
        for x, y in ((x, y) for x in held[a] for y in held[b] if x != y):
            have[x].add(y)
            have[y].add(x)
    assert have == want
    found = Join(words, percent).linked(docs).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in found) == sorted((d, len(want[d])) for d, _ in rows)
    same = {r["doc_id"]: r["component_id"] for r in Join(words, percent).clusters(docs).collect()}
    assert {r["doc_id"]: r["component_id"] for r in found} == same


def test_links_of_odd_rows(spark, odd):
    have = Join(3, 90).linked(odd)
    assert have.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    rows = have.collect()
    assert len(rows) == odd.count() and all(r["n_links"] == 0 and r["component_id"] == r["doc_id"] for r in rows)
    assert Join(3, 90).linked(odd.limit(0)).collect() == []


def test_components_of_chains_and_hubs(spark):
    pick = random.Random(5)
    names = pick.sample(range(10_000), 600)
    edges = list(zip(names[:199], names[1:200])) + [(names[200], n) for n in names[201:400]] + [(n, n) for n in names[400:410]] + [(None, 5), (names[0], names[1])]
    edges += [(names[500], names[501]), (names[501], names[500])]
    have = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: min(g) for g in (names[:200], names[200:400], names[500:502]) for n in g}
    assert have == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_leaks(docs, items):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = {}
    for doc_id, text in docs:
        words = split(text)
        for item_id, item in items:
            own = split(item)
            if not own:
                continue
            width = min(len(own), decontaminate.WINDOW)
            for shift in range(-len(own) + 1, len(words)):
                same = [0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(own)]
                best = max((sum(same[s : s + width]), -s) for s in range(len(own) - width + 1))
                if best[0] * 100 >= width * decontaminate.AGREE:
                    key = (best[0], -(shift - best[1]))
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), key), key)
    return {(*k, v[0], -v[1]) for k, v in found.items()}


def test_leaks_are_brute_force(spark):
    pick = random.Random(3)
    word = lambda: f"w{pick.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(pick.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 15, 25, 60])))) for k in range(24)]
    docs = []
    for k in range(60):
        words = [word() for _ in range(pick.randrange(0, 60))]
        item = pick.choice(items)[1].split()
        for _ in range(pick.randrange(0, 7)):
            item[pick.randrange(len(item))] = "other"
        docs.append((k, ", ".join(words[:20] + (item[: pick.randrange(5, 61)] if k % 3 else []) + words[20:]).title()))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1])]
    items += [(50, None), (51, "")]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"], r["agreeing"], r["start"]) for r in found.collect()} == want
    assert len(want) > 20


def test_items_of_all_sizes_are_found_with_any_fifth_of_the_words_replaced(spark):
    items, docs = [], []
    for size in range(1, decontaminate.WINDOW + 1):
        item = [f"i{size}w{k}" for k in range(size)]
        items.append((size, " ".join(item)))
        for places in combinations(range(size), size - -(-size * decontaminate.AGREE // 100)):
            docs.append((len(docs), size, " ".join("other" if k in places else w for k, w in enumerate(item))))
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, size long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(d, size) for d, size, _ in docs}


def test_short_phrases_do_not_remove_documents(spark):
    docs = spark.createDataFrame([(1, "it is yes or no"), (2, "take one two three four five now"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Yes"), (8, "one two three four five"), (9, "one two three")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, items).collect()} == {(1, 7), (2, 8), (2, 9)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [1, 3]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items, least=1).collect()] == [3]


def test_cleaning_keeps_columns_of_any_name(spark):
    names = ["uid", "own", "_uid", "key", "h", "mask", "at", "i", "item", "shift", "item_id", "a.b"]
    docs = spark.createDataFrame([(1, "one two three four five", *names), (2, "else", *names)], ["doc_id", "text", *names])
    items = spark.createDataFrame([(8, "one two three four five")], "item_id long, text string")
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "else", *names)]


def test_leaks_of_odd_rows(spark, odd, benchmark_table):
    assert decontaminate.overlaps(odd, benchmark_table).collect() == []
    assert decontaminate.overlaps(odd.limit(0), benchmark_table).collect() == []
    assert decontaminate.overlaps(odd, benchmark_table.limit(0)).collect() == []
    own = odd.where("doc_id = 6").selectExpr("1 as item_id", "text", "doc_id as uid")
    left = decontaminate.clean(odd, own)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_planted_passages_are_found(spark, documents, benchmark_table):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    items = {r["item_id"]: r["text"] for r in benchmark_table.collect()}
    planted = {(d, i) for d, t in texts.items() for i, p in items.items() if p in t}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(documents, benchmark_table).collect()}
    assert planted and planted <= found
