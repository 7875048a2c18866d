"""Ranked search against scoring every document, and the reordering's own promises."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import ranked_search
from corvane.llm.ranked_search import Search, bisect, fit_tree, query_blocks, route, shards_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=50):
    words = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, total = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked[i] = min(asked.get(i, t), t)
    out = []
    for item, text in asked.items():
        found = []
        for d, w in words:
            m, score = 50 + (50 * len(w) * n_docs) // total, 0
            for t in set(terms(text)) & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, d is None, d, score))
        out += [(item, k + 1, d, s) for k, (_, _, d, s) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out)


def searched(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, row int, cluster string")
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, score int")
    return sorted(tuple(r) for r in ranked_search.ranked_search(d, q, **options).collect())


DOCS = [
    (1, None), (2, ""), (3, " .,;"), (4, "one two"), (5, "ONE Two"), (6, "one_two-one"), (7, "été 中文 one"), (7, "one"), (None, "one two"), (8, "x" * 70_000 + " two"), (9, "three " * 5000 + "one"), (10, "İ one é"), (11, "a\x00b one"),
]
ITEMS = [(1, "One, two!"), (2, None), (3, ""), (4, "nothing here"), (5, "ÉTÉ été 中文"), (6, "one one one"), (7, "zzz"), (7, "b two"), (None, "one"), (8, "three i İ")]


def test_edges(spark):
    assert searched(spark, DOCS, ITEMS) == plain(DOCS, ITEMS)
    assert searched(spark, [], ITEMS) == [] and searched(spark, DOCS, []) == [] and searched(spark, DOCS[:3], ITEMS) == []


@pytest.fixture()
def small(monkeypatch):
    for name, value in (("GROUP_DOCS", 64), ("SHARD_DOCS", 8), ("SAMPLE_DOCS", 100)):
        monkeypatch.setattr(ranked_search, name, value)


def corpus_of(seed, n):
    """Documents of a few topics, with copies that tie."""
    rnd = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(60)] for k in range(6)]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.3:
            out.append((i, rnd.choice(out)[1]))
        else:
            out.append((i, " ".join(rnd.choices(rnd.choice(topics) + ["the", "of", "and"] * 5, k=rnd.randint(1, 60)))))
    rnd.shuffle(out)
    return out


def test_topics_ties_and_blocks(spark, small, monkeypatch):
    docs = corpus_of(3, 1200)
    items = [(i, " ".join(random.Random(i).choices(docs, k=1)[0][1].split()[:12])) for i in range(40)]
    want = plain(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, top=3) == plain(docs, items, 3)
    monkeypatch.setattr(ranked_search, "MAX_QUERIES", 15)
    assert searched(spark, docs, items) == want
    # a third of all rows is one text
    hot = docs + [(5000 + i, docs[0][1]) for i in range(600)]
    assert searched(spark, hot, items) == plain(hot, items)


def postings(seed, n=600):
    rnd = random.Random(seed)
    topic = [rnd.randrange(4) for _ in range(n)]
    own = [np.unique([50 * t + rnd.randrange(50) for _ in range(12)] + [200 + rnd.randrange(5)]) for t in topic]
    begin = np.concatenate(([0], np.cumsum([len(x) for x in own])))
    return np.array(topic), np.concatenate(own), begin


def test_bisection_finds_topics():
    topic, term, begin = postings(1)
    node = np.zeros(len(topic), np.int64)
    for level in range(2):
        side = bisect(term, begin, node, 1 << level)
        size = np.bincount(node * 2 + side, minlength=2 << level)
        assert size.max() - size.min() <= 1 + level  # halves
        node = node * 2 + side
    purity = sum(np.bincount(topic[node == k]).max() for k in range(4)) / len(topic)
    assert purity > 0.9
    levels = fit_tree(term, begin, 2, 205)
    other, term, begin = postings(2)
    routed = route(levels, term, begin, np.arange(len(other)))
    assert sum(np.bincount(other[routed == k]).max() for k in set(routed.tolist())) / len(other) > 0.9


def test_search_stops_early_and_exactly(spark):
    topic, term, begin = postings(4, 4000)
    n = len(topic)
    table = pa.table({
        "row": np.arange(n), "doc_id": np.arange(n), "n": np.full(n, 13), "terms": ranked_search._lists(term, begin, pa.int32()),
        "tfs": ranked_search._lists(np.ones(len(term), np.int64), begin, pa.int64()),
    })
    weight = ranked_search.weights(n, np.bincount(term, minlength=205))
    index = shards_of(table, weight, n, 13 * n, 64)
    assert sorted(x for r in index.column("docs").to_pylist() for x in r) == list(range(n))
    asked = spark.createDataFrame([(1, "a b"), (2, "c d e")], "item_id long, text string")
    queries = next(query_blocks(asked))
    queries.vocabulary, queries.terms = np.arange(205, dtype=np.uint64), [np.array([3, 7, 11, 19, 23]), np.array([60, 64, 71, 203])]
    found = Search(queries, 10)
    found.add(index)
    assert found.visits < index.num_rows  # of two queries over all shards
    dense = np.zeros((n, 205), np.int64)
    dense[np.repeat(np.arange(n), np.diff(begin)), term] = ranked_search.impacts(np.ones(len(term), np.int64), weight[term], np.full(len(term), 13), n, 13 * n)
    rows = found.rows().to_pylist()
    for item, own in zip(queries.ids, queries.terms, strict=True):
        score = dense[:, own].sum(axis=1)
        order = np.lexsort((np.arange(n), -score))[:10]
        assert [(r["doc_id"], r["score"]) for r in rows if r["item_id"] == item] == [(int(d), int(score[d])) for d in order if score[d] > 0]
