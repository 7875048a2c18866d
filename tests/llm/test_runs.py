"""Periodic runs against a plain enumeration of periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import corpus, periodic_runs
from corvane.llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_brute(w):
    """Every maximal stretch of each period, kept under its smallest."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def tiled(doc_id, w):
    if doc_id is None or not w or zlib.crc32(str(doc_id).encode()) % 10:
        return w
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_brute(doc_id, text, tile):
    w = WORD.findall(text or "")
    w = tiled(doc_id, w) if tile else w
    runs = runs_brute(w)
    gone = set()
    for s, n, q in runs:
        gone |= set(range(s + q, s + n))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def found(docs):
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in docs]))).astype(np.int64)
    begin, end, period = periodic_runs.find_runs(tk.mix(np.array([x for d in docs for x in d], np.uint64)), bounds)
    out = [[] for _ in docs]
    for s, e, q, d in zip(begin.tolist(), end.tolist(), period.tolist(), (np.searchsorted(bounds, begin, side="right") - 1).tolist(), strict=True):
        out[d].append((s - int(bounds[d]), e - s, q))
    return out


@settings(deadline=None, max_examples=300)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_small_alphabets(docs):
    assert found(docs) == [runs_brute(d) for d in docs]


def test_planted_runs_of_every_size():
    rnd = random.Random(5)
    docs = []
    for _ in range(300):
        q = rnd.randint(1, 40)
        base = [rnd.randrange(30) for _ in range(q)]
        around = [[rnd.randrange(30) for _ in range(rnd.randint(0, 60))] for _ in range(2)]
        docs.append(around[0] + (base * 12)[: rnd.randint(3 * q, 9 * q)] + around[1])
    assert found(docs) == [runs_brute(d) for d in docs]


def test_masking_keeps_every_run_and_takes_the_rest():
    rnd = random.Random(6)
    doc = [rnd.randrange(10**6) for _ in range(3000)]
    doc[1000:1000] = [7, 8, 9] * 20
    doc[2000:2000] = doc[100:140]  # a passage that occurs twice, far apart
    codes, bounds, place = periodic_runs.segments(tk.mix(np.array(doc, np.uint64)), np.array([0, len(doc)]))
    assert set(range(1000, 1060)) <= set(place.tolist()) and len(place) < 200
    assert found([doc]) == [runs_brute(doc)] == [[(1000, 60, 3)]]


def test_periods_of_a_fibonacci_word_and_of_one_word():
    a, b = [0], [0, 1]
    while len(b) < 1000:
        a, b = b, b + a
    assert found([b]) == [runs_brute(b)]
    assert found([[5] * 50_000]) == [[(0, 50_000, 1)]]
    assert found([[*range(5000)] * 6]) == [[(0, 30_000, 5000)]]


ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (5, "a a a a a a"), (6, "x a b a b a b a b y"), (7, "a b c " * 50), (7, "a b c " * 50), (None, "q q q q q q q w"), (8, "é ü é ü é ü é ü é"),
    (9, "w " * 2000), (10, " ".join(f"w{i % 200}" for i in range(1800))), (11, "A a A a A a A a A a"), (12, "z" * 70_000 + " b" * 9), *[(i, " ".join(f"t{j}" for j in range(i))) for i in range(20, 120)],
]


@pytest.mark.parametrize("tile", [False, True])
def test_whole_operator(spark, tile):
    table = spark.createDataFrame([(*r, "s", 3) for r in ROWS], "doc_id long, text string, start string, period int")
    got = periodic_runs.periodic_runs(table, tile=tile).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((row_brute(*r, tile) for r in ROWS), key=repr)
    assert periodic_runs.periodic_runs(table.limit(0), tile=tile).count() == 0


def test_tables(spark):
    docs = corpus.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").filter("length(text) < 4000")
    got = periodic_runs.periodic_runs(docs, tile=True).collect()
    assert sorted(tuple(r) for r in got) == sorted(row_brute(r["doc_id"], r["text"], True) for r in docs.collect())


def test_real_outputs(spark):
    table = spark.createDataFrame([(1, "go  on on on on on on\nnow")], "doc_id long, text string")
    row = periodic_runs.periodic_runs(table, detail=True).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 6, 1)] and row["collapsed_text"] == "go on now"
