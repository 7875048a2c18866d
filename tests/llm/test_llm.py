"""The llm operators against brute-force versions, held-out accuracy and edge tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import duck, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import corpus, decontaminate, language, ngram_join, packing, pii, quality, queries, secret_scan, substring_dedup, textkit, token_files, tokens, topk

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EDGE = [
    (1, None, None, None), (2, "", "en", "s"), (3, "   \n", "en", None), (4, "one", "en", "s"), (5, "ONE", None, "s"), (6, "a b", "fr", "s"),
    (7, " ".join(f"w{i}" for i in range(400)), "en", "s"), (8, " ".join(f"w{i}" for i in range(400)), "en", "s"), (9, " ".join(f"w{i}" for i in range(399)) + " x", "en", "s"),
    (10, "z" * 70_000 + " end", "en", "s"), (None, " ".join(f"w{i}" for i in range(400)), "en", "s"), (12, "été 中文 😀 İ", "xx", "s"), (12, "été 中文 😀 İ", "xx", "s"), (13, "1234 !!", "en", "s"),
]


def table(spark, rows):
    """documents with clashing extra columns."""
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, lang string, source string, batch int, shard string")


def dedup_brute(rows):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, 1 << 63), 1 << 63 if d is None else d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < (1 << 63 if d is None else d):
                gone[p : p + 13] = [True] * 13
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def join_brute(rows, k=3, threshold=90):
    """(shingles, component) of each row in order: links between rows of any two ids, rows of one id being one node."""
    sets = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    links = []
    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            both = len(s & u)
            if both and 100 * both >= threshold * len(s | u):
                links.append((a, b))
    label = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return [(d, len(s), label[d]) for d, s in sets]


def joined(spark, rows, *options):
    found = ngram_join.ngram_join(table(spark, [(d, t, "en", "s") for d, t in rows]), *options).collect()
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found)


def passages(seed, n=60):
    """Random documents that share passages, copies and near copies."""
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    shared = [" ".join(rnd.choices(vocabulary, k=rnd.randint(10, 60))) for _ in range(6)]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.3:
            w = rnd.choice(out)[1].split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            text = " ".join(w)
        else:
            text = " ".join([*rnd.choices(vocabulary, k=rnd.randint(5, 200)), rnd.choice(shared), *rnd.choices(vocabulary, k=9)])
        out.append((i, text))
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name], duck(SF))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0


def test_words_and_hashes():
    texts = ["a b\tc", None, "", " x ", "a" * 70_000 + " b", "b é"]
    buf, offsets = textkit.text_buffer(pa.array(texts))
    starts, ends, words = textkit.word_spans(buf, offsets)
    found = [[bytes(buf[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(words[:-1], words[1:], strict=True)]
    assert found == [WORD.findall(t or "") for t in texts]
    hashes = textkit.word_hashes(buf, starts, ends)
    flat = [w for ws in found for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat))


@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 13))
def test_rolling_hash_tells_windows_apart(values, n):
    h = textkit.mix(np.array(values, np.uint64))
    r = textkit.rolling(h, n)
    assert len(r) == max(0, len(values) - n + 1)
    assert len(set(r.tolist())) == len({tuple(values[i : i + n]) for i in range(len(r))})


@given(st.lists(st.integers(0, 2**48 - 1), unique=True))
def test_packed_numbers(values):
    v = np.array(sorted(values), np.uint64)
    first, width, payload = textkit.pack_sorted(v)
    assert (textkit.unpack_sorted(first, width, payload, len(v)) == v).all()


@pytest.mark.parametrize("rows", [EDGE, [(d, t, "en", "s") for d, t in passages(1)]], ids=["edge", "passages"])
def test_substring_dedup(spark, rows):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(table(spark, rows)).collect()), key=repr)
    assert got == dedup_brute([r[:2] for r in rows])


def test_substring_dedup_texts(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(40)), None, None), (2, "a " + " ".join(f"w{i}" for i in range(5, 30)) + " b", None, None)]
    got = {r["doc_id"]: (r["kept_text"], r["n_repeats"]) for r in substring_dedup.substring_dedup(table(spark, rows), with_text=True).collect()}
    assert got[2] == ("a b", 1) and got[1][1] == 0


@pytest.mark.parametrize(("seed", "k", "threshold"), [(2, 3, 90), (3, 3, 90), (4, 5, 80), (5, 2, 50)])
def test_ngram_join(spark, seed, k, threshold):
    rows = passages(seed, 80)
    assert joined(spark, rows, k, threshold) == sorted(join_brute(rows, k, threshold))


def test_ngram_join_chain_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):  # each differs from the next by one word: ends of the chain share little
        base[3 * i % 120] = f"x{i}"
        rows.append((i, " ".join(base)))
    assert joined(spark, rows) == sorted(join_brute(rows))


@pytest.mark.parametrize("small_cells", [False, True])
def test_ngram_join_hot_bucket(spark, monkeypatch, small_cells):
    """Near copies of one text around the threshold, a star around it, and a passage in many other documents."""
    if small_cells:
        for name, value in (("CELL_ROWS", 16), ("CELL_BYTES", 20_000), ("_EXPAND", 500), ("CLOSEST", 1)):
            monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(200)] = f"x{rnd.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join([*(f"y{rnd.randrange(10_000)}" for _ in range(12)), *base[:60]])) for i in range(200, 260)]
    assert joined(spark, rows, 5, 80) == sorted(join_brute(rows, 5, 80))


def test_ngram_join_repeated_ids(spark):
    a, b, c = "a b c d e f g h", "a b c q r s t", "x y z"
    rows = [(1, a), (5, a), (5, b), (2, b), (9, b), (7, ""), (7, c), (3, c), (8, None), (8, "x y z"), (4, ""), (6, "u v"), (6, "u v")]
    assert joined(spark, rows) == sorted(join_brute(rows))
    assert {d: c for d, _, c in joined(spark, rows)} == {1: 1, 5: 1, 2: 1, 9: 1, 7: 3, 3: 3, 8: 3, 4: 4, 6: 6}


def test_ngram_join_edges(spark):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(table(spark, EDGE)).collect()), key=repr)
    assert [x for x in got if x[0] is not None] == sorted(join_brute([r[:2] for r in EDGE if r[0] is not None]), key=repr)
    assert [x for x in got if x[0] is None] == [(None, 398, None)]


def test_rows_without_id_spread_over_batches(spark):
    rows = [(None, " ".join(f"w{i % 7} u{i} v{j}" for j in range(20)), None, None) for i in range(400)] + [(3, " ".join(f"w{i % 7} u{i} v{j}" for i in range(40) for j in range(3)), None, None)]
    docs = table(spark, rows)
    assert docs.select(corpus.batch_key(16).alias("b")).groupBy("b").count().agg({"count": "max"}).first()[0] < 60
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs).collect()), key=repr)
    assert got == dedup_brute([r[:2] for r in rows])


def test_empty_tables(spark):
    empty = table(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for found in (
        substring_dedup.substring_dedup(empty), ngram_join.ngram_join(empty), decontaminate.leaks(empty, items), language.identify(empty), token_files.token_output(empty, path), pii.find_pii(empty),
        secret_scan.find_secrets(empty, path), packing.pack(empty, path), quality.classify(empty, labels), topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert found.count() == 0


def test_decontamination_finds_edited_items(spark):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(12, 60)))) for i in range(50)]
    rows, truth = [], {}
    for i, text in items:
        for share in (0.0, 0.1, 0.2):
            w = text.split()
            for _ in range(int(share * len(w))):
                p, what = rnd.randrange(len(w)), rnd.random()
                if what < 0.4:
                    w[p] = rnd.choice(vocabulary)
                elif what < 0.7:
                    del w[p]
                else:
                    w.insert(p, rnd.choice(vocabulary))
            truth[len(rows)] = i
            rows.append((len(rows), " ".join([*rnd.choices(vocabulary, k=30), *w, *rnd.choices(vocabulary, k=30)]), None, None))
    clean = [(1000 + i, " ".join(rnd.choices(vocabulary, k=200)), None, None) for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(table(spark, rows + clean), bench).collect()
    hit = {r["doc_id"]: r["item_id"] for r in found}
    assert np.mean([hit.get(d) == i for d, i in truth.items()]) >= 0.97
    assert all(hit.get(d) == i for d, i in truth.items() if d % 3 == 0)
    assert not any(d >= 1000 for d in hit)
    assert {r[0] for r in clean} <= {r["doc_id"] for r in decontaminate.without_leaks(table(spark, rows + clean), bench).collect()}


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "one", 5), (4, "w1 w2 w3 w4", 5), (4, "w1 w2 w3 w4", 5), (None, "a b", 5)], "item_id long, text string, doc_id int")
    found = {(r["doc_id"], r["item_id"], r["start_word"], r["distance"]) for r in decontaminate.leaks(table(spark, EDGE), items).collect()}
    assert found == {(4, 3, 0, 0), (5, 3, 0, 0), *((d, 4, 1, 0) for d in (7, 8, 9, None))}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 3), max_size=12))
def test_locate_is_the_smallest_edit_distance(item, region):
    d, a, b = decontaminate.locate(np.array(item, np.uint64), np.array(region, np.uint64))
    assert d == min(edits(item, region[i:j]) for i in range(len(region) + 1) for j in range(i, len(region) + 1))
    assert edits(item, region[a:b]) == d


def nearby(rnd, words, count, vocabulary):
    w = list(words)
    for _ in range(count):
        p, what = rnd.randrange(len(w)), rnd.random()
        if what < 0.4:
            w[p] = rnd.choice(vocabulary)
        elif what < 0.7 and len(w) > 1:
            del w[p]
        else:
            w.insert(p, rnd.choice(vocabulary))
    return w


def test_decontamination_against_all_windows():
    """Every run of every document within the limit of every item, by plain edit distance."""
    rnd = random.Random(11)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [rnd.choices(vocabulary, k=rnd.randint(1, 18)) for _ in range(25)]
    items += [[*items[0][:6], *rnd.choices(vocabulary, k=9)] for _ in range(5)]  # a shared header
    docs = [[*rnd.choices(vocabulary, k=rnd.randint(0, 20)), *nearby(rnd, x, rnd.randint(0, len(x) // 4), vocabulary), *rnd.choices(vocabulary, k=rnd.randint(0, 20))] for x in items * 2]
    _, hashes = decontaminate._hashed_words(pa.array([" ".join(x) for x in items]))
    bounds = np.cumsum([0, *map(len, items)])
    index = decontaminate.Index(list(range(len(items))), [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    got = {(d, i): k for d, i, _, _, k in index.match(pa.array([" ".join(x) for x in docs]))}
    want = {}
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            k = min(edits(item, words[a : a + n]) for n in range(max(1, len(item) - 4), len(item) + 5) for a in range(max(1, len(words) - n + 1)))
            if k <= len(item) * 20 // 100:
                want[d, i] = k
    assert set(got) <= set(want) and len(want) > 60
    assert len(set(got) & set(want)) >= 0.97 * len(want)
    assert all(got[x] >= want[x] for x in got) and np.mean([got[x] == want[x] for x in got]) >= 0.97


def test_sampling_reaches_its_recall():
    """AGREE and the recall of the sampled keys alone, on windows at the largest allowed distance."""
    rnd = random.Random(12)
    hit, agree, total = 0, [], 0
    for _ in range(150):
        n = rnd.randint(15, 60)
        item = [rnd.getrandbits(63) for _ in range(n)]
        window = nearby(rnd, item, n * 20 // 100, [rnd.getrandbits(63) for _ in range(500)])[:n]
        rows = np.zeros((2, n), np.uint64)
        rows[0], rows[1, : len(window)] = item, window
        sizes = np.array([n, n])
        every = np.stack([np.full((2, 4), p) for p in range(3 * n)])[..., None]
        signs = np.array([decontaminate.embed(rows, np.broadcast_to(x, (2, 4, 1)), 4) for x in every])
        agree.append(np.mean(signs[:, 0] == signs[:, 1]))
        keys = decontaminate.embed(rows, decontaminate.sample_places(sizes, decontaminate.REPEATS, decontaminate.SAMPLES), decontaminate.REPEATS)
        hit, total = hit + bool((keys[0] == keys[1]).any()), total + 1
    assert np.mean(agree) >= decontaminate.AGREE
    assert hit / total >= 0.95


def test_decontamination_with_a_shared_header_and_long_items():
    rnd = random.Random(13)
    vocabulary = [f"v{i}" for i in range(9000)]
    header = rnd.choices(vocabulary, k=14)
    items = [[*header, *rnd.choices(vocabulary, k=26)] for _ in range(4000)] + [rnd.choices(vocabulary, k=3000)]
    _, hashes = decontaminate._hashed_words(pa.array([" ".join(x) for x in items]))
    bounds = np.cumsum([0, *map(len, items)])
    begun = time.process_time()
    index = decontaminate.Index(list(range(len(items))), [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    texts = [" ".join(header * 300), " ".join([*header * 5, *items[7], *header]), " ".join(["x", *nearby(rnd, items[-1], 300, vocabulary)])]
    assert [(d, i) for d, i, *_ in index.match(pa.array(texts))] == [(1, 7), (2, 4000)]
    assert time.process_time() - begun < 40


def test_language(spark):
    docs = corpus.table(spark, "/root/testdata/sf0.01", "documents")
    found = language.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.98
    assert held.held_out.equals(held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0))
    edge = {r["doc_id"]: r for r in language.identify(table(spark, EDGE)).collect()}
    assert len(edge) == 13 and all(edge[d]["lang_pred"] == "und" and edge[d]["score"] == 0 for d in (1, 2, 3, 13))
    assert all(0 <= r["score"] <= 1 for r in edge.values())


@settings(deadline=None)
@given(st.text(alphabet="abé1 .\n", max_size=40), st.sampled_from([1, 2, 3, 1 << 18]))
def test_grams_are_all_grams(text, piece):
    """Every 1 to 3 places of letters, each run of other characters being one place, against a plain count."""
    want = Counter()
    marked = "\0" + re.sub(r"[^abé]+", "\0", text.strip("1 .\n")) + "\0" if text.strip("1 .\n") else ""
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            gram = marked[i : i + n]
            if gram.strip("\0") and not (n == 3 and gram[1] == "\0"):
                want[(n, gram)] += 1
    language.PIECE, before = piece, language.PIECE
    try:
        keys, counts = language.grams(text)
    finally:
        language.PIECE = before
    assert sorted(counts.tolist()) == sorted(want.values()) and len(set(keys.tolist())) == len(keys)


def test_language_against_plain_distances():
    texts = [("en", "the cat and the dog sat on the mat"), ("de", "der hund und die katze sassen auf der matte"), ("fr", "le chat et le chien sont sur le tapis")]
    profiles = language.Profiles(texts * 2, 40)
    for _, text in texts:
        for probe in (text, text[:9], "zzz qqq", "tt"):
            own = language.ranked(*language.grams(probe), 40).tolist()
            apart = []
            for name in profiles.names:
                keys, counts = language.grams(next(t for lang, t in texts if lang == name))
                ranks = {k: i for i, k in enumerate(language.ranked(keys, 2 * counts, 40).tolist())}
                apart.append(sum(abs(ranks[k] - i) if k in ranks else 40 for i, k in enumerate(own)))
            assert profiles.distances(probe)[0].tolist() == apart
            assert profiles.predict(probe)[0] == profiles.names[apart.index(min(apart))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "é", "\u0301", "'s", "1", ".", "\x85", "\u2003", "\x1c", "😀", "|", " |", "<|endoftext|>", "<|startoftext|>", "<|", "endoftext|>", "İ"]), max_size=12).map("".join), max_size=6))
def test_ids_are_the_library_s(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        ids, bounds = tokens.encoder(path).encode(pa.array([*texts, None], pa.string()), 2)
        want = [[*x.ids, 2] for x in library.encode_batch([*texts, ""], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_ids_of_texts_whose_hashes_collide(monkeypatch):
    texts = ["a bb ccc", "bb a", "ccc <|endoftext|> a<|startoftext|>bb"]
    monkeypatch.setattr(textkit, "word_hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        own = tokens.Encoder(public_tokenizers.path(name))
        for _ in range(2):
            ids, bounds = own.encode(pa.array(texts), 2)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*x.ids, 2] for x in own.library.encode_batch(texts, add_special_tokens=False)]


def thue_morse(n):
    """Two words of 2**n letters that any sum of letters times powers of an odd number takes for equal, if n is large."""
    a = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[x] for x in a), "".join("ba"[x] for x in a)


def test_words_that_a_polynomial_takes_for_equal(spark):
    x, y = thue_morse(11)
    for n in (3, 11, 13):
        buf, offsets = textkit.text_buffer(pa.array(thue_morse(n)))
        assert len(set(textkit.word_hashes(buf, *textkit.word_spans(buf, offsets)[:2]).tolist())) == 2
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*words, x]), None, None), (2, " ".join([*words, y]), None, None), (3, x, None, None), (4, y, None, None)]
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(table(spark, rows)).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert all(r["component_id"] == r["doc_id"] for r in ngram_join.ngram_join(table(spark, rows[2:])).collect())
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        own = tokens.encoder(public_tokenizers.path(name))
        ids, bounds = own.encode(pa.array([x, y]), 1)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*e.ids, 1] for e in own.library.encode_batch([x, y], add_special_tokens=False)]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_vbyte_round_trip(values):
    v = np.array(values, np.uint64).astype(np.uint32)
    payload = token_files.vbyte(v)
    back, used = token_files.unvbyte(memoryview(payload), len(v))
    assert (back == v).all() and used == len(payload)


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = corpus.scratch(spark, "files")
    token_files.write_tokens(table(spark, EDGE), path, out, block_ids=100)
    got = token_files.read_tokens(spark, out, with_ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    place, rows = 0, sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for r, (_, text, *_) in zip(got, rows, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (place, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        place += len(ids)


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, [*EDGE, (50, "word " * 5000, None, None)])
    found = packing.pack(docs, path, most=256).toPandas()
    whole = found.groupby("sequence_id").length.sum()
    assert whole.max() <= 256
    assert sorted(whole.index) == list(range(len(whole)))
    ordered = found.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    library = Tokenizer.from_file(path)
    ids = np.array([*library.encode("word " * 5000, add_special_tokens=False).ids, 1], "<u4")
    for r in found[found.doc_id == 50].itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    assert found.length.sum() == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in EDGE) + len(ids)


def places(found):
    """(piece length, rank) -> its parts, and the ids in each sequence."""
    out, filled = {}, Counter()
    sequence = 0
    for parts, n in found:
        for p in parts:
            for k in range(n):
                out.setdefault((p.piece, p.rank + k), []).append((p.skip, p.length))
                filled[sequence + k] += p.length
        sequence += n
    return out, filled


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_use_up_the_histogram(histogram):
    got, filled = places(packing.patterns(histogram, 64, 4))
    assert set(got) == {(length, rank) for length, n in histogram.items() for rank in range(n)}
    for (length, _), parts in got.items():
        at = 0
        for skip, n in sorted(parts):
            assert skip == at and skip % 4 == 0
            at += n
        assert at == length
    assert max(filled.values(), default=0) <= 64
    # three open ids a sequence at most, and a few sequences
    assert len(filled) <= sum(k * n for k, n in histogram.items()) / 61 + 3


@pytest.mark.parametrize(
    "histogram",
    [{3: 100_000}, {700: 1000}, {1025: 1000, 1024: 10}, {5: 30_000, 100: 500, 1500: 200}, {2048: 300, 1500: 700}, {1030: 10**9, 3: 7}, {1: 10**7, 2047: 10**6}, {k: 1000 for k in range(1, 40)} | {1900: 50}, {1366: 5000}, {17: 12_345}],
    ids=str,
)
def test_padding_of_plain_histograms(histogram):
    """One length, two lengths, nine tenths short: below 1 % of all ids beside four sequences."""
    found = packing.patterns(histogram)
    ids = sum(k * n for k, n in histogram.items())
    assert sum(p.length * n for parts, n in found for p in parts) == ids
    assert sum(n for _, n in found) * 2048 - ids < 0.01 * ids + 4 * 2048
    assert len(found) < 20_000


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=90), st.data())
def test_sums_of_parts(ids, data):
    view = memoryview(np.array(ids, "<u4")).cast("B")
    sums = np.frombuffer(packing.block_sums(view, 0, len(ids)), "<u4")
    skip = packing.GRID * data.draw(st.integers(0, (len(ids) - 1) // packing.GRID))
    blocks = data.draw(st.integers(1, 6))
    length = min(blocks * packing.GRID, len(ids) - skip)
    assert packing.part_sum(sums, skip, length) == zlib.crc32(view[4 * skip : 4 * (skip + length)])


def test_packing_of_equal_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "word " * 149) for i in range(500)] + [(None, None)], "doc_id long, text string")
    found = packing.pack(docs, path, most=256).toPandas()
    ids = [*Tokenizer.from_file(path).encode("word " * 149, add_special_tokens=False).ids, 1]
    view = memoryview(np.array(ids, "<u4")).cast("B")
    whole = found[found.doc_id.notna()].sort_values(["doc_id", "start"])
    assert (whole.ids_crc32 == [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(whole.start, whole.length, strict=True)]).all()
    for _, parts in whole.groupby("doc_id"):
        assert parts.start.tolist() == [0, *parts.length.cumsum().tolist()[:-1]] and parts.length.sum() == len(ids)
    ordered = found.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    assert found.groupby("sequence_id").length.sum().max() <= 256
    assert found.sequence_id.nunique() <= found.length.sum() / (256 - 15) + 4


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_brute(text):
    out = [(m.start(), m.end(), 0) for m in _EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400)
@given(st.lists(st.sampled_from(["jo", "at", "@", "[", "]", "(", ")", "dot", ".", "quta", "com", " ", "\n", " " * 12, "\t" * 30, "é"]), max_size=16).map("".join))
def test_the_trigger_opens_wherever_a_form_is(text):
    """Every spelt-out form of an address holds a sign that opens a window."""
    for form in (pii._EMAIL_FORM, pii._BRACKET_FORM, pii._BARE_FORM):
        for m in form.finditer(text):
            assert any(m.start() <= t.start() < m.end() for t in pii._TRIGGER.finditer(text))


def test_blanks_in_a_spelt_out_address():
    weights = pii.train(pii.training_sentences())
    for blank in (" ", " " * 8, " " * 12, " " * 40):
        text = f"write to jo.mi [at]{blank}quta.com"
        assert [text[a:b] for a, b, _ in pii.added_spans(text, [], weights)] == [text[9:]], len(blank)


def test_long_texts_in_pieces():
    """One long text: language counts and masking hold a bounded part of it at a time."""
    import tracemalloc

    text = "Straße ΟΔΟΣ und mehr, jo@a.com " * 200_000
    tracemalloc.start()
    language.grams(text)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20  # of one piece, whatever the length
    tracemalloc.stop()


@settings(max_examples=400)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@@", ".", "1", "25", "256.", "1.2.3.4", "+1 (555) 555-1234", "4111 1111 1111 1111", " ", "-", "é", "com", "\n", "0", "+"]), max_size=14).map("".join))
def test_base_spans_are_the_patterns_own(text):
    assert pii.base_spans(text) == base_brute(text)


def test_pii_field_on_unseen_sentences():
    weights = pii.train(pii.training_sentences())
    hit = miss = false = 0
    for text, spans in pii.training_sentences(300, seed=99):
        base = pii.base_spans(text)
        free = {s for s in spans if not any(s[0] < b and a < s[1] for a, b, _ in base)}
        got = set(pii.added_spans(text, base, weights))
        hit, miss, false = hit + len(free & got), miss + len(free - got), false + len(got - free)
    assert hit / (hit + miss) >= 0.7 and false <= 0.05 * hit


def test_pii_field_reads_every_spelt_out_at(monkeypatch):
    weights = pii.train(pii.training_sentences())
    # no digit and no at sign opens a window here
    for text, address in (
        ("write to jo.mi at quta dot com now", "jo.mi at quta dot com"),
        ("Contact jomi AT staein dot example for more", "jomi AT staein dot example"),
        ("so lomi{at}quta.com please", "lomi{at}quta.com"),
        ("so lomi [At] quta [dot] com please", "lomi [At] quta [dot] com"),
        ("so lomi ( aT ) quta.org please", "lomi ( aT ) quta.org"),
    ):
        assert [text[a:b] for a, b, _ in pii.added_spans(text, [], weights)] == [address]
        assert pii.masked(text, weights) == text.replace(address, "<EMAIL>")
    for text in ("we met at home. Then it rained", "look at the red dot in the corner", "at the end"):
        assert pii.added_spans(text, [], weights) == []
    # the windows lose nothing that the field finds in whole texts
    texts = [t for t, _ in pii.training_sentences(200, seed=41)] + [re.sub("[0-9@]", "", t) for t, _ in pii.training_sentences(200, seed=42)]
    found = [pii.added_spans(t, pii.base_spans(t), weights) for t in texts]
    monkeypatch.setattr(pii, "_TRIGGER", re.compile(r"(?s:.)"))
    assert found == [pii.added_spans(t, pii.base_spans(t), weights) for t in texts]


def test_pii_rows(spark):
    rows = [*EDGE, (60, "mail a.b@c.de or 1.2.3.4 or 4111 1111 1111 1111 or +1 (555) 555-1234", None, None), (61, "write to jo.mi (at) quta dot com now", None, None)]
    got = {r["doc_id"]: r for r in pii.find_pii(table(spark, rows)).collect()}
    assert (got[60]["n_email"], got[60]["n_ip"], got[60]["n_card"], got[60]["n_phone"]) == (1, 1, 1, 1)
    assert got[60]["spans"] == "email:5:13,ip:17:24,card:28:47,phone:51:68"
    assert got[60]["base_sha256"] == hashlib.sha256(got[60]["spans"].encode()).hexdigest()
    assert got[1]["spans"] == "" and got[12]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(table(spark, rows)).collect()}
    assert masked[60] == "mail <EMAIL> or <IP> or <CARD> or <PHONE>" and masked[1] is None


def test_secrets(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = secret_scan.dictionary(path)
    assert {"password", "river", "example"} <= words and "xqzt" not in words
    forest = secret_scan.fit(words)
    test = secret_scan.labelled_findings(400, seed=123)
    rows = np.array([secret_scan.features(t, f, words) for t, f, _ in test])
    chance = forest.probability(rows)

    def walk(tree, row, at=0):  # a plain version of the forest
        feature, threshold, left, right, share = tree
        return share[at] if feature[at] < 0 else walk(tree, row, left[at] if row[feature[at]] <= threshold[at] else right[at])

    assert np.allclose(chance, [np.mean([walk(t, r) for t in forest.trees]) for r in rows])
    assert np.mean((chance >= 0.5) == np.array([y for *_, y in test])) >= 0.97
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [*EDGE, (70, f'see token = "{key}" there', None, None), (71, f"commit {key} done", None, None), (72, "AKIA" + "ABCDEFGHIJKLMNOP", None, None)]
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(table(spark, rows), path).collect()}
    assert set(got) == {70, 72}
    assert got[70]["secret_sha256"] == hashlib.sha256(key.encode()).hexdigest()


def test_secret_prefilter_loses_nothing():
    rnd = random.Random(8)
    pieces = ["xoxb-abcdefghij", "9" + "abcdefghijklmnopqrst", "abcdefghijklmnopqrst9", "/" * 19 + "1", "AKIA" + "B" * 16, "ghp_" + "a" * 36, "AIza" + "b" * 35, "sk_live_" + "c" * 16, "eyJabcdefgh.abcdefgh.abcdefgh",
              "-----BEGIN PRIVATE KEY-----", "PWD=abcdefgh", "\u017fecret=abcdefgh", "to\u212aen: abcdefgh", "access-key := abcdefgh", "Internationalisation", "plain", "é", "0", "=", "(", "\n", " ", " "]
    texts = ["", *pieces, *("".join(rnd.choices(pieces, k=rnd.randint(1, 5))) for _ in range(3000))]
    texts += [t for t, _, _ in secret_scan.labelled_findings(1000, seed=5)]
    texts += [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist() if r]
    suspects = secret_scan._suspects(pa.array(texts))
    assert [t for t, s in zip(texts, suspects, strict=True) if not s and secret_scan.candidates(t)] == []
    assert not secret_scan._suspects(pa.array(["Internationalisation of plain words"]))[0]


def test_secret_rules_as_written():
    """Candidates by plain patterns, each later one left out where it overlaps an earlier one."""
    plain = {**dict(secret_scan._RULES), "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")}

    def brute(text):
        out = []
        for rule, pattern in plain.items():
            for m in pattern.finditer(text):
                a, b = m.span("value") if "value" in pattern.groupindex else m.span()
                if all(b <= x or y <= a for _, x, y in out):
                    out.append((rule, a, b))
        return sorted(out, key=lambda f: f[1])

    rnd = random.Random(4)
    pieces = ["eyJabcdefgh", "eyJ", "-eyJ", "x", "abcdefgh", ".", ".", ".", "..", " ", "token=", "A1" * 12, "-", "_", "\n", "xoxb-abcdefghij", "é"]
    for _ in range(4000):
        text = "".join(rnd.choices(pieces, k=rnd.randint(1, 14)))
        assert secret_scan.candidates(text) == brute(text)


def test_long_texts_take_time_in_proportion():
    forest, words = secret_scan.Forest([]), frozenset()
    begun = time.process_time()
    for text in ("-eyJabcdefgh" * 80_000, " ".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(24_000)), "-----BEGIN " * 90_000):
        list(secret_scan.scan_text(text, forest, words))
    weights = pii.train(pii.training_sentences(60))
    for text in (" " * 1_000_000, " at " * 3000, ", ".join(str(i * 7919 % 100_003) for i in range(3000)), "z" * 1_000_000):
        pii.added_spans(text, pii.base_spans(text), weights)
    language.grams("wort " * 200_000)
    assert time.process_time() - begun < 60


def test_pii_windows_agree_with_one_stretch(monkeypatch):
    weights = pii.train(pii.training_sentences())
    text = " ".join(t for t, _ in pii.training_sentences(150, seed=21))
    base = pii.base_spans(text)
    found = pii.added_spans(text, base, weights)
    assert len(found) > 30
    monkeypatch.setattr(pii, "WINDOW", 10**9)
    assert found == pii.added_spans(text, base, weights)


def test_pii_field_against_all_readings():
    """Sums and best reading of a few tokens against every segmentation."""
    weights = np.random.default_rng(3).normal(size=(pii.FEATURES, pii.OTHER + 1))
    for text in ("a@b", "1 2", "(5)"):
        cuts = pii.tokens(text, 0, len(text))
        region = pii.Region(text, cuts)
        scores = region.scores(weights)
        place = {span: s for s, span in enumerate(region.spans)}

        def readings(at, place=place, n=len(cuts)):
            if at == n:
                yield []
            for (i, j), s in place.items():
                if i == at:
                    for kind in range(pii.OTHER + 1):
                        for rest in readings(j):
                            yield [(s, kind), *rest]

        worth = [(sum(scores[s, k] for s, k in r), r) for r in readings(0) if not any(np.isneginf(scores[s, k]) for s, k in r)]
        total = np.logaddexp.reduce([w for w, _ in worth])
        chance, log_sum = region.sums(scores)
        assert np.isclose(total, log_sum)
        for s in range(len(region.spans)):
            for kind in range(pii.OTHER + 1):
                own = [w for w, r in worth if (s, kind) in r]
                assert np.isclose(np.exp(np.logaddexp.reduce(own) - total) if own else 0.0, chance[s, kind])
        assert region.best(scores) == [x for x in max(worth)[1] if x[1] != pii.OTHER]


def test_topk(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(700)]
    rows += [(700, None), (800, [1.0, None] + [0.0] * 6), (900, [float("nan")] + [0.0] * 7), (1000, rows[0][1]), (None, rows[0][1]), (1100, [float("inf")] * 8)]
    got = {}
    for r in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    assert set(got) == {0, 100, 200, 300, 400, 500, 600, 1000}
    for q, found in got.items():
        want = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:10]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_topk_skips_rows_that_cannot_win():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(20, 16)) * 3000
    rows = (centres[rnd.integers(0, 20, 5000)] + rnd.normal(size=(5000, 16)) * 20).astype(np.int64)
    radius2 = float((rows.astype(float) ** 2).sum(1).max())
    pivots = topk.choose_pivots(rows[:500], 32)
    table = topk.distances(rows, pivots, radius2)
    plain, known = (topk.Block(rows[:20], np.arange(20), pivots, radius2, 10, *sample) for sample in ((), (rows[:500], np.arange(500))))
    found, scored = plain.search(rows, np.arange(5000), table)
    assert scored < 0.6 * 20 * 5000
    for part in (slice(0, 2500), slice(2500, 5000)):  # a known k-th score prunes from the first row on, and loses nothing
        some, less = known.search(rows[part], np.arange(5000)[part], table[part])
        assert less <= scored and {f for f in found if part.start <= f[1] < part.stop} <= set(some)


def test_topk_of_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 2.0], "x"), (0, [3.0], "y"), (1, [1.0, 0.5, 4.0], "z"), (1, [2.0], "z"), (2, [], "z"), (3, [0.5, 0.5], "z")]
    got = [tuple(r) for r in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")).orderBy("rank").collect()]
    q = {0: [1024, 2048, 0]}[0]
    scores = sorted(((-sum(a * int(1024 * b) for a, b in zip(q, v, strict=False)), i) for i, v, _ in rows if i and v))
    assert got == [(0, k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_quality(spark):
    docs, labels = (corpus.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    found = quality.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() >= 0.97
    assert held.score.between(0, 1).all()
    edge = quality.classify(table(spark, EDGE), labels.filter("doc_id < 40")).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    none = quality.classify(table(spark, EDGE), labels.filter("doc_id < 0")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_votes_are_those_of_the_nearest(spark):
    """Every cosine, sorted in full, for a few texts."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    texts = [t for t in docs if t][:160]
    labels = [len(t) % 2 for t in texts]
    voters = quality.Voters(texts[:120], labels[:120], {0: 1.0, 1: 3.0})
    probe = texts[100:]
    got = voters.score(pa.array(probe))
    rows = voters._unit(voters._weighted(quality.term_counts(pa.array(probe))) @ voters.axes)
    for row, score in zip(rows, got, strict=True):
        near = sorted(((float(row @ v), i) for i, v in enumerate(voters.vectors)), reverse=True)[: voters.neighbours]
        votes = [(np.exp(voters.sharpness * (c - 1)) * (3.0 if labels[i] else 1.0), labels[i]) for c, i in near]
        assert abs(score - sum(v for v, y in votes if y) / sum(v for v, _ in votes)) < 1e-3


def test_samples_are_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7, f"l{i % 40}", "x" * (i % 90)) for i in range(4000)], "doc_id long, lang string, text string")
    few = corpus.bounded_sample(rows, "lang", "doc_id", 10, "text")
    assert few.count() <= 800 and few.select("lang").distinct().count() == 40
    assert sorted(corpus.bounded_sample(rows.repartition(3), "lang", "doc_id", 10, "text").collect()) == sorted(few.collect())
    assert corpus.bounded_sample(rows.limit(0), "lang", "doc_id", 10).count() == 0
    monkeypatch.setattr(corpus, "SAMPLE_BYTES", 500)
    assert 0 < sum(len(r["text"]) for r in corpus.bounded_texts(few, "doc_id")) <= 500
    monkeypatch.undo()
    profiles = language.fit_profiles(spark.createDataFrame([(i, f"l{i:03}", f"text {i}") for i in range(300)], "doc_id long, lang string, text string"), F.lit(True))
    assert len(profiles.names) == 300


def test_padding_is_small(spark):
    found = packing.pack(corpus.table(spark, "/root/testdata/sf0.01", "documents"), public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    whole = found.groupby("sequence_id").length.sum()
    padded = whole.map(lambda n: 0 if n & (n - 1) == 0 else 2048 - n)
    assert padded.sum() <= 0.01 * whole.sum()
