"""The pipeline's stages take effect and keep the columns of documents; the whole against a plain version of it."""

import random

import corpus_pipeline
import pyarrow as pa
from corvane.llm import corpus, decontaminate, pii, quality
from test_llm import join_brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_versions(spark):
    docs = corpus.table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)

    voters = quality.fit_voters(docs, corpus.table(spark, SF, "labels"), corpus.id_crc("doc_id", 3) != 1)
    good = corpus.written(steps["quality"](spark, docs, SF), "a")
    assert good.columns == COLUMNS
    score = dict(zip(rows, voters.score(pa.array(list(rows.values()))), strict=True))
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {d for d in rows if score[d] >= 0.5}

    single = corpus.written(steps["near_duplicates"](spark, good, SF), "b")
    label = join_brute([(d, rows[d]) for d in sorted(kept)], 5, 80)
    kept = {r["doc_id"] for r in single.collect()}
    assert single.columns == COLUMNS and kept == {d for d, n, c in label if c == d or n == 0}

    clean = corpus.written(steps["decontamination"](spark, single, SF), "c")
    index = next(decontaminate.indexes(corpus.table(spark, SF, "benchmark")))
    order = sorted(kept)
    leaked = {order[i] for i, *_ in index.match(pa.array([rows[d] for d in order]))}
    assert {r["doc_id"] for r in clean.collect()} == kept - leaked

    safe = corpus.written(steps["personal_data"](spark, clean, SF), "d")
    weights = pii.train(pii.training_sentences())
    for r in safe.collect():
        assert r["text"] == pii.masked(rows[r["doc_id"]], weights) and r["n_chars"] == len(r["text"])

    packed = steps["packing"](spark, safe, SF)
    assert {r["doc_id"] for r in packed.collect()} == kept - leaked
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))


def test_texts_that_stay_do_not_move(spark, monkeypatch):
    """The list of duplicates meets only rows that it may hold."""
    docs = corpus.table(spark, SF, "documents")
    met, join = [], type(docs).join

    def counted(self, other, on=None, how=None):
        if how == "left_anti" and "text" in self.columns:
            met.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(type(docs), "join", counted)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).count()
    assert len(met) == 1 and docs.count() - kept <= met[0] < docs.count() / 2


def test_repeated_and_missing_ids(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (1, text), (3, text), (None, text), (None, text), (5, other), (5, other), (5, other + " x"), (6, "a b"), (7, None), (7, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()]
    assert sorted(d or 0 for d, _ in found) == [0, 0, 1, 5, 6, 7]
    assert {t or "" for d, t in found if d is None} == {text, ""}


def test_stages_take_edge_rows(spark):
    rnd = random.Random(1)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text", "en", "s", 9), (4, " ".join(rnd.choices("abcdefgh", k=300)), "en", "s", 599)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus.written(stage(spark, docs, SF), "edge")
        assert docs.columns == COLUMNS
    assert {r["doc_id"] for r in docs.collect()} >= {1, 2, None}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus.written(stage(spark, empty, SF), "empty")
        assert empty.count() == 0
