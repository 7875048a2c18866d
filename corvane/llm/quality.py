"""Operator 10, quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are words (lower-cased, hashed to WORDS places), pairs of neighbouring character
classes, and marks of repetition (a word that follows itself, a word triple met before
in the text). Weighted by tf-idf and reduced by a singular value decomposition of a bounded
labelled sample, each text is a vector of LATENT numbers; the sample's vectors, a few
hundred KB, go to every task. Every document is compared with all of them by exact
cosine products in blocks, and its NEIGHBOURS nearest vote with weights that grow with
similarity. Votes are scaled so that the bounded sample stands for all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .corpus import bounded_sample, bounded_texts, id_crc
from .tokens import slices

PER_LABEL = 1500
LATENT = 48
NEIGHBOURS = 25
SHARPNESS = 20.0
_SLICE = 4 << 20
_BLOCK = 1024

# fixed values: a class for each byte; what is not named is 29
_CLASSES = 32
_CLASS = np.full(256, 29, np.uint8)
_CLASS[32] = 0
_CLASS[9:14] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
for _i, _c in enumerate(b".,!?#$%&*|@-'\"():;/_+=<>"):
    _CLASS[_c] = 5 + _i
_CLASS[192:] = 30
_CLASS[128:192] = 31
_PAIRS = _CLASSES * _CLASSES
WORDS = 512
TERMS = _PAIRS + WORDS + 2


def term_counts(texts: pa.Array) -> np.ndarray:
    """Relative frequency of each term in each whole text (rows of zeros for empty texts)."""
    buf, offsets = tk.text_buffer(texts)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, TERMS), np.float32)
    kinds = _CLASS[buf].astype(np.int32)
    pairs = kinds[:-1] * _CLASSES + kinds[1:] if len(kinds) else kinds
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a > 1:
            out[i, :_PAIRS] = np.bincount(pairs[a : b - 1], minlength=_PAIRS)
    out /= np.maximum(sizes - 1, 1)[:, None]
    buf = tk.LOWER[buf]
    starts, ends, words = tk.word_spans(buf, offsets)
    hashes = tk.word_hashes(buf, starts, ends)
    count = np.maximum(np.diff(words), 1)
    doc = tk.doc_of(words)
    if len(hashes):
        place = (hashes % np.uint64(WORDS)).astype(np.int64)
        out[:, _PAIRS:-2] = np.bincount(doc * WORDS + place, minlength=n * WORDS).reshape(n, WORDS) / count[:, None]
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        out[:, -2] = np.bincount(doc[1:][same], minlength=n) / count
    at = tk.window_starts(words, 3)
    if len(at):
        triple, owner = tk.rolling(hashes, 3)[at], doc[at]
        bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own = np.sort(triple[a:b])
            out[i, -1] = np.count_nonzero(own[1:] == own[:-1]) / count[i]
    return out


class Voters:
    """The latent space and its labelled vectors."""

    def __init__(self, texts: list[str], labels: list[int], weights: dict[int, float], latent: int = LATENT, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS):
        self.neighbours, self.sharpness = neighbours, sharpness
        self.labels = np.array(labels, np.float32)
        self.weights = np.array([weights[x] for x in labels], np.float32)
        self.prior = float((self.labels * self.weights).sum() / self.weights.sum()) if labels else 0.5
        counts = term_counts(pa.array(texts, pa.string()))
        present = (counts > 0).sum(0)
        self.idf = np.log((1.0 + len(texts)) / (1.0 + present)).astype(np.float32) + 0.2
        weighted = self._weighted(counts)
        # right singular vectors from the small side; signs do not matter to cosines
        values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :latent].astype(np.float32))
        self.vectors = self._unit(weighted @ self.axes)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return np.log1p(1000.0 * counts).astype(np.float32) * self.idf

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        size = np.sqrt((rows * rows).sum(1, keepdims=True))
        return np.divide(rows, size, out=np.zeros_like(rows), where=size > 1e-9)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Share of the votes for label 1, between 0 and 1; the prior for texts without a term."""
        out = np.full(len(texts), self.prior, np.float64)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(texts), _BLOCK):
            rows = self._unit(self._weighted(term_counts(texts.slice(a, _BLOCK))) @ self.axes)
            cosine = rows @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.exp(self.sharpness * (np.take_along_axis(cosine, near, 1).astype(np.float64) - 1)) * self.weights[near]
            known = np.abs(rows).sum(1) > 0
            share = (vote * self.labels[near]).sum(1) / vote.sum(1)
            out[a : a + _BLOCK][known] = share[known]
        return np.clip(out, 0.0, 1.0)


def fit_voters(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = PER_LABEL) -> Voters:
    """Voters from the labelled rows where `learn` (on doc_id) holds; at most 2 * per_label a label."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(learn & F.col("quality").isin(0, 1))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = bounded_sample(known, "quality", "doc_id", per_label)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    near = texts.join(F.broadcast(chosen), "doc_id")  # chosen: 4 * per_label rows at most
    rows = sorted((r["doc_id"], r["quality"], r["text"]) for r in bounded_texts(near, "doc_id", 4 * per_label))
    met = {q: sum(1 for r in rows if r[1] == q) for q in counts}
    return Voters([t for _, _, t in rows], [q for _, q, _ in rows], {q: counts[q] / met[q] for q in met if met[q]})


def _score(voters: Voters, keep: float | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                found = voters.score(part.column("text"))
                if keep is not None:
                    yield part.filter(pa.array(found >= keep))
                else:
                    columns = [part.column("doc_id"), part.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return score


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, per_label: int = PER_LABEL) -> DataFrame:
    """Quality of every whole text, as labels.quality marks it.

    docs: doc_id long, text string; labels: doc_id long, quality 0 or 1; other columns
    are not read. held_out: by default crc32 of doc_id as text, mod 3, is 1. Returns
    doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5).

    Null and empty texts get the share of label 1 among labelled rows, as do all rows
    if there is no label to learn from (then 0.5). Labels other than 0 and 1 do not
    count. Repeated rows are each scored; an empty table gives an empty result.
    """
    held_out = id_crc("doc_id", 3) == 1 if held_out is None else held_out
    voters = fit_voters(docs, labels, ~held_out, per_label)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(voters, None), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, voters: Voters, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score at least `least`."""
    return docs.mapInArrow(_score(voters, least), docs.schema)
