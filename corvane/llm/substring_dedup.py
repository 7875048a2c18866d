"""Operator 2, substring dedup: fixed-block anchors.

Index. Every document is cut into non-overlapping blocks of BLOCK words. As
2 * BLOCK - 1 = WINDOW, each window of WINDOW words of a document holds one of its
whole blocks, so a block index finds every repeat of WINDOW words or more.

Probe. Every rolling BLOCK-word window of every document is looked up in the index.
Index entries and probes meet in shards of the hash space; a batch of documents
sends each hash once, as 48-bit numbers in packed order, and gets back one bit for
each: indexed somewhere and present in two documents at least.

Extend. Around each hit the WINDOW-word windows that hold it are formed and matched
on 96 bits; a run of matching windows is a maximal exact repeat. Each window goes to
the smallest document that has it; the words under it in larger documents go.

Only hashes and bits cross the network besides one exchange of the texts. No pair of
documents is ever formed, so a passage that a third of the documents share costs one
entry for each batch of documents. A batch sends a row to those shards only for which
it has a hash, so there are never more rows than hashes, however many shards there are.

Words are compared by hashes that permute the words of up to eight bytes, windows by 96
bits; over 10^13 windows two different ones agree by chance with a probability of 0.002.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .corpus import batch_key, batches_and_shards

BLOCK = 7
WINDOW = 13
Key = tuple[pa.Scalar, ...]
_LAST = np.iinfo(np.int64).max

_PACKED = "shard int, batch int, first long, width int, n long, payload binary, flags binary"
_BITS = "batch int, shard int, bits binary"


def _batch(table: pa.Table):
    """The documents of a batch in a fixed order, and their words."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table.column("doc_id").fill_null(_LAST).to_numpy()
    buf, offsets = tk.text_buffer(table.column("text"))
    starts, ends, words = tk.word_spans(buf, offsets)
    return table, ids, buf, offsets, starts, ends, words, tk.word_hashes(buf, starts, ends)


def _grams(words: np.ndarray, hashes: np.ndarray, n: int, seed: int = 0):
    """Positions and hashes of the n-word windows that stay within a document."""
    at = tk.window_starts(words, n)
    return at, tk.rolling(hashes, n, seed)[at]


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def _anchors(words: np.ndarray, hashes: np.ndarray):
    at, grams = _grams(words, hashes, BLOCK)
    return at, grams >> np.uint64(16)


def _send_anchors(shards: int):
    def send(key: Key, table: pa.Table) -> pa.Table:
        _, ids, _, _, _, _, words, hashes = _batch(table)
        at, grams = _anchors(words, hashes)
        doc = tk.doc_of(words)[at]
        values = _distinct(grams)
        block = np.zeros(len(values), dtype=bool)
        block[np.searchsorted(values, grams[(at - words[doc]) % BLOCK == 0])] = True
        place = np.searchsorted(values, grams)
        low = np.full(len(values), len(ids), dtype=np.int64)
        high = np.full(len(values), -1, dtype=np.int64)
        high[place] = doc  # positions ascend by document, so the last one stays
        low[place[::-1]] = doc[::-1]
        several = high > low
        return _pack(key[0].as_py(), values, shards, [block, several])

    return send


def _pack(batch: int, values: np.ndarray, shards: int, flags: list[np.ndarray], bits: int = 48) -> pa.Table:
    found, bounds = tk.shard_bounds(values, shards, bits)
    rows = {k: [] for k in ("shard", "batch", "first", "width", "n", "payload", "flags")}
    for s, low, high in zip(found.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        first, width, payload = tk.pack_sorted(values[low:high])
        for k, v in zip(rows, (s, batch, first, width, high - low, payload, b"".join(np.packbits(f[low:high]).tobytes() for f in flags)), strict=True):
            rows[k].append(v)
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(rows.items(), kinds, strict=True)})


def _bits(flags: bytes, n: int, which: int) -> np.ndarray:
    width = (n + 7) // 8
    return np.unpackbits(np.frombuffer(flags, np.uint8)[which * width : (which + 1) * width], count=n).astype(bool)


def _answer(batches, shards, bits) -> pa.Table:
    return pa.table({"batch": pa.array(batches, pa.int32()), "shard": pa.array(shards, pa.int32()), "bits": pa.array(bits, pa.binary())})


def _probe(key: Key, table: pa.Table) -> pa.Table:
    """One shard of the index: which of each batch's hashes are indexed and in two documents."""
    rows = table.to_pylist()
    values = [tk.unpack_sorted(r["first"], r["width"], r["payload"], r["n"]) for r in rows]
    ordered = np.sort(np.concatenate(values))
    shared = ordered[1:][ordered[1:] == ordered[:-1]]
    shared = _distinct(np.concatenate([shared, *(v[_bits(r["flags"], len(v), 1)] for v, r in zip(values, rows, strict=True))]))
    indexed = _distinct(np.concatenate([v[_bits(r["flags"], len(v), 0)] for v, r in zip(values, rows, strict=True)]))
    hits = np.intersect1d(shared, indexed, assume_unique=True)
    answers = []
    for v in values:
        found = np.zeros(len(v), dtype=bool)
        if len(hits):
            place = np.minimum(np.searchsorted(hits, v), len(hits) - 1)
            found = hits[place] == v
        answers.append(np.packbits(found).tobytes())
    return _answer([r["batch"] for r in rows], [r["shard"] for r in rows], answers)


def _joined_bits(table: pa.Table, values: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """The answers of all shards, in the order of the batch's sorted hashes."""
    found, bounds = tk.shard_bounds(values, shards, bits)
    place = dict(zip(found.tolist(), zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), strict=True))
    out = np.zeros(len(values), dtype=bool)
    for r in table.to_pylist():
        if r["shard"] >= 0:
            low, high = place[r["shard"]]
            out[low:high] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=high - low)
    return out


def _windows(words: np.ndarray, hashes: np.ndarray, chosen: np.ndarray | None):
    """Positions of the chosen windows, their two hashes, and the sorted distinct first hashes with each one's place."""
    at = tk.window_starts(words, WINDOW)
    pick = np.ones(len(at), dtype=bool) if chosen is None else chosen
    at = at[pick]
    main = tk.rolling(hashes, WINDOW, 1)[at]
    check = (tk.rolling(hashes, WINDOW, 2)[at] >> np.uint64(32)).astype(np.uint32)
    # the check bits are folded in so that one 64-bit order serves; both are sent
    values = _distinct(main)
    return at, main, check, values, np.searchsorted(values, main)


def _extend(shards: int):
    """Candidate windows around the hits: smallest document of each within the batch."""

    def extend(key: Key, docs: pa.Table, hits: pa.Table) -> pa.Table:
        kinds = {"shard": pa.int32(), "batch": pa.int32(), "first": pa.int64(), "n": pa.int64(), "payload": pa.binary()}
        rows = {k: [] for k in kinds}
        if docs.num_rows:
            batch = key[0].as_py()
            _, ids, _, _, _, _, words, hashes = _batch(docs)
            at, grams = _anchors(words, hashes)
            values = _distinct(grams)
            hit = _joined_bits(hits, values, shards, 48)[np.searchsorted(values, grams)] if len(values) else np.zeros(0, bool)
            # a window is a candidate if one of the WINDOW - BLOCK + 1 anchors in it is hit
            marks = np.zeros(len(hashes) + 1, dtype=np.int64)
            marks[at[hit] + 1] = 1
            sums = np.cumsum(marks)
            begin = tk.window_starts(words, WINDOW)
            chosen = sums[begin + WINDOW - BLOCK + 1] > sums[begin]
            at, main, check, values, place = _windows(words, hashes, chosen)
            owner = np.full(len(values), _LAST, dtype=np.int64)
            np.minimum.at(owner, place, ids[tk.doc_of(words)[at]])
            second = np.zeros(len(values), dtype=np.uint32)
            second[place] = check
            found, bounds = tk.shard_bounds(values, shards, 64)
            for s, low, high in zip(found.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                base = int(owner[low:high].min())
                gap = (owner[low:high] - base).astype(np.uint64)
                wide = bool(int(gap.max()) >> 32)
                payload = values[low:high].tobytes() + second[low:high].tobytes() + gap.astype(np.uint64 if wide else np.uint32).tobytes()
                for k, v in zip(rows, (s, batch, base, high - low, payload), strict=True):
                    rows[k].append(v)
            for k, v in zip(rows, (-1 - batch, batch, 0, len(chosen), np.packbits(chosen).tobytes()), strict=True):
                rows[k].append(v)
        return pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return extend


def _own(key: Key, table: pa.Table) -> pa.Table:
    """One shard of the windows: which of each batch's are in a smaller document of another batch."""
    rows = table.to_pylist()
    if key[0].as_py() < 0:
        return _answer([r["batch"] for r in rows], [r["shard"] for r in rows], [r["payload"] for r in rows])
    parts = []
    for r in rows:
        n, p = r["n"], r["payload"]
        ids = np.frombuffer(p, np.uint64 if len(p) == 20 * n else np.uint32, offset=12 * n).astype(np.int64) + r["first"]
        parts.append((np.frombuffer(p, np.uint64, n), np.frombuffer(p, np.uint32, n, 8 * n), ids))
    main, check, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, check, main))
    m, c = main[order], check[order]
    fresh = np.concatenate(([True], (m[1:] != m[:-1]) | (c[1:] != c[:-1])))
    least = ids[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    later = np.empty(len(ids), dtype=bool)
    later[order] = ids[order] > least
    ends = np.cumsum([len(x[0]) for x in parts])
    return _answer([r["batch"] for r in rows], [r["shard"] for r in rows], [np.packbits(later[e - len(x[0]) : e]).tobytes() for e, x in zip(ends, parts, strict=True)])


def _finish(shards: int, with_text: bool):
    def finish(key: Key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_repeats", pa.int64()), *([("kept_text", pa.string())] if with_text else [])]).empty_table()
        docs, ids, buf, offsets, starts, ends, words, hashes = _batch(docs)
        begin = tk.window_starts(words, WINDOW)
        chosen = np.zeros(len(begin), dtype=bool)
        for r in answers.to_pylist():
            if r["shard"] < 0:
                chosen = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(begin)).astype(bool)
        at, main, _, values, place = _windows(words, hashes, chosen)
        elsewhere = _joined_bits(answers, values, shards, 64)
        owner = np.full(len(values), _LAST, dtype=np.int64)
        doc = ids[tk.doc_of(words)[at]]
        np.minimum.at(owner, place, doc)
        repeat = at[elsewhere[place] | (doc > owner[place])]
        gone = tk.cover(len(starts), repeat, WINDOW)
        edge = gone & np.concatenate(([True], ~gone[:-1])) if len(gone) else gone
        if len(gone):
            heads = words[:-1][words[:-1] < len(gone)]
            edge[heads] |= gone[heads]
        sums = np.concatenate(([0], np.cumsum(gone)))
        runs = np.concatenate(([0], np.cumsum(edge)))
        text, bounds = kept_bytes(buf, starts, ends, words, ~gone)
        pieces = [text[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        out = {
            "doc_id": docs.column("doc_id"),
            "n_words": pa.array(np.diff(words), pa.int64()),
            "n_removed": pa.array(sums[words[1:]] - sums[words[:-1]], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in pieces]),
            "n_repeats": pa.array(runs[words[1:]] - runs[words[:-1]], pa.int64()),
        }
        if with_text:
            out["kept_text"] = pa.array([x.decode() for x in pieces], pa.string())
        return pa.table(out)

    return finish


def kept_bytes(buf, starts, ends, words, keep) -> tuple[memoryview, np.ndarray]:
    """The kept words of each document joined by one space, and where each document's bytes begin."""
    lengths = np.where(keep, ends - starts, 0)
    slots = lengths + keep  # one space behind each kept word; the last of a document is cut off
    edge = np.zeros(len(buf) + 1, dtype=np.int8)
    edge[starts[keep]] += 1
    np.add.at(edge, ends[keep], -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    total = int(slots.sum())
    out = np.full(total, 32, dtype=np.uint8)
    hole = np.cumsum(slots[keep]) - 1
    solid = np.ones(total, dtype=bool)
    solid[hole] = False
    out[solid] = buf[inside]
    upto = np.concatenate(([0], np.cumsum(slots)))
    low, high = upto[words[:-1]], upto[words[1:]]
    # each document's slice ends before its own last space
    view = memoryview(out.tobytes())
    return _Slices(view, low, np.maximum(high - 1, low)), np.arange(len(words))


class _Slices:
    """Slices of one buffer by document number."""

    def __init__(self, view, low, high):
        self.view, self.low, self.high = view, low.tolist(), high.tolist()

    def __getitem__(self, s: slice) -> bytes:
        return bytes(self.view[self.low[s.start] : self.high[s.start]])


def substring_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a WINDOW-word window that also starts in a document with a smaller doc_id.

    docs: doc_id long, text string; other columns are not read. Returns doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space),
    n_repeats (maximal runs removed) and, with_text, kept_text.

    Null or empty text: no words, the hash of the empty string. A null doc_id counts
    as larger than any other. Rows with equal doc_id do not remove each other's words;
    a row that occurs twice gives two rows. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    batches, shards = batches_and_shards(docs)
    docs = docs.withColumn("batch", batch_key(batches))
    by_batch = docs.groupBy("batch")
    anchors = by_batch.applyInArrow(_send_anchors(shards), _PACKED)
    hits = anchors.groupBy("shard").applyInArrow(_probe, _BITS)
    windows = by_batch.cogroup(hits.groupBy("batch")).applyInArrow(_extend(shards), "shard int, batch int, first long, n long, payload binary")
    answers = windows.groupBy("shard").applyInArrow(_own, _BITS)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_repeats long" + ", kept_text string" * with_text
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(_finish(shards, with_text), schema)
