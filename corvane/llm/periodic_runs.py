"""Operator 13, periodic run detection: repeated k-gram masking, then Main-Lorentz.

A run is a stretch of consecutive words of one document with smallest period q and at
least max(MIN_LENGTH, MIN_POWER * q) words that no neighbouring word extends. Such a
stretch overlaps its own copy q words on in at least K = MIN_LENGTH - 1 words, so each
of its words lies in a k-gram that the document holds more than once. All other words
are masked. What is left are segments; a run lies in one of them, so the mask is applied
again within each, until it takes nothing more away.

Segments of all documents of a batch go through Main and Lorentz's divide and conquer a
level at a time: a run that crosses the middle of a node is found from one of two
anchors, (middle, middle + p) and (middle - p, middle), by how far the words p apart
agree on either side. Those extensions come from polynomial prefix hashes and a binary
search, for all nodes and periods of a level at once: O(n log n) candidates, of which a
check of the half that must agree lets few through to the search.

Words are compared by 64-bit hashes, stretches by two sums modulo primes near 2^31. One
scan; nothing is shuffled, and a task holds a slice of _SLICE bytes, or one document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tokens import slices

MIN_LENGTH = 6
MIN_POWER = 4
K = MIN_LENGTH - 1
_SLICE = 2 << 20
_CANDIDATES = 1 << 20  # looked at together
_PRIMES = (2**31 - 1, 2**31 - 19)

_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Stretches:
    """Answers whether two stretches of one row of numbers are equal, many questions at a time."""

    def __init__(self, codes: np.ndarray):
        self.parts = []
        for prime, base, values in zip(_PRIMES, (1_000_003, 69_069), (codes >> np.uint64(33), codes & np.uint64(0x7FFFFFFF)), strict=True):
            power, step = np.ones(len(codes) + 1, np.uint64), 1
            while step < len(power):  # powers[step:2*step] from powers[:step]
                factor = np.uint64(pow(base, step, prime))
                power[step : 2 * step] = power[: min(step, len(power) - step)] * factor % np.uint64(prime)
                step *= 2
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(values % np.uint64(prime) * power[:-1] % np.uint64(prime), out=sums[1:])
            self.parts.append((np.uint64(prime), power, sums % np.uint64(prime)))

    def equal(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the `length` numbers from `first` on are those from `second` on, where first <= second."""
        out = np.ones(len(first), dtype=bool)
        for prime, power, sums in self.parts:
            a = (sums[first + length] + prime - sums[first]) % prime
            b = (sums[second + length] + prime - sums[second]) % prime
            out &= a * power[second - first] % prime == b
        return out

    def ahead(self, first: np.ndarray, second: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers from first and second on agree, up to `most`."""
        return self._search(most, lambda n: self.equal(first, second, n))

    def behind(self, first: np.ndarray, second: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers before first and second agree, up to `most`."""
        return self._search(most, lambda n: self.equal(first - n, second - n, n))

    @staticmethod
    def _search(most: np.ndarray, agree) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            good = agree(half)
            low, high = np.where(good, half, low), np.where(good, high, half - 1)
        return low


def repeated(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words lie in a k-gram that their piece (bounds: where each begins, and one more) holds more than once."""
    at = tk.window_starts(bounds, K)
    if not len(at):
        return np.zeros(len(hashes), dtype=bool)
    grams = tk.mix(tk.rolling(hashes, K)[at] ^ tk.doc_of(bounds)[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(grams)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    quick = np.zeros(1 << 20, dtype=bool)
    quick[twice >> np.uint64(44)] = True
    near = np.flatnonzero(quick[grams >> np.uint64(44)])
    place = np.searchsorted(twice, grams[near])
    hit = near[(place < len(twice)) & (twice[np.minimum(place, len(twice) - 1)] == grams[near])] if len(twice) else near[:0]
    return tk.cover(len(hashes), at[hit], K)


def segments(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What masking leaves: the words' hashes, where each segment begins among them (and one more), and the place of each word before."""
    place = np.arange(len(hashes))
    while len(hashes):
        keep = repeated(hashes, bounds)
        edge = np.zeros(len(hashes), dtype=bool)
        edge[bounds[:-1][bounds[:-1] < len(hashes)]] = True
        edge[1:] |= ~keep[:-1]  # a piece begins at a bound and behind each masked word
        piece = np.cumsum(edge) - 1
        sizes = np.bincount(piece[keep], minlength=int(piece[-1]) + 1)
        keep &= sizes[piece] >= MIN_LENGTH
        piece = piece[keep]
        fresh = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1]))) if len(piece) else np.zeros(0, np.int64)
        done = bool(keep.all())
        hashes, place, bounds = hashes[keep], place[keep], np.append(fresh, len(piece))
        if done:
            break
    return hashes, bounds if len(hashes) else np.zeros(1, np.int64), place


def main_lorentz(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, end and smallest period of every run within the pieces, ascending by place and period."""
    same, found = Stretches(codes), [np.zeros((0, 3), np.int64)]
    low, high = bounds[:-1], bounds[1:]
    first, last = low, high  # of the whole piece
    known = np.zeros_like(low)  # period of a run that holds the whole node; its multiples give that run again
    while True:
        alive = high - low >= MIN_LENGTH
        low, high, first, last, known = (x[alive] for x in (low, high, first, last, known))
        if not len(low):
            break
        middle = (low + high) // 2
        upto = np.cumsum((high - low) // MIN_POWER)  # periods of a run that fits in the node
        for a in range(0, int(upto[-1]), _CANDIDATES):
            number = np.arange(a, min(a + _CANDIDATES, int(upto[-1])))
            node = np.searchsorted(upto, number, side="right")
            period = number - (upto[node] - (high - low)[node] // MIN_POWER) + 1
            fresh = (known[node] == 0) | (period % np.maximum(known[node], 1) != 0)
            node, period = node[fresh], period[fresh]
            need = np.maximum(MIN_LENGTH, MIN_POWER * period) - period
            for anchor in (middle[node], middle[node] - period):
                room_behind, room_ahead = anchor - first[node], last[node] - anchor - period
                half = (need + 1) // 2  # one side must agree this far
                near = np.zeros(len(node), dtype=bool)
                for room, shift in ((room_ahead, 0), (room_behind, half)):
                    fits = np.flatnonzero(room >= half)
                    start = (anchor - shift)[fits]
                    near[fits] |= same.equal(start, start + period[fits], half[fits])
                near = np.flatnonzero(near)
                i, p = anchor[near], period[near]
                begin = i - same.behind(i, i + p, room_behind[near])
                end = i + p + same.ahead(i, i + p, room_ahead[near])
                long = end - begin >= need[near] + p
                found.append(np.stack([begin[long], end[long], p[long]], axis=1))
                n = node[near][long]
                whole = (begin[long] <= low[n]) & (end[long] >= high[n])
                n, p = n[whole], p[long][whole]
                order = np.lexsort((p, n))
                n, p = n[order], p[order]
                least = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1]))) if len(n) else n
                n, p = n[least], p[least]
                known[n] = np.where(known[n] > 0, np.minimum(known[n], p), p)
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        first, last, known = np.tile(first, 2), np.tile(last, 2), np.tile(known, 2)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # of one stretch's periods all are multiples of the smallest, which was found as well
    fresh = np.ones(len(runs), dtype=bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def find_runs(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and smallest period of every run of the documents that begin at bounds."""
    codes, pieces, place = segments(hashes, bounds)
    begin, end, period = main_lorentz(codes, pieces)
    return place[begin], place[end - 1] + 1, period


def tiling(ids: list[int | None], bounds: np.ndarray) -> np.ndarray:
    """For each word the word that takes its place when every tenth document (by crc32 of its id) is tiled from some word on."""
    source = np.arange(int(bounds[-1]))
    for i, doc_id in enumerate(ids):
        n = int(bounds[i + 1] - bounds[i])
        if doc_id is None or not n:
            continue
        g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
        if rest == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[bounds[i] + a : bounds[i + 1]] = bounds[i] + a + np.arange(n - a) % p
    return source


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) + np.repeat(starts - begin, size)
    space = begin + size - 1
    place[space] = 0
    out = buf[place]
    out[space] = 32
    return out[:-1].tobytes()


def _detect(tile: bool, detail: bool):
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                yield _answer(part, tile, detail)

    return detect


def _answer(part: pa.RecordBatch, tile: bool, detail: bool) -> pa.RecordBatch:
    buf, offsets = tk.text_buffer(part.column("text"))
    starts, ends, words = tk.word_spans(buf, offsets)
    if tile:
        source = tiling(part.column("doc_id").to_pylist(), words)
        starts, ends = starts[source], ends[source]
    begin, end, period = find_runs(tk.word_hashes(buf, starts, ends), words)
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, begin + period, 1)
    np.add.at(edge, end, -1)
    kept = np.cumsum(edge[:-1]) == 0
    doc = np.searchsorted(words, begin, side="right") - 1
    upto = np.searchsorted(doc, np.arange(part.num_rows + 1))
    length, begin = end - begin, begin - words[doc]
    rows = {k: [] for k in ("start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    runs, texts = [], []
    for d in range(part.num_rows):
        own = list(zip(begin[upto[d] : upto[d + 1]].tolist(), length[upto[d] : upto[d + 1]].tolist(), period[upto[d] : upto[d + 1]].tolist(), strict=True))
        best = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        for k, v in zip(rows, (*best, 1000 * best[1] // best[2]) if best else (None,) * 4, strict=False):
            rows[k].append(v)
        rows["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest())
        stay = np.flatnonzero(kept[words[d] : words[d + 1]]) + words[d]
        text = _joined(buf, starts[stay], ends[stay])
        rows["collapsed_sha256"].append(hashlib.sha256(text).hexdigest())
        if detail:
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
            texts.append(text.decode())
    columns = {"doc_id": part.column("doc_id"), "n_runs": pa.array(np.diff(upto), pa.int64())}
    columns |= {k: pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in rows.items()}
    if detail:
        columns["runs"] = pa.array(runs, pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))
        columns["collapsed_text"] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_pydict(columns)


def periodic_runs(docs: DataFrame, tile: bool = False, detail: bool = False) -> DataFrame:
    """The runs of every document, and its text with each run cut to its first period.

    docs: doc_id long, text string; other columns are not read. Words are runs of bytes
    other than space and 0x09-0x0D, numbered from 0. tile: replace words of every tenth
    document first (see `tiling`), which plants runs of every size. Returns doc_id,
    n_runs; start, length, period, exponent_milli of the longest run (of equally long
    ones the first, then the one of the smaller period; nulls without a run);
    runs_sha256 of the lines start,length,period of all runs by start, then period;
    collapsed_sha256 of the words that no run holds behind its first period, joined by
    one space. detail adds runs and collapsed_text.

    Null, empty and blank texts have no runs and the hashes of the empty string. A null
    doc_id is carried along and never tiled. Rows of one id are documents of their own.
    An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed_text string" if detail else ""
    return docs.mapInArrow(_detect(tile, detail), _DIGEST + more)
