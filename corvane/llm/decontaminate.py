"""Operator 1, benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

A benchmark item of n words leaks into a document where some n-word window lies within
edit distance (over words) of MIN_SIMILARITY. The CGK random walk embeds a window of n
words into 3n places so that small edit distance becomes small Hamming distance: at
each place the current word is written out, and a random bit of (place, word) says
whether to step on. Bit-sampling LSH reads SAMPLES places of the embedding; windows and
items of one size that agree in any of REPEATS independent embeddings are candidates,
and the exact edit distance of the item to the text around the window decides.

REPEATS follows from the target recall: an embedded pair at the largest allowed
distance agrees in a share AGREE of its places (measured in the tests), so a repeat
misses with 1 - AGREE**SAMPLES, and REPEATS of them with that to the power REPEATS.

A window within distance d of an item must hold one of the item's d+1 disjoint word
groups unchanged, so windows without any word group of an item are never embedded.
That skips no window that could pass; it only saves the walk over the rest of a corpus.

Items may share long headers, and a document may repeat one: a word group leads to
windows by its place and the item's size, however many items share it; and before the
edit distance of a candidate is computed, all its words are looked up in a bitmap of
those around the window, since an item within distance d has n - d of them there.

The benchmark is collected only below MAX_ITEMS items and MAX_BYTES of text; larger ones
are taken in blocks of that much, one pass each. Everything else is one pass without a
shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tokens import slices

MIN_SIMILARITY = 80  # percent of an item's words
SAMPLES = 2
AGREE = 0.4
RECALL = 0.99
REPEATS = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLES))
MAX_ITEMS = 20_000
MAX_BYTES = 32 << 20
_SLICE = 6 << 20
_CELLS = 1 << 14  # window words that are embedded together
_EXPAND = 1 << 20  # postings or pairs looked at together
_FILTER_BITS = 20
_SLOTS = 64  # bits of the bitmap around a window for each of its words

SCHEMA = "doc_id long, item_id long, start_word long, end_word long, distance long, item_words long, similarity double"


def _hashed_words(texts: pa.Array):
    buf, offsets = tk.text_buffer(texts)
    buf = tk.LOWER[buf]
    starts, ends, words = tk.word_spans(buf, offsets)
    return words, tk.word_hashes(buf, starts, ends)


def embed(windows: np.ndarray, places: np.ndarray, repeats: int) -> np.ndarray:
    """CGK walks over rows of word hashes, read at places[row, repeat, sample]: one signature per row and repeat.

    A row is a window, filled up with zeros behind its last word; the walk stays on
    the zeros once it gets there.
    """
    rows, width = windows.shape
    salts = tk.mix(np.arange(repeats * 3 * width, dtype=np.uint64) + np.uint64(0x5EED)).reshape(repeats, -1) | np.uint64(1)
    at = np.zeros((rows, repeats), dtype=np.int64)
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    out = np.empty((3 * width, rows, repeats), dtype=np.uint64)
    pick = np.arange(rows)[:, None]
    for step in range(3 * width):
        symbol = padded[pick, at]
        out[step] = symbol
        at += ((symbol * salts[:, step]) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, width, out=at)
    signature = np.zeros((rows, repeats), dtype=np.uint64)
    for k in range(places.shape[2]):
        signature = tk.mix(signature * np.uint64(31) + out[places[:, :, k], pick, np.arange(repeats)])
    return signature


def sample_places(sizes: np.ndarray, repeats: int, samples: int) -> np.ndarray:
    """Places read in the 3n-place embedding of windows of each size n, the same for equal sizes."""
    share = tk.mix(np.arange(repeats * samples, dtype=np.uint64) + np.uint64(77)).reshape(repeats, samples) / 2.0**64
    return np.floor(share[None] * (3 * sizes[:, None, None])).astype(np.int64)


def locate(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of the item to any run of the region, and that run's bounds (the one that begins, then ends first)."""
    n, one = len(item), np.int64(1) << 32
    steps = np.arange(n + 1) * one
    row = steps.copy()  # distance of item[:i] to the run that ends here, and below it where that run begins
    best, end = int(row[n]), 0
    for j, word in enumerate(region.tolist()):
        fresh = np.concatenate(([j + 1], np.minimum(row[:-1] + (item != word) * one, row[1:] + one)))
        row = np.minimum.accumulate(fresh - steps) + steps  # words of the item that the run lacks
        if int(row[n]) < best:
            best, end = int(row[n]), j + 1
    return best >> 32, best & 0xFFFFFFFF, max(end, best & 0xFFFFFFFF)


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (count of them) for each entry, in a row."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _parts(count: np.ndarray) -> Iterator[slice]:
    """Consecutive entries whose counts sum to about _EXPAND, one at least."""
    upto, at = np.cumsum(count), 0
    while at < len(count):
        done = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + _EXPAND, side="right")))
        yield slice(at, to)
        at = to


@dataclass
class Index:
    """A bounded block of benchmark items, ready to be matched. Items of like size (up to the next power of two) are kept together."""

    ids: list[int]
    items: list[np.ndarray]
    min_similarity: int = MIN_SIMILARITY
    samples: int = SAMPLES
    repeats: int = REPEATS
    sizes: np.ndarray = field(init=False)
    limit: np.ndarray = field(init=False)

    def __post_init__(self):
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.limit = self.sizes * (100 - self.min_similarity) // 100
        self.most = int(self.sizes.max(initial=1))
        group = np.maximum(1, self.sizes // (self.limit + 1))
        self.seeds = {}
        for q in sorted(set(group.tolist())):
            found: dict[tuple[int, int], list[np.ndarray]] = {}  # by size and place
            for i in np.flatnonzero(group == q).tolist():
                for offset, gram in enumerate(tk.rolling(self.items[i], q).tolist()):
                    found.setdefault((len(self.items[i]), offset), []).append(gram)
            parts = [(np.unique(np.array(v, np.uint64)), size, offset) for (size, offset), v in found.items()]
            grams = np.concatenate([g for g, _, _ in parts])
            order = np.argsort(grams, kind="stable")
            quick = np.zeros(1 << _FILTER_BITS, dtype=bool)
            quick[grams >> np.uint64(64 - _FILTER_BITS)] = True
            self.seeds[q] = (quick, grams[order], *(np.repeat([p[k] for p in parts], [len(g) for g, _, _ in parts])[order] for k in (1, 2)))
        self.widths = 1 << np.ceil(np.log2(self.sizes)).astype(np.int64)
        self.classes = {}
        for width in sorted(set(self.widths.tolist())):
            own = np.flatnonzero(self.widths == width)
            rows = np.zeros((len(own), width), np.uint64)
            slots = np.full((len(own), width), _SLOTS * width, np.int32)  # behind an item: a slot that is always set
            keys = np.empty((len(own), self.repeats), np.uint64)
            for k, i in enumerate(own.tolist()):
                rows[k, : self.sizes[i]] = self.items[i]
                slots[k, : self.sizes[i]] = self._slot(self.items[i], width)
            for a in range(0, len(own), self._rows(width)):
                part = slice(a, a + self._rows(width))
                keys[part] = self._keys(rows[part], self.sizes[own[part]])
            order = np.argsort(keys.ravel(), kind="stable")
            self.classes[width] = (keys.ravel()[order], np.repeat(own, self.repeats)[order], slots, np.searchsorted(own, np.arange(len(self.items))))

    @staticmethod
    def _rows(width: int) -> int:
        return max(1, _CELLS // width)

    @staticmethod
    def _slot(words: np.ndarray, width: int) -> np.ndarray:
        return (words >> np.uint64(20)) % np.uint64(_SLOTS * width)

    def _keys(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """LSH keys: repeat, window size and sampled symbols in one number."""
        out = embed(rows, sample_places(sizes, self.repeats, self.samples), self.repeats)
        return tk.mix(out + sizes[:, None].astype(np.uint64) * np.uint64(1_000_003) + np.arange(self.repeats, dtype=np.uint64))

    def windows(self, words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item-sized windows (first word, size) around an unchanged word group of an item of that size."""
        both = np.zeros(0, np.int64)
        doc = tk.doc_of(words)
        for q, (quick, grams, sizes, offsets) in self.seeds.items():
            at = tk.window_starts(words, q)
            mine = tk.rolling(hashes, q)[at] if len(at) else np.zeros(0, np.uint64)
            near = np.flatnonzero(quick[mine >> np.uint64(64 - _FILTER_BITS)])
            low = np.searchsorted(grams, mine[near], side="left")
            count = np.searchsorted(grams, mine[near], side="right") - low
            for part in _parts(count):
                place = _spread(low[part], count[part])
                pos = np.repeat(at[near[part]], count[part])
                first = np.maximum(pos - offsets[place], words[doc[pos]])
                both = np.union1d(both, first * (self.most + 1) + sizes[place])
        return both // (self.most + 1), both % (self.most + 1)

    def candidates(self, words: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, first word of the window, item) that agree in a sampled key and can be within the limit, by window."""
        first, size = self.windows(words, hashes)
        doc = np.searchsorted(words, first, side="right") - 1
        width_of = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        for width, (known, owner, slots, row_of) in self.classes.items():
            own = np.flatnonzero(width_of == width)
            for a in range(0, len(own), self._rows(width)):
                part = own[a : a + self._rows(width)]
                s, n, low_end, high_end = first[part], size[part], words[doc[part]], words[doc[part] + 1]
                place = s[:, None] + np.arange(width)
                inside = (np.arange(width) < n[:, None]) & (place < high_end[:, None])
                rows = np.where(inside, hashes[np.minimum(place, len(hashes) - 1)], np.uint64(0))
                keys = self._keys(rows, n).ravel()
                low = np.searchsorted(known, keys, side="left")
                count = np.searchsorted(known, keys, side="right") - low
                if not count.any():
                    continue
                # the words of the window and of `reach` places on either side
                reach = width * (100 - self.min_similarity) // 100
                place = s[:, None] + np.arange(-reach, width + reach)
                around = (place >= low_end[:, None]) & (place < high_end[:, None])
                there = np.zeros((len(part), _SLOTS * width + 1), dtype=bool)
                there[:, -1] = True
                there[np.nonzero(around)[0], self._slot(hashes[place[around]], width)] = True
                window = np.repeat(np.arange(len(part)), self.repeats)
                pairs = np.zeros(0, np.int64)
                for some in _parts(count):
                    pairs = np.union1d(pairs, np.repeat(window[some], count[some]) * len(self.items) + owner[_spread(low[some], count[some])])
                w, i = np.divmod(pairs, len(self.items))
                same = self.sizes[i] == n[w]
                w, i = w[same], i[same]
                for b in range(0, len(w), max(1, _EXPAND // width)):
                    x, y = w[b : b + max(1, _EXPAND // width)], i[b : b + max(1, _EXPAND // width)]
                    met = there[x[:, None], slots[row_of[y]]].sum(1) - (width - self.sizes[y])
                    fits = met >= self.sizes[y] - self.limit[y]
                    yield from zip(doc[part[x[fits]]].tolist(), s[x[fits]].tolist(), y[fits].tolist(), strict=True)

    def match(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """Best place of each leaked item in each text: (row, item, first word, end word, distance)."""
        words, hashes = _hashed_words(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, s, i in self.candidates(words, hashes):
            item, limit = self.items[i], int(self.limit[i])
            now = best.get((d, i), (limit + 1,))
            if now[0] == 0 and now[1] <= s:
                continue
            low, high = max(int(words[d]), s - limit), min(int(words[d + 1]), s + len(item) + limit)
            if np.array_equal(hashes[s : min(high, s + len(item))], item):
                found = (0, s, s + len(item))
            else:
                distance, x, y = locate(item, hashes[low:high])
                found = (distance, low + x, low + y)
            if found[0] <= limit and found < now:
                best[d, i] = found
        return [(d, i, a - int(words[d]), b - int(words[d]), distance) for (d, i), (distance, a, b) in sorted(best.items())]


def indexes(benchmark: DataFrame, **options) -> Iterator[Index]:
    """The benchmark in blocks of at most MAX_ITEMS items; items without a word are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.count("*").alias("items"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["items"] * 5 // (4 * MAX_ITEMS)), -(-(size["bytes"] or 0) * 5 // (4 * MAX_BYTES)))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = sorted((r["item_id"], r["text"]) for r in part.collect())
        words, hashes = _hashed_words(pa.array([t for _, t in rows], pa.string()))
        keep = [i for i in range(len(rows)) if words[i] < words[i + 1]]
        if keep:
            yield Index([rows[i][0] for i in keep], [hashes[words[i] : words[i + 1]] for i in keep], **options)


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every benchmark item that a document holds, with its best place there.

    docs: doc_id long, text string; benchmark: item_id long, text string; other
    columns are not read. Words are runs of non-space characters, lower-cased in A-Z.
    One row per document row and item within MIN_SIMILARITY: doc_id, item_id,
    start_word, end_word, distance (edits over words), item_words, similarity
    (1 - distance / item_words). Of equally near places the first counts.

    Null, empty and blank texts and items match nothing; a null doc_id is carried
    along; rows that occur twice are reported twice; items of equal text are each
    reported. Empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for index in indexes(benchmark, **options):
        out = out.union(docs.mapInArrow(_find(index), SCHEMA))
    return out


def _find(index: Index):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[d], index.ids[i], a, b, k, len(index.items[i]), 1 - k / len(index.items[i])) for d, i, a, b, k in index.match(part.column("text"))]
                kinds = [pa.int64()] * 6 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=names)

    return find


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item. Filters in the scan: nothing is shuffled."""
    for index in indexes(benchmark, **options):
        docs = docs.mapInArrow(_drop(index), docs.schema)
    return docs


def _drop(index: Index):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[d for d, *_ in index.match(part.column("text"))]] = False
                yield part.filter(pa.array(keep))

    return drop
