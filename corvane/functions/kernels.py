"""Arrow kernels for what no built-in expression can say at reasonable cost."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

BLOCKS = (16, 20, 24)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_GAP = 6


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def letter_counts(s: str) -> np.ndarray:
    """How often each distinct character occurs."""
    if s.isascii():
        counts = np.bincount(np.frombuffer(s.encode(), np.uint8))
        return counts[counts > 0]
    return np.unique(_codes(s), return_counts=True)[1]


def composition(column: str) -> Column:
    """Struct of entropy (bits a character), kinds (distinct characters) and top (share of the most frequent); zeros for empty and null strings."""
    kind = StructType([StructField("entropy", DoubleType()), StructField("kinds", LongType()), StructField("top", DoubleType())])

    @F.pandas_udf(kind)
    def kernel(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s.fillna(""):
            share = letter_counts(x) / max(1, len(x))
            rows.append((float(-(share * np.log2(share)).sum()), len(share), float(share.max(initial=0.0))))
        return pd.DataFrame(rows, columns=["entropy", "kinds", "top"])

    return kernel(column)


def distinct_kmers(s: str, k: int) -> int:
    """Number of distinct k-mers; a shorter non-empty string is its own only one."""
    if len(s) <= k:
        return min(1, len(s))
    if s.isascii() and k <= 8:
        letters = np.frombuffer(s.encode(), np.uint8)
        packed = np.zeros(len(s) - k + 1, np.uint32 if k <= 4 else np.uint64)
        for i in range(k):
            packed = (packed << packed.dtype.type(8)) | letters[i : len(s) - k + 1 + i]
        packed.sort()
        return 1 + int(np.count_nonzero(packed[1:] != packed[:-1]))
    return len({s[i : i + k] for i in range(len(s) - k + 1)})


def kmer_count(column: str, k: int) -> Column:
    @F.pandas_udf(LongType())
    def kernel(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda x: distinct_kmers(x, k))

    return kernel(column)


def kmer_set(s: str, k: int) -> np.ndarray:
    """Distinct k-mers in order, up to three characters as one number; a shorter non-empty string is its own only one."""
    if k > 3:
        return np.unique(np.array([s[i : i + k] for i in range(max(1, len(s) - k + 1))] if s else [], dtype=str))
    codes = _codes(s).astype(np.uint64) + np.uint64(1)
    k = min(k, len(s))
    packed = np.zeros(len(s) - k + 1 if k else 0, np.uint64)
    for i in range(k):
        packed = (packed << np.uint64(21)) | codes[i : len(s) - k + 1 + i]
    return np.unique(packed)


#: Texts whose k-mers are compared with those of SIDE_QUERIES pairs of queries at a time, and pairs of a query and a reference that a task holds.
SIDE, SIDE_QUERIES = 512, 512
HELD = 4 << 20
#: Overlaps of two queries fit one exact float32 below this many k-mers of a query.
PACKED = 4096
#: Share of the k-mers that occur which is compared for all pairs, and the number of other k-mers from which that is worthwhile.
COMMON, LEAST_REST = 0.95, 256
#: The last block of queries that this process has prepared.
_prepared: dict[str, QueryGrams] = {}


def letter_grams(s: str, k: int) -> np.ndarray | None:
    """The k-mers (k up to 3) of a string of capitals A to Z as numbers of 5 bits a letter, with repeats; None for any other string."""
    if k > 3 or not s or not s.isascii():
        return None
    codes, k = np.frombuffer(s.encode(), np.uint8) - np.uint8(64), min(k, len(s))
    if codes.min() < 1 or codes.max() > 26:
        return None
    codes = codes.astype(np.int64)
    packed = np.zeros(len(s) - k + 1, np.int64)
    for i in range(k):
        packed = (packed << 5) | codes[i : len(s) - k + 1 + i]
    return packed


class QueryGrams:
    """Queries in order of the size of their k-mer sets, as rows over their k-mers, most frequent first; rows 2 i and 2 i + 1 are packed in one.

    Rows have the first k-mers, with COMMON of all that occur; the rest of a set is few and kept as bits.
    """

    def __init__(self, queries: list[tuple[int, str, float]], k: int):
        own = [kmer_set(s, k) for _, s, _ in queries]
        sizes = np.array([len(g) for g in own])
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.k = sizes[self.order].astype(float), k
        self.bounds = np.array([b for *_, b in queries], float)[self.order]
        self.grams, often = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, int))
        by_often = np.argsort(-often, kind="stable")
        self.rank = np.empty(len(often), np.int64)
        self.rank[by_often] = np.arange(len(often))
        self.common = int(np.searchsorted(np.cumsum(often[by_often]), COMMON * often.sum())) + 1
        if self.common + LEAST_REST > len(often):
            self.common = len(often)
        self.width = 2 if sizes.max(initial=0) < PACKED else 1
        self.rows = np.zeros((-(-len(own) // self.width), self.common), np.float32)
        self.rest, self.rest_sizes = np.zeros((len(own), self.words), np.uint64), np.zeros(len(own))
        for i, x in enumerate(self.order):
            place = self.rank[np.searchsorted(self.grams, own[x])]
            self.rows[i // self.width, place[place < self.common]] += PACKED if i % self.width else 1
            flags = np.zeros((1, len(often)), np.uint8)
            flags[0, place] = 1
            self.rest[i], self.rest_sizes[i] = self.bits(flags)[0], np.count_nonzero(place >= self.common)
        self.letters = np.full(1 << 15, -1)
        if k <= 3:  # places of the k-mers of capitals
            parts = [((self.grams >> np.uint64(21 * i)) & np.uint64((1 << 21) - 1)).astype(np.int64) for i in range(3)]
            plain = np.logical_and.reduce([(x == 0) | ((x >= 66) & (x <= 91)) for x in parts])
            numbers = sum(np.maximum(x - 65, 0) << (5 * i) for i, x in enumerate(parts))
            self.letters[numbers[plain]] = self.rank[plain]

    @property
    def words(self) -> int:
        return -(-(len(self.grams) - self.common) // 64)

    def bits(self, flags: np.ndarray) -> np.ndarray:
        """The columns of the rest as words of 64 bits."""
        out = np.zeros((len(flags), self.words * 8), np.uint8)
        packed = np.packbits(flags[:, self.common :], axis=1)
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def matrix(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of texts over the queries' first k-mers, bits of the rest and their number, and the sizes of the texts' whole sets."""
        theirs, total, seen = np.zeros((len(texts), len(self.grams)), np.uint8), np.zeros(len(texts)), np.zeros(1 << 15, bool)
        for i, text in enumerate(texts):
            found = letter_grams(text, self.k)
            if found is not None:
                seen[found] = True
                total[i] = np.count_nonzero(seen)
                seen[found] = False
                place = self.letters[found]
                theirs[i, place[place >= 0]] = 1
            else:
                found = kmer_set(text, self.k)
                place = np.searchsorted(self.grams, found)
                place[place == len(self.grams)] = 0
                theirs[i, self.rank[place[self.grams[place] == found]] if len(self.grams) else []] = 1
                total[i] = len(found)
        rest = np.count_nonzero(theirs[:, self.common :], axis=1).astype(float)
        return theirs[:, : self.common].astype(np.float32), self.bits(theirs), rest, total


def nearest_kmer_sets(queries: list[tuple], k: int, top: int, name: str | None = None):
    """mapInPandas over (r, r_seq): of all rows of a task the `top` of largest Jaccard similarity to each query's text, ties to the smaller r; rows (q, r, jaccard).

    A query may have a bound as a third value: rows below it are left out. Neither they nor
    sets whose size alone keeps them below are looked at further; a task's own `top` rows
    raise its bounds. Equal texts of a batch are compared once, with their `top` smallest
    ids. A task keeps `top` rows a query, however many it reads. `name` names the block of
    queries, which a process then prepares once, not once a task.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = _prepared.get(name) if name else None
        if got is None:
            got = QueryGrams([(x[0], x[1], x[2] if len(x) > 2 else 0.0) for x in queries], k)
            if name:
                _prepared.clear()
                _prepared[name] = got
        ids = np.array([x[0] for x in queries])[got.order]
        bounds, sizes, width = got.bounds.copy(), got.sizes, got.width
        held: list[tuple] = []
        new = 0

        def shrink() -> None:
            """Keeps the `top` rows of each query and raises the bounds to the last of them."""
            nonlocal held, new
            if not held:
                return
            q, r, j = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((r, -j, q))
            q, r, j = q[order], r[order], j[order]
            start = np.searchsorted(q, np.arange(len(ids)))
            place = np.arange(len(q)) - start[q]
            last = place == top - 1
            bounds[q[last]] = np.maximum(bounds[q[last]], j[last])
            keep = place < top
            held, new = [(q[keep], r[keep], j[keep])], 0

        for rows in batches:
            rows = rows.sort_values(["r_seq", "r"], ignore_index=True)
            every, texts = rows["r"].to_numpy(), rows["r_seq"].to_numpy()
            first = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1]))) if len(texts) else np.zeros(0, int)
            copies = np.minimum(np.diff(np.append(first, len(texts))), top)
            texts = texts[first]
            lengths = np.array([len(t) for t in texts])
            by_length = np.argsort(lengths, kind="stable")  # sets of near sizes meet together
            for a in range(0, len(texts), SIDE):
                chosen = by_length[a : a + SIDE]
                theirs, their_rest, rest, total = got.matrix(texts[chosen])
                low, high = max(total.min(), 1.0), max(total.max(), 1.0)
                reach = np.minimum(np.minimum(np.maximum(sizes, 1.0) / low, high / np.maximum(sizes, 1.0)), 1.0)
                near = np.unique(np.flatnonzero(reach >= bounds) // width)
                for b in range(0, len(near), SIDE_QUERIES):
                    some = near[b : b + SIDE_QUERIES]
                    both = got.rows[some] @ theirs.T
                    upper = np.floor(both / PACKED) if width == 2 else None
                    for half, overlap in enumerate([both] if width == 1 else [both - PACKED * upper, upper]):
                        at = some * width + half
                        if at[-1] == len(ids):  # the last row may hold one query
                            at, overlap = at[:-1], overlap[:-1]
                        if not len(at):
                            continue
                        # overlap / (size + total - overlap) >= bound, and a little less for rounding; the rest may add the smaller number
                        def reaches(rows: np.ndarray, overlap: np.ndarray) -> np.ndarray:
                            share = (bounds[rows] / (1 + bounds[rows])).astype(np.float32)
                            need = share[:, None] * (sizes[rows].astype(np.float32)[:, None] + total.astype(np.float32))
                            need -= np.float32(0.02)
                            if got.words:
                                need -= np.minimum(got.rest_sizes[rows].astype(np.float32)[:, None], rest.astype(np.float32))
                            return overlap >= need

                        met = reaches(at, overlap)
                        many = np.flatnonzero(np.count_nonzero(met, axis=1) > top)
                        if len(many):  # texts have an id at least and the rest only adds, so the top-th text bounds the top-th row
                            j = overlap[many].astype(float)
                            j /= np.maximum(sizes[at[many]][:, None] + total - j, 1.0)
                            floor = np.partition(j, j.shape[1] - top, axis=1)[:, j.shape[1] - top]
                            bounds[at[many]] = np.maximum(bounds[at[many]], floor)
                            met[many] = reaches(at[many], overlap[many])
                        i, c = np.divmod(np.flatnonzero(met), met.shape[1])
                        q, j = at[i], overlap[i, c].astype(float)
                        if got.words:
                            for d in range(0, len(q), HELD // 64):
                                few = slice(d, d + HELD // 64)
                                j[few] += np.bitwise_count(got.rest[q[few]] & their_rest[c[few]]).sum(1)
                        j /= np.maximum(sizes[q] + total[c] - j, 1.0)
                        sure = j >= bounds[q]
                        q, j, c = q[sure], j[sure], chosen[c[sure]]
                        if len(q):
                            times = copies[c]
                            of = np.repeat(np.arange(len(q)), times)
                            step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                            held.append((q[of], every[first[c][of] + step], j[of]))
                            new += len(of)
                        if new > HELD:
                            shrink()
            shrink()
        if held:
            q, r, j = held[0]
            yield pd.DataFrame({"q": ids[q], "r": r, "jaccard": j})

    return kernel


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table as the bits of two whole numbers at a time."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    codes = _codes(a)
    bits = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    full = (1 << len(a)) - 1
    up, down = full, 0  # where the distance grows and falls by one from row to row
    for c in b:
        eq = bits.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        right, left = down | ~(xh | up) & full, up & xh
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(xv | right)) & full, right & xv & full
    return len(b) + up.bit_count() - down.bit_count()


#: Words of 64 bits of the tables of letters that distances of several pairs may fill, pairs at a time, steps of them together against those of
#: each alone, and words below which whole numbers are faster.
TABLE_WORDS, LANES, FILL, LEAST_WORDS = 1 << 20, 64, 1.5, 256


def edit_distances(left: list[str], right: list[str]) -> list[int]:
    """Levenshtein distances of pairs, many at a time: in one step each word of 64 bits of each pair takes its next letter, one behind the word before it.

    Pairs of near lengths go together. Their shorter texts are made equally long by a
    letter of no text, as many of them at the end of both: that leaves the distance as it is.
    """
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in zip(left, right, strict=True)]
    out = [0] * len(pairs)
    order = sorted((i for i, (a, b) in enumerate(pairs) if a != b), key=lambda i: (int(4 * math.log(len(pairs[i][1]) + 1)), len(pairs[i][0])))
    while order:
        some, steps, longer, words, own, letters = [], 0, 0, 0, 0, set()
        while order and len(some) < LANES:
            a, b = pairs[order[-1]]
            s, x = max(steps, len(b)), max(longer, len(a) - len(b))
            w, mine, kinds = -(-(s + x) // 64), len(b) * -(-len(a) // 64), letters.union(a, b)
            if some and (s * w * (len(some) + 1) > FILL * (own + mine) or w * (len(kinds) + 1) * (len(some) + 1) > TABLE_WORDS):
                break
            steps, longer, words, own, letters = s, x, w, own + mine, kinds
            some.append(order.pop())
        if words * (len(some) + 1) < LEAST_WORDS or words * (len(letters) + 1) > TABLE_WORDS or steps == 0:
            for i in some:
                out[i] = edit_distance(*pairs[i])
        else:
            for i, d in zip(some, _edit_distances([pairs[i] for i in some], steps, words), strict=True):
                out[i] = d
    return out


def _edit_distances(pairs: list[tuple[str, str]], steps: int, words: int) -> list[int]:
    n = len(pairs)
    alphabet, codes = np.unique(np.concatenate([_codes(s) for pair in pairs for s in pair]), return_inverse=True)
    kinds, at = len(alphabet) + 1, 0
    table = np.zeros((words, kinds, n), np.uint64)  # bits of the places of a letter in the longer text
    letters = np.full((steps, n), kinds - 1)  # of the shorter text, last letter first
    sizes = []
    for i, (a, b) in enumerate(pairs):
        x, y = codes[at : at + len(a)], codes[at + len(a) : at + len(a) + len(b)]
        at += len(a) + len(b)
        x = np.concatenate([x, np.full(steps - len(b), kinds - 1)])
        place = np.arange(len(x))
        np.bitwise_or.at(table, (place >> 6, x, i), np.uint64(1) << (place & 63).astype(np.uint64))
        letters[steps - len(b) :, i] = y[::-1]
        sizes.append(len(x))
    for i, (_, b) in enumerate(pairs):  # what was added stands at the end, so first here
        letters[: steps - len(b), i] = kinds - 1
    table, letters = table.reshape(-1), letters * n
    base = np.arange(words)[:, None] * (kinds * n) + np.arange(n)
    full, one, last = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1), np.uint64(63)
    up, down = np.full((words, n), full), np.zeros((words, n), np.uint64)
    # what a word hands to the next one: the distance to its last row grows or falls by one; above the first word it grows
    more, less = np.zeros((words + 1, n), np.uint64), np.zeros((words + 1, n), np.uint64)
    more[0] = one
    at_, eq_, xv_, xh_ = np.empty((words, n), np.int64), np.empty((words, n), np.uint64), np.empty((words, n), np.uint64), np.empty((words, n), np.uint64)
    for t in range(steps + words - 1):
        lo, hi = max(0, t - steps + 1), min(words, t + 1)
        p, m, grow, fall, eq, xv, xh = up[lo:hi], down[lo:hi], more[lo:hi], less[lo:hi], eq_[lo:hi], xv_[lo:hi], xh_[lo:hi]
        place = np.add(base[lo:hi], letters[steps - 1 - t + lo : steps - 1 - t + hi], out=at_[lo:hi])
        np.take(table, place, out=eq, mode="clip")
        np.bitwise_or(eq, m, out=xv)
        eq |= fall
        np.bitwise_and(eq, p, out=xh)
        xh += p
        xh ^= p
        xh |= eq
        right = np.bitwise_or(xh, p, out=eq)
        np.invert(right, out=right)
        right |= m
        left = xh
        left &= p
        # the shifted bits, with what the word above hands down, before that is written over
        np.left_shift(right, one, out=m)
        m |= grow
        np.left_shift(left, one, out=p)
        p |= fall
        np.right_shift(right, last, out=more[lo + 1 : hi + 1])
        np.right_shift(left, last, out=less[lo + 1 : hi + 1])
        np.bitwise_or(xv, m, out=right)
        np.invert(right, out=right)
        p |= right
        m &= xv
    inside = np.clip(np.array(sizes) - np.arange(words)[:, None] * 64, 0, 64)
    mask = np.where(inside == 64, full, (one << (inside % 64).astype(np.uint64)) - one)
    change = np.bitwise_count(up & mask).sum(0, dtype=np.int64) - np.bitwise_count(down & mask).sum(0, dtype=np.int64)
    return [int(x) for x in steps + change]


#: Places, by what lengths allow, of the pairs of a query that are compared at a time.
ROUNDS = ((0, 3), (3, 8), (8, 16), (16, 1 << 30))


def shortlist_identities(shortlist: int):
    """mapInPandas over (rep, r, rank, jaccard, q_seq, r_seq): rows (rep, r, rank, jaccard, identity), identity being 1 - edit distance / longer length.

    Equal and null texts have 1. A pair whose lengths keep it below the two best of its
    query's first `shortlist` ranks can be nobody's best, even if one of the two is the
    query itself: its distance is not counted and its identity is null.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, y = rows["q_seq"].to_numpy(), rows["r_seq"].to_numpy()
            same = np.array([s is None or t is None or s == t for s, t in zip(x, y, strict=True)], bool)
            sizes = np.array([[0 if s is None else len(s) for s in side] for side in (x, y)]).reshape(2, len(rows))
            longer = np.maximum(sizes.max(0), 1)
            bound = np.where(same, 1.0, 1 - np.abs(sizes[0] - sizes[1]) / longer)
            identity = np.where(same, 1.0, np.nan)
            rep, counts = np.unique(rows["rep"].to_numpy(), return_inverse=True)[1], rows["rank"].to_numpy() <= shortlist
            order = np.lexsort((-bound, rep))
            place = np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows)) - np.searchsorted(rep[order], rep[order])
            for low, high in ROUNDS:
                # the second best so far of each query
                known = np.flatnonzero(counts & ~np.isnan(identity))
                known = known[np.lexsort((-identity[known], rep[known]))]
                second = np.full(len(rows), -1.0)
                seconds = np.arange(len(known)) - np.searchsorted(rep[known], rep[known]) == 1
                second[rep[known[seconds]]] = identity[known[seconds]]
                asked = np.flatnonzero((place >= low) & (place < high) & np.isnan(identity) & (bound >= second[rep]))
                identity[asked] = 1 - np.array(edit_distances([x[i] for i in asked], [y[i] for i in asked])) / longer[asked]
            yield rows[["rep", "r", "rank", "jaccard"]].assign(identity=identity)

    return kernel


def letters(column: str, old: str = "", new: str = "") -> Column:
    """The A-Z letters of a text in capitals, those of `old` replaced by those of `new`; null of null."""
    table = bytes.maketrans((LETTERS.lower() + old + old.lower()).encode(), (LETTERS.translate(str.maketrans(old, new)) + new + new).encode())
    drop = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalpha())

    @F.pandas_udf(StringType())
    def kernel(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x.encode().translate(table, drop).decode(), na_action="ignore")

    return kernel(column)


def window_entropy(s: str, width: int) -> float:
    """Least entropy of any window; of the whole string if it is no longer than one."""
    if not s:
        return 0.0
    codes, inverse = np.unique(_codes(s), return_inverse=True)
    n = len(inverse)
    width = n if width <= 1 or n <= width else width
    table = np.array([0.0] + [k / width * math.log2(k / width) for k in range(1, width + 1)])
    total = np.zeros(n - width + 1)
    for c in range(len(codes)):
        sums = np.concatenate(([0], np.cumsum(inverse == c)))
        total += table[sums[width:] - sums[:-width]]
    return float(max(0.0, (-total).min()))


def min_window_entropy(width: int):
    @F.pandas_udf(DoubleType())
    def kernel(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda x: window_entropy(x, width))

    return kernel


def tandem(s: str) -> float:
    """Largest share of equal places between a block and the same-sized block 0 to MAX_GAP places behind it."""
    codes, best = _codes(s or ""), 0.0
    for block in BLOCKS:
        for gap in range(MAX_GAP + 1):
            shift = block + gap
            same = codes[shift:] == codes[:-shift] if len(codes) > shift else np.zeros(0, bool)
            if len(same) >= block:
                sums = np.concatenate(([0], np.cumsum(same)))
                best = max(best, float((sums[block:] - sums[:-block]).max()) / block)
    return best


def tandem_similarity(column: str) -> Column:
    @F.pandas_udf(DoubleType())
    def kernel(s: pd.Series) -> pd.Series:
        return s.fillna("").map(tandem)

    return kernel(column)


def repeat_length(s: str, least: int = 1) -> int:
    """Length of the longest substring that occurs twice without overlap; 0 below `least`.

    Lengths are doubled until none is found, then bisected. Substrings of 2^j characters
    are numbered by doubling, and one of any length by the numbers of the two that cover
    it; a substring that occurs once has no number and no part in longer ones, so what is
    looked at shrinks to what repeats.
    """
    n = len(s or "")
    if n < 2:
        return 0
    bits = n.bit_length()
    numbers = [np.unique(_codes(s), return_inverse=True)[1].astype(np.int64)]

    def covered(k: int, w: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the substrings of length k whose two ends of w characters repeat, in order of text and place; and where a text begins."""
        a, b = left[: n - k + 1], left[k - w : n - w + 1]
        at = np.flatnonzero((a >= 0) & (b >= 0))
        if bits <= 21:  # both numbers and the place fit one
            both = (((a[at] << bits) | b[at]) << bits) | at
            both.sort()
            at, pair = both & ((1 << bits) - 1), both >> bits
        else:
            pair = (a[at] << bits) | b[at]
            order = np.argsort(pair, kind="stable")
            at, pair = at[order], pair[order]
        fresh = np.ones(len(at), dtype=bool)
        np.not_equal(pair[1:], pair[:-1], out=fresh[1:])
        return at, fresh, np.flatnonzero(fresh)

    def again(k: int) -> bool:
        p = k.bit_length() - 1
        while len(numbers) <= p:
            w = 1 << (len(numbers) - 1)
            at, fresh, heads = covered(2 * w, w, numbers[-1])
            own = np.cumsum(fresh) - 1
            several = np.diff(np.append(heads, len(at)))[own] > 1
            number = np.full(n - 2 * w + 1, -1, np.int64)
            number[at[several]] = own[several]
            numbers.append(number)
        at, fresh, heads = covered(k, 1 << p, numbers[p])
        return bool(len(at)) and bool((at >= at[heads][np.cumsum(fresh) - 1] + k).any())

    low, high = 0, n // 2
    while low < high:
        k = min(high, 2 * low or 1)
        if not again(k):
            high = k - 1
            break
        low = k
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if again(k) else (low, k - 1)
    return low if low >= least else 0


def longest_repeat(column: str) -> Column:
    @F.pandas_udf(LongType())
    def kernel(s: pd.Series) -> pd.Series:
        return s.fillna("").map(repeat_length)

    return kernel(column)


def mask_repeats(s: str, k: int) -> str:
    """The string with every later, non-overlapping copy of an earlier k-mer as X."""
    s = s or ""
    m = len(s) - k + 1
    if m < 2:
        return s
    codes = _codes(s)
    kinds, letters = np.unique(codes, return_inverse=True)
    grams, upto = np.zeros(m, np.int64), 1
    for i in range(k):
        if upto * len(kinds) >= 1 << 62:  # number anew what no longer fits
            grams = np.unique(grams, return_inverse=True)[1].astype(np.int64)
            upto = m
        grams, upto = grams * len(kinds) + letters[i : m + i], upto * len(kinds)
    order = np.argsort(grams, kind="stable")
    fresh = np.ones(m, dtype=bool)
    fresh[1:] = grams[order[1:]] != grams[order[:-1]]
    first = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    again = order[order >= first + k]
    edges = np.bincount(again, minlength=len(s) + 1) - np.bincount(again + k, minlength=len(s) + 1)
    return np.where(np.cumsum(edges)[:-1] > 0, np.uint32(ord("X")), codes).astype(np.uint32).tobytes().decode("utf-32-le")


def masked_repeats(k: int):
    @F.pandas_udf(StringType())
    def kernel(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda x: mask_repeats(x, k))

    return kernel


def binomial_bounds(successes: int, total: int, alpha: float = 0.05) -> tuple[float, float]:
    """Clopper-Pearson bounds by bisection on the binomial distribution function."""

    def cdf(k: int, p: float) -> float:
        if p <= 0.0:
            return 1.0
        if p >= 1.0:
            return 1.0 if k >= total else 0.0
        logs = [math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1) + i * math.log(p) + (total - i) * math.log1p(-p) for i in range(k + 1)]
        return min(1.0, math.fsum(map(math.exp, logs)))

    def solve(k: int, target: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(80):
            p = (low + high) / 2
            low, high = (p, high) if cdf(k, p) > target else (low, p)
        return (low + high) / 2

    low = 0.0 if successes == 0 else solve(successes - 1, 1 - alpha / 2)
    high = 1.0 if successes == total else solve(successes, alpha / 2)
    return low, high


def clopper_pearson(successes: str, total: str) -> Column:
    """Struct of bounds, for already aggregated rows."""
    kind = StructType([StructField("low", DoubleType()), StructField("high", DoubleType())])

    @F.pandas_udf(kind)
    def kernel(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([binomial_bounds(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["low", "high"])

    return kernel(F.col(successes), F.col(total))
