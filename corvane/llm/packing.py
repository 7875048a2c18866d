"""Operator 9, packing: shortest-pack-first over the length histogram.

Each document is tokenised once and cut into pieces of MAX_LENGTH ids and a rest. Only
the histogram of piece lengths, MAX_LENGTH numbers, goes to the driver, where packing
patterns are built: lengths are placed longest first, each into the patterns that are
emptiest so far, and a pattern carries a count instead of being repeated. Few lengths, or
many equal ones, leave patterns with room that no piece fits; the emptiest of those are
taken apart and their pieces cut at multiples of GRID ids to fill the others, so less than
GRID ids a sequence stay open, and a few sequences at the end. A piece carries the sums of
its blocks of GRID ids, from which those of its parts follow. A pattern's
slots are ranges of ranks, so pieces find their sequence by (length, rank): the rank
is the piece's number within its scan task plus the numbers of earlier tasks, which a
small aggregate gives. Texts and ids are never shuffled; the rows of the pieces, some
50 bytes each and a quarter of a byte for each id, are sorted once to meet those numbers.

The file of pieces is written to the shared folder once; a lost executor loses nothing.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import written
from .tokens import encoder, slices

MAX_LENGTH = 2048
END = 1
GRID = 16  # pieces are cut again at multiples of this
_REFILLS = 8
_SLICE = 2 << 20

_PIECES = "doc_id long, start long, length long, ids_crc32 long, sums binary, doc_tokens long, part long, place long"


def _cut(path: str, end: int, most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met, encode = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64), encoder(path).encode
        for batch in batches:
            for piece in slices(batch, "text", _SLICE):
                ids, bounds = encode(piece.column("text"), end)
                tokens = np.diff(bounds)
                pieces = -(-tokens // most)
                doc = np.repeat(np.arange(len(tokens)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
                length = np.minimum(most, tokens[doc] - start)
                low = (bounds[:-1][doc] + start).tolist()
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(low, length.tolist(), strict=True)]
                sums = [block_sums(view, a, a + n) for a, n in zip(low, length.tolist(), strict=True)]
                # number of each piece among those of its length, in this task
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.searchsorted(ordered, ordered)
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(length)) - first + met[ordered]
                met += np.bincount(length, minlength=most + 1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id").take(pa.array(doc)), "start": start, "length": length,
                    "ids_crc32": np.array(crc, np.int64), "sums": pa.array(sums, pa.binary()), "doc_tokens": tokens[doc],
                    "part": np.full(len(doc), part, np.int64), "place": place,
                })

    return cut


@dataclass(frozen=True)
class Part:
    """A stretch of the pieces of one length: `length` ids from `skip` on of the pieces numbered `rank`, `rank` + 1, ..."""

    length: int
    piece: int
    rank: int
    skip: int = 0

    def behind(self, count: int) -> Part:
        return replace(self, rank=self.rank + count)


Pattern = tuple[tuple[Part, ...], int]


def _open(part: Part, count: int, most: int) -> Iterator[Pattern]:
    """New sequences of `count` parts of one length, each as full as they make it."""
    each = min(most // part.length, count)
    whole, rest = divmod(count, each)
    yield tuple(part.behind(k * whole) for k in range(each)), whole
    if rest:
        yield tuple(part.behind(each * whole + k) for k in range(rest)), 1


def _room(pattern: Pattern, most: int) -> int:
    return most - sum(p.length for p in pattern[0])


def patterns(histogram: dict[int, int], most: int = MAX_LENGTH, grid: int = GRID) -> list[Pattern]:
    """Packing patterns (parts of a sequence, how many sequences) that use up the histogram.

    Shortest pack first; where no open pattern has room, new ones hold as many pieces of
    that length as fit. Sequences that keep room for `grid` ids or more are then filled:
    the emptiest are taken apart and their pieces cut, at multiples of `grid`, to fit.
    """
    open_by_room: dict[int, list[Pattern]] = {}
    for length in sorted(histogram, reverse=True):
        part, left = Part(length, length, 0), histogram[length]
        while left:
            room = max((r for r in open_by_room if r >= length), default=0)
            if not room:
                for made in _open(part, left, most):
                    open_by_room.setdefault(_room(made, most), []).append(made)
                break
            parts, count = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
            used = min(left, count)
            if count > used:
                open_by_room.setdefault(room, []).append((tuple(p.behind(used) for p in parts), count - used))
            open_by_room.setdefault(room - length, []).append(((*parts, part), used))
            part, left = part.behind(used), left - used
    found = [x for room in sorted(open_by_room) for x in open_by_room[room]]
    for _ in range(_REFILLS):
        wasting = [x for x in found if _room(x, most) >= grid]
        if sum(_room(x, most) * x[1] for x in wasting) <= most:
            break
        found = [x for x in found if _room(x, most) < grid] + _refill(wasting, most, grid)
    return found


def _refill(found: list[Pattern], most: int, grid: int) -> list[Pattern]:
    """The same parts in about as few sequences as their ids need: the fullest stay and are filled with the others' parts, cut where they must be."""
    ids = sum((most - _room(x, most)) * x[1] for x in found)
    stay, full, given = -(-ids // most), [], []
    rooms: list[tuple[int, int, Pattern]] = []  # heap: most room first
    for number, (parts, count) in enumerate(sorted(found, key=lambda x: _room(x, most))):
        kept = min(count, stay)
        stay -= kept
        if kept:
            heapq.heappush(rooms, (-_room((parts, kept), most), number, (parts, kept)))
        if count > kept:
            given += [(p.behind(kept), count - kept) for p in parts]
    given.sort(key=lambda x: x[0].length)  # the longest first, from the end
    number = len(found)
    while given and rooms:
        part, left = given.pop()
        room, _, (parts, count) = heapq.heappop(rooms)
        length = part.length if part.length <= -room else -room // grid * grid
        each = max(1, min(-room // length, left // count)) if length == part.length else 1
        used = min(left // each, count)
        if count > used:
            heapq.heappush(rooms, (room, number, (tuple(p.behind(used) for p in parts), count - used)))
        filled = ((*parts, *(replace(part.behind(k * used), length=length) for k in range(each))), used)
        if _room(filled, most) >= grid:
            heapq.heappush(rooms, (-_room(filled, most), number + 1, filled))
        else:
            full.append(filled)
        number += 2
        if left > each * used:
            given.append((part.behind(each * used), left - each * used))
        if length < part.length:
            given.append((replace(part, length=part.length - length, skip=part.skip + length), used))
    out = full + [x for *_, x in rooms]
    for part, left in given:
        out += _open(part, left, most)
    return out


def slots(found: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length of pieces, rows (skip, first rank, length, first sequence, offset), ascending."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    for parts, count in found:
        offset = 0
        for p in parts:
            out.setdefault(p.piece, []).append((p.skip, p.rank, p.length, sequence, offset))
            offset += p.length
        sequence += count
    return {length: np.array(sorted(rows), np.int64) for length, rows in out.items()}


def block_sums(view: memoryview, low: int, high: int, grid: int = GRID) -> bytes:
    """crc32 of each `grid` ids between two places, as 32-bit numbers."""
    return np.array([zlib.crc32(view[4 * a : 4 * min(a + grid, high)]) for a in range(low, high, grid)], "<u4").tobytes()


def part_sum(sums: np.ndarray, skip: int, length: int, grid: int = GRID) -> int:
    """crc32 of `length` ids from `skip` on, a multiple of grid, out of the sums of their blocks."""
    out = 0
    for k in range(skip // grid, -(-(skip + length) // grid)):
        blank = bytes(4 * min(grid, skip + length - k * grid))
        # crc(a b) is crc(a) carried over as many zero bytes as b has, and crc(b)
        out = zlib.crc32(blank, out) ^ zlib.crc32(blank) ^ int(sums[k])
    return out


def _seat(places: dict[int, np.ndarray]):
    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            order = np.argsort(whole, kind="stable")
            kinds, firsts = np.unique(whole[order], return_index=True)
            row, skip, length, sequence, offset = ([np.zeros(0, np.int64)] for _ in range(5))
            for kind, rows in zip(kinds.tolist(), np.split(order, firsts[1:]), strict=True):
                table = places[kind]
                width = int(max(table[:, 1].max(), rank[rows].max())) + 1
                keys, at = table[:, 0] * width + table[:, 1], np.zeros(len(rows), np.int64)
                while len(rows):
                    slot = table[np.searchsorted(keys, at * width + rank[rows], side="right") - 1]
                    for column, values in ((row, rows), (skip, at), (length, slot[:, 2]), (sequence, slot[:, 3] + rank[rows] - slot[:, 1]), (offset, slot[:, 4])):
                        column.append(values)
                    at = at + slot[:, 2]
                    rows, at = rows[at < kind], at[at < kind]
            row, skip, length, sequence, offset = (np.concatenate(x) for x in (row, skip, length, sequence, offset))
            crc, sums = batch.column("ids_crc32").to_numpy()[row], batch.column("sums")
            for k in np.flatnonzero(length < whole[row]).tolist():
                crc[k] = part_sum(np.frombuffer(sums[int(row[k])].as_py(), "<u4"), int(skip[k]), int(length[k]))
            take = pa.array(row)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(take), "start": batch.column("start").to_numpy()[row] + skip, "length": length,
                "ids_crc32": crc, "doc_tokens": batch.column("doc_tokens").take(take), "sequence_id": sequence, "offset": offset,
            })

    return seat


def pack(docs: DataFrame, vocabulary: str, end: int = END, most: int = MAX_LENGTH) -> DataFrame:
    """Pack all documents into sequences of at most `most` ids.

    docs: doc_id long, text string; other columns are not read. vocabulary: path of a
    tokenizers JSON file, the same on every machine. One row per piece: doc_id, start
    (the document's ids before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit numbers), doc_tokens (with the end id), sequence_id, offset
    (gapless from 0). A sequence whose length is a power of two needs no padding; any
    other is padded to `most` by whoever reads it.

    Null and empty texts are the end id alone. Null and repeated ids are packed like
    any others, a row at a time. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(docs.mapInArrow(_cut(vocabulary, end, most), _PIECES), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # one row per scan task in each window, not one per piece
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(by_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"), "ranks")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "sums", "doc_tokens", "rank").mapInArrow(_seat(slots(patterns(histogram, most))), schema)
