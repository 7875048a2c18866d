"""Byte-level text kernels shared by the llm operators.

Arrow hands a batch of strings over as one UTF-8 buffer plus offsets. The
kernels here work on that buffer with numpy: no Python object is made per word.
A word is a maximal run of bytes other than space and 0x09-0x0D; as those are
ASCII, byte runs and code-point runs agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LONG_WORD = 1 << 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Which bits of eight little-endian bytes the first k of them fill.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each document the index of its first word (n+1)."""
    inside = ~separator[buf]
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def eight_bytes(buf: np.ndarray) -> np.ndarray:
    """A view that holds, for each place of the buffer, the eight bytes from there on as one number (zeros behind the end)."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.

    Eight bytes at a time go through the finaliser, which permutes 64-bit numbers: words
    of up to eight bytes and one length never collide, longer ones as random numbers do.
    """
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = eight_bytes(buf)
    out = mix((at[starts] & FIRST_BYTES[np.minimum(lengths, 8)]) ^ lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    rest = np.flatnonzero((lengths > 8) & (lengths <= _LONG_WORD))
    done = 8
    while len(rest):
        left = lengths[rest] - done
        out[rest] = mix(out[rest] * _BASE + (at[starts[rest] + done] & FIRST_BYTES[np.minimum(left, 8)]))
        done += 8
        rest = rest[left > 8]
    for i in np.flatnonzero(lengths > _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return out


def rolling(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n values from each position on (length len-n+1, or empty), mixed anew at each doubling."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = mix(np.array([seed * 2 + 1], np.uint64))[0] | np.uint64(1)
    out, done = None, 0
    run, width = mix(hashes ^ np.uint64(seed * 0x51ED27 & (1 << 63) - 1)), 1
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, done = run, width
            else:
                m = len(hashes) - done - width + 1
                out = mix(out[:m] * base + run[done : done + m])
                done += width
        rest >>= 1
        if rest:
            run = mix(run[:-width] * base + run[width:])
            width *= 2
    return mix(out)


def doc_of(word_offsets: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))


def window_starts(word_offsets: np.ndarray, n: int) -> np.ndarray:
    """Word positions at which n words of one document begin."""
    counts = np.diff(word_offsets) - n + 1
    counts = np.maximum(counts, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(word_offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total) + shift


def cover(length: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of `length` places lie in a run of `width` from one of the starts."""
    edge = np.zeros(length + 1, dtype=np.int32)
    np.add.at(edge, starts, 1) if len(starts) < 64 else edge.__iadd__(np.bincount(starts, minlength=length + 1)[: length + 1])
    stops = np.minimum(starts + width, length)
    edge -= np.bincount(stops, minlength=length + 1).astype(np.int32)[: length + 1]
    return np.cumsum(edge[:-1]) > 0


def pack_sorted(values: np.ndarray) -> tuple[int, int, bytes]:
    """First value, width and gaps of sorted distinct unsigned numbers; 4-byte gaps where they fit."""
    if not len(values):
        return 0, 4, b""
    gaps = np.diff(values)
    width = 4 if not len(gaps) or int(gaps.max()) < 1 << 32 else 8
    return int(values[0]), width, gaps.astype(np.uint32 if width == 4 else np.uint64).tobytes()


def unpack_sorted(first: int, width: int, payload: bytes, count: int) -> np.ndarray:
    """What pack_sorted packed."""
    out = np.empty(count, dtype=np.uint64)
    if count:
        out[0] = first
        out[1:] = np.frombuffer(payload, dtype=np.uint32 if width == 4 else np.uint64)
        np.cumsum(out, out=out)
    return out


def shard_bounds(values: np.ndarray, shards: int, bits: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """The equal ranges of a bits-wide hash space that hold some of the sorted values, and where each begins among them (one more)."""
    step = min((1 << bits) // shards + 1, (1 << 64) - 1)
    place = values // np.uint64(step)
    fresh = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(values) else np.zeros(0, np.int64)
    return place[fresh].astype(np.int64), np.append(fresh, len(values))
