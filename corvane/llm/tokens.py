"""Whole-text tokenisation with a public vocabulary, mostly by lookup.

Both vocabularies split a text at white space before merging, so a text's ids are
those of its chunks (white space, then the bytes up to the next white space) one after
the other. A special token's string is a chunk of its own, as it is for the library.
Chunks repeat; a worker keeps the ids of those it has met, finds them by a 64-bit hash,
compares their bytes, and asks the tokenizers library only for new ones, many at a
time. The store is numpy arrays of some 60 bytes a chunk; when it holds CACHE chunks,
those met once only are dropped, and all of them if that is not enough.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from . import textkit as tk

CACHE = 1_200_000
#: Code points of Unicode White_Space beyond ASCII, which the vocabularies' patterns mean by \\s.
_WIDE_SPACE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_MARK = "|"
_TOGETHER = 256  # chunks that the library encodes as one text; longer texts cost it more a byte


def space_mask(buf: np.ndarray) -> np.ndarray:
    """Bytes that belong to white space."""
    mask = tk.SEPARATOR[buf]
    for lead in {chr(c).encode()[0] for c in _WIDE_SPACE}:
        at = np.flatnonzero(buf == lead)
        for code in (chr(c).encode() for c in _WIDE_SPACE) if len(at) else ():
            if code[0] == lead:
                here = at[at + len(code) <= len(buf)]
                for k in range(1, len(code)):
                    here = here[buf[here + k] == code[k]]
                for k in range(len(code)):
                    mask[here + k] = True
    return mask


def _agree(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes a[a_starts : +lengths] and b[b_starts : +lengths] are the same; a and b are views of eight_bytes."""
    out = np.ones(len(lengths), dtype=bool)
    rest, done = np.arange(len(lengths)), 0
    while len(rest):
        left = lengths[rest] - done
        out[rest] &= ((a[a_starts[rest] + done] ^ b[b_starts[rest] + done]) & tk.FIRST_BYTES[np.minimum(left, 8)]) == 0
        done += 8
        rest = rest[(left > 8) & out[rest]]
    return out


class Encoder:
    """Encodes texts to ids as the library does without adding special tokens; one that a text spells counts as such."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # a vocabulary without word ends spells every byte of a text as one character, so ids have byte lengths
        self.mark = model["vocab"][_MARK + model["end_of_word_suffix"]] if model["end_of_word_suffix"] else None
        self.widths = np.zeros(1 + max(*model["vocab"].values(), *self.library.get_added_tokens_decoder()), np.int64)
        for word, i in model["vocab"].items():
            self.widths[i] = len(word)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.text_starts = np.zeros(0, np.int64)
        self.text_sizes = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)

    def _trim(self) -> None:
        """Keep the chunks that were met more than once, or none if those fill half of the store."""
        keep = self.uses > 1
        if 2 * int(keep.sum()) > CACHE:
            return self._forget()
        for pool, starts, sizes in (("pool", "starts", "counts"), ("text", "text_starts", "text_sizes")):
            counts, low = getattr(self, sizes)[keep], getattr(self, starts)[keep]
            ends = np.cumsum(counts)
            setattr(self, pool, getattr(self, pool)[np.arange(int(counts.sum())) + np.repeat(low - (ends - counts), counts)])
            setattr(self, starts, ends - counts)
            setattr(self, sizes, counts)
        place = np.cumsum(keep) - 1
        stay = keep[self.entry]
        self.known, self.entry = self.known[stay], place[self.entry[stay]]
        self.uses = np.ones(len(self.starts), np.int64)

    def _alone(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts

    def _together(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that begin with a space and hold more than spaces, encoded as a few texts and cut again."""
        mark = b"" if self.mark is None else f" {_MARK}".encode()
        texts = [(mark.join([*chunks[a : a + _TOGETHER], b""])).decode() for a in range(0, len(chunks), _TOGETHER)]
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.array(x, np.uint32) for x in found])
        if self.mark is None:
            ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
            upto = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
            return ids, np.diff(upto, prepend=0)
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _learn(self, hashes: np.ndarray, chunks: list[bytes], joins: np.ndarray, findable: bool = True) -> None:
        """Store the ids of new chunks; those that `joins` marks are encoded together."""
        order, parts = [], []
        for pick, encode in ((joins, self._together), (~joins, self._alone)):
            at = np.flatnonzero(pick)
            for a in range(0, len(at), 4096):
                part = at[a : a + 4096]
                parts.append(encode([chunks[i] for i in part.tolist()]))
                order.append(part)
        order = np.concatenate(order)
        ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        base = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.uses = np.concatenate([self.uses, np.zeros(len(order), np.int64)])
        self.pool = np.concatenate([self.pool, ids])
        bodies = [chunks[i] for i in order.tolist()]
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.text_starts = np.concatenate([self.text_starts, len(self.text) + np.cumsum(sizes) - sizes])
        self.text_sizes = np.concatenate([self.text_sizes, sizes])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(bodies), np.uint8)])
        if findable:
            fresh = np.argsort(hashes[order])
            place = np.searchsorted(self.known, hashes[order][fresh])
            self.known = np.insert(self.known, place, hashes[order][fresh])
            self.entry = np.insert(self.entry, place, base + fresh)

    def _special_spans(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where the texts spell a special token: leftmost first, of several the longest."""
        found: dict[int, int] = {}
        for word in self.special:
            at = np.flatnonzero(buf[: max(0, len(buf) - len(word) + 1)] == word[0])
            for k in range(1, len(word)):
                if not len(at):
                    break
                at = at[buf[at + k] == word[k]]
            for i in at[np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + len(word) - 1, side="right")].tolist():
                found[i] = max(found.get(i, 0), i + len(word))
        out: list[tuple[int, int]] = []
        for a, b in sorted(found.items()):
            if not out or a >= out[-1][1]:
                out.append((a, b))
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's with `end` behind them, and n+1 offsets; null counts as empty."""
        buf, offsets = tk.text_buffer(texts)
        n = len(offsets) - 1
        space = space_mask(buf)
        begin = np.zeros(len(buf) + 1, dtype=bool)
        begin[:-1] = space
        begin[1:-1] &= ~space[:-1]
        begin[offsets[:-1]] = True
        apart = self._special_spans(buf, offsets)
        for a, b in apart:
            begin[a : b + 1] = False
            begin[[a, b]] = True
        starts = np.flatnonzero(begin[:-1])
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        upto = np.searchsorted(starts, offsets)
        hashes = tk.word_hashes(buf, starts, ends)
        order = np.argsort(hashes)
        ordered = hashes[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
        distinct, example = ordered[fresh], order[fresh]
        if len(self.known) > CACHE:
            self._trim()
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            data = buf.tobytes()
            low, high = starts[example[new]], ends[example[new]]
            joins = space[low] & ~space[high - 1]
            if self.mark is not None:
                marks = np.concatenate(([0], np.cumsum(buf == ord(_MARK))))
                joins &= marks[low] == marks[high]
            self._learn(distinct[new], [data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], joins)
            at = np.searchsorted(self.known, distinct)
        if len(ordered):
            self.uses[self.entry[at]] += np.diff(np.append(np.flatnonzero(fresh), len(ordered)))
        entry = np.empty(len(hashes), np.int64)
        entry[order] = self.entry[at][np.cumsum(fresh) - 1] if len(ordered) else 0
        sizes = ends - starts
        wrong = self.text_sizes[entry] != sizes
        wrong[~wrong] = ~_agree(tk.eight_bytes(buf), starts[~wrong], tk.eight_bytes(self.text), self.text_starts[entry[~wrong]], sizes[~wrong])
        if wrong.any():  # another chunk with the same hash
            at = np.flatnonzero(wrong)
            self._learn(hashes[at], [buf[starts[i] : ends[i]].tobytes() for i in at.tolist()], np.zeros(len(at), bool), findable=False)
            entry[at] = len(self.starts) - len(at) + np.arange(len(at))
        counts = self.counts[entry]
        before = np.concatenate(([0], np.cumsum(counts)))
        bounds = before[upto] + np.arange(n + 1)
        ids = np.empty(int(bounds[-1]), dtype=np.uint32)
        body = np.ones(len(ids), dtype=bool)
        body[bounds[1:] - 1] = False
        ids[~body] = end
        if len(entry):
            step = np.ones(int(before[-1]), np.int64)  # one gather over the pool: +1 within a chunk, a jump between chunks
            full = counts > 0
            first, where = before[:-1][full], self.starts[entry][full]
            if len(first):
                step[first[0]] = where[0]
                step[first[1:]] = where[1:] - (where[:-1] + counts[full][:-1] - 1)
            ids[body] = self.pool[np.cumsum(step)]
        return ids, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of one text column, one row at least."""
    texts = batch.column(column)
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
