"""Operator 4, language ID: rank-order profiles.

A profile is the PROFILE most frequent character n-grams (1 to 3 letters, words padded
at both ends) in order of frequency. A document's profile is compared to each
language's by out-of-place distance: for each of its n-grams the difference of ranks,
or the full length for an n-gram that the language's profile lacks. The nearest
language wins. Profiles are learnt from a bounded sample, PER_LANGUAGE documents of
each language, and are a few KB each; documents are scored in the scan, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import bounded_sample, bounded_texts, id_crc
from .tokens import slices

PROFILE = 300
PER_LANGUAGE = 400
PIECE = 1 << 18  # places of a text that are counted together
_SLICE = 2 << 20
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For every code point itself if it is a letter, else 0."""
    if not _letters:
        _letters.append(np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], dtype=np.uint32))
    return _letters[0]


def _places(text: str) -> Iterator[np.ndarray]:
    """Letters of a text and 0 for each run of other characters, about PIECE characters at a time, from a 0 to a 0."""
    at, inside = 0, False
    yield np.zeros(1, np.uint32)
    while at < len(text):
        to = min(at + PIECE, len(text))
        while to < min(at + 2 * PIECE, len(text)) and text[to - 1].isalpha():
            to += 1  # lower() looks at the letters around
        codes = np.frombuffer(text[at:to].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = _letter_table()[codes]
        solid = letters > 0
        keep = solid.copy()
        keep[1:] |= solid[:-1]  # one place for each run of other characters
        keep[0] |= inside
        inside = bool(solid[-1])
        at = to
        yield letters[keep]
    yield np.zeros(1, np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers, ascending, and their counts. Long texts are read and counted a piece at a time."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rest = np.zeros(0, np.uint32)
    pieces, last = _places(text), False
    while not last:
        parts, size = [rest], len(rest)
        while size < PIECE + 2 and not last:
            piece = next(pieces, None)
            last = piece is None
            if not last:
                parts.append(piece)
                size += len(piece)
        whole = np.concatenate(parts)
        most = len(whole) if last else len(whole) - 2  # the last two places begin n-grams of the next piece
        rest = whole[most:]
        found = _gram_codes(whole.astype(np.uint64), most) if len(whole) > 1 else np.zeros(0, np.uint64)
        found.sort()
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
        more = np.diff(np.append(first, len(found)))
        if not len(keys):
            keys, counts = found[first], more
        else:
            both, place = np.unique(np.concatenate([keys, found[first]]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, more]), len(both)).astype(np.int64)
            keys = both
    return keys, counts


def _gram_codes(c: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the n-grams that begin among the first `most` places; 0 is the place between words."""
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = ((c[:-2] << np.uint64(42)) | two[1:])[:most][c[1:-1][:most] > 0]
    one, two = c[:most], two[:most]
    return np.concatenate([one[one > 0], two[two > 0] | np.uint64(1) << np.uint64(63), three | np.uint64(1) << np.uint64(62)])


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent keys, most frequent first; ties by key."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """Language profiles as one table: for each known n-gram its rank in every language."""

    def __init__(self, texts: list[tuple[str, str]], most: int = PROFILE):
        self.most = most
        self.names = sorted({lang for lang, _ in texts})
        found = []
        for name in self.names:
            parts = [grams(t) for lang, t in texts if lang == name]
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)) if len(keys) else np.zeros(0)
            found.append(ranked(keys, counts, most))
        self.keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)  # the last row: in no profile
        for i, keys in enumerate(found):
            self.ranks[np.searchsorted(self.keys, keys), i] = np.arange(len(keys))

    def distances(self, text: str) -> tuple[np.ndarray, int]:
        """Out-of-place distance to each language, and the largest that it can be."""
        own = ranked(*grams(text), self.most)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1) if len(self.keys) else np.zeros(len(own), np.int64)
        if len(self.keys):
            at[self.keys[at] != own] = len(self.keys)
        rank = self.ranks[at]
        apart = np.where(rank < 0, self.most, np.abs(rank - np.arange(len(own))[:, None]))
        return apart.sum(0), len(own) * self.most

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language and 1 - distance / largest distance; UNKNOWN and 0 for text without a letter."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        apart, most = self.distances(text)
        if not most:
            return UNKNOWN, 0.0
        best = int(apart.argmin())
        return self.names[best], 1.0 - float(apart[best]) / most


def fit_profiles(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles of every language among the rows where `learn` holds and text and lang are known; some per_language rows a language (corpus.bounded_sample)."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = bounded_texts(bounded_sample(rows, "lang", "doc_id", per_language, "text"), "doc_id")
    return Profiles(sorted((r["lang"], r["text"]) for r in sample))


def _predict(profiles: Profiles):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", _SLICE)):
            found = [profiles.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return predict


def identify(docs: DataFrame, held_out: Column | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Language of every whole text.

    docs: doc_id long, text string, lang string (learnt from where held_out is false
    and it is not null); other columns are not read. held_out: by default crc32 of
    doc_id as text, mod 5, is 0. Returns doc_id, held_out, lang_pred, score.

    lang_pred is `und` with score 0 where text is null, empty or has no letter, and for
    all rows if nothing can be learnt. Equal distances go to the first name. A null
    doc_id counts as held out. Repeated rows are each answered; an empty table gives
    an empty result. Every language of which the sample holds a text is learnt.
    """
    held_out = id_crc("doc_id", 5) == 0 if held_out is None else held_out
    profiles = fit_profiles(docs, ~held_out, per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(profiles), "doc_id long, held_out boolean, lang_pred string, score double")
