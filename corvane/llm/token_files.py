"""Operator 5, token-ID output: frequency-ranked ids in byte-aligned variable-length code.

Ids are numbered anew by how often they occur in the whole corpus, so that frequent
ones are small, and written in 1 to 4 bytes each. The lengths stand apart: a control
byte holds four 2-bit lengths, all control bytes come first and the data bytes after
them. A reader turns control bytes into offsets with a table of 256 entries and gathers
all ids at once with numpy; nothing is decoded bit by bit.

A block, the unit of the files, is self-contained:

    magic "CVB1" | documents u32 | ids u64 | first id's place in the task u64
    | control bytes of the documents' lengths, data bytes
    | control bytes of the ids, data bytes

with each of the two streams led by the u32 count of its data bytes. Blocks hold whole
documents, about BLOCK_IDS ids; the doc_ids stand beside them. The files are rows of
(task, block, doc_ids, payload) in a table in the shared folder, so any store that
Spark writes to will do, and the table ranks.json maps ranks to ids.

One pass tokenises in doc_id order and keeps ids as 16- or 32-bit numbers in the shared
folder together with their counts; the second, over that table, recodes block by block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import drop, partitions, scratch
from .tokens import encoder, slices

END = 2
BLOCK_IDS = 1 << 19
_SLICE = 2 << 20
_MAGIC = b"CVB1"
_HEAD = struct.Struct("<4sIQQ")

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def vbyte(values: np.ndarray) -> bytes:
    """Count of data bytes, control bytes, data bytes."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return struct.pack("<I", len(data)) + control.astype(np.uint8).tobytes() + data.tobytes()


def unvbyte(payload: memoryview, count: int) -> tuple[np.ndarray, int]:
    """The values and how many bytes they took."""
    (size,) = struct.unpack_from("<I", payload)
    control = np.frombuffer(payload, np.uint8, -(-count // 4), 4)
    at = 4 + len(control)
    lengths = _LENGTHS[control].reshape(-1)[:count].astype(np.int64)
    ends = np.cumsum(lengths)
    data = np.concatenate([np.frombuffer(payload, np.uint8, size, at), np.zeros(3, np.uint8)]).astype(np.uint32)
    first = ends - lengths
    values = data[first]
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        values[more] |= data[first[more] + k] << np.uint32(8 * k)
    return values, at + size


def encode_block(lengths: np.ndarray, ranks: np.ndarray, start: int) -> bytes:
    return _HEAD.pack(_MAGIC, len(lengths), len(ranks), start) + vbyte(lengths) + vbyte(ranks)


def decode_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Document lengths, ranks and the place of the first id in its task."""
    view = memoryview(payload)
    magic, documents, ids, start = _HEAD.unpack_from(view)
    if magic != _MAGIC:
        raise ValueError("not a token block")
    lengths, used = unvbyte(view[_HEAD.size :], documents)
    ranks, _ = unvbyte(view[_HEAD.size + used :], ids)
    return lengths.astype(np.int64), ranks, start


_RAW = "task long, block long, start long, doc_ids binary, nulls binary, lengths binary, ids binary, seen binary, counts binary"
_FILE = "task long, block long, doc_ids binary, nulls binary, payload binary"


def _tokenise(path: str, end: int, block_ids: int):
    names = [x.split()[0] for x in _RAW.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 6

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=names)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get().partitionId(), encoder(path).encode
        total = np.zeros(0, np.int64)
        block = start = 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal block, start
            ids = np.concatenate([h[3] for h in held])
            width = np.uint16 if not len(ids) or int(ids.max()) < 1 << 16 else np.uint32
            out = row(task, block, start, *(np.concatenate([h[k] for h in held]).tobytes() for k in range(3)), ids.astype(width).tobytes(), None, None)
            block, start = block + 1, start + len(ids)
            held.clear()
            return out

        for batch in batches:
            for piece in slices(batch, "text", _SLICE):
                ids, bounds = encode(piece.column("text"), end)
                found = np.bincount(ids)
                total = np.pad(total, (0, max(0, len(found) - len(total))))
                total[: len(found)] += found
                names_in = piece.column("doc_id")
                docs, none = names_in.fill_null(0).to_numpy(), names_in.is_null().to_numpy(zero_copy_only=False)
                at = 0
                while at < len(docs):
                    room = block_ids - sum(len(h[3]) for h in held)
                    to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + room, side="right")) - 1)
                    held.append((docs[at:to].astype("<i8"), none[at:to].astype(np.uint8), np.diff(bounds[at : to + 1]).astype("<i8"), ids[bounds[at] : bounds[to]]))
                    at = to
                    if sum(len(h[3]) for h in held) >= block_ids or at < len(docs):
                        yield flush()
        if held:
            yield flush()
        if len(total):
            seen = np.flatnonzero(total)
            yield row(task, -1, start, None, None, None, None, seen.astype("<i8").tobytes(), total[seen].astype("<i8").tobytes())

    return tokenise


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seen, counts in zip(batch.column("seen").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_pydict({"id": np.frombuffer(seen, "<i8"), "n": np.frombuffer(counts, "<i8")})


def _recode(rank_of: np.ndarray):
    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<i8")
                ids = np.frombuffer(r["ids"], np.uint16 if len(r["ids"]) == 2 * int(lengths.sum()) else np.uint32)
                payload = encode_block(lengths, rank_of[ids], r["start"])
                row = (r["task"], r["block"], r["doc_ids"], r["nulls"], payload)
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, [pa.int64()] * 2 + [pa.binary()] * 3, strict=True)], names=["task", "block", "doc_ids", "nulls", "payload"])

    return recode


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text and write path/blocks and path/ranks, documents in ascending doc_id order.

    docs: doc_id long, text string; other columns are not read. Null and empty texts
    are the end id alone. Null ids come first; rows of equal id, or without one, stand in
    the order of a hash of their texts, which spreads them over tasks. An empty table
    gives files without blocks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.repartitionByRange(max(partitions(spark), 1), *place).sortWithinPartitions(*place, "text")
    raw = f"{path}/raw"
    ordered.mapInArrow(_tokenise(vocabulary, end, block_ids), _RAW).write.option("compression", "zstd").parquet(raw)
    table = spark.read.schema(_RAW).parquet(raw)
    spread = table.filter("block = -1").select("seen", "counts").mapInArrow(_spread, "id long, n long")
    counts = sorted((-r["n"], r["id"]) for r in spread.groupBy("id").agg(F.sum("n").alias("n")).collect())  # a row an id of the vocabulary at most
    ids = np.array([i for _, i in counts], np.int64)
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    totals = {r["task"]: r["start"] for r in table.filter("block = -1").select("task", "start").collect()}  # a row a task
    before = np.concatenate(([0], np.cumsum([totals[t] for t in sorted(totals)]))).tolist()
    blocks = table.filter("block >= 0").drop("seen", "counts").mapInArrow(_recode(rank_of), _FILE)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([("id", i, r) for r, i in enumerate(ids.tolist())] + [("start", t, b) for t, b in zip(sorted(totals), before, strict=False)], "kind string, key long, value long").coalesce(1).write.parquet(f"{path}/ranks")
    drop(spark, raw)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """What write_tokens wrote: doc_id, start, n_tokens, ids_crc32 and, with_ids, ids array<long>."""
    key = spark.read.parquet(f"{path}/ranks").collect()  # ids of a vocabulary and one row a task
    id_of = np.zeros(1 + max((r["value"] for r in key if r["kind"] == "id"), default=0), np.uint32)
    for r in key:
        if r["kind"] == "id":
            id_of[r["value"]] = r["key"]
    base = {r["key"]: r["value"] for r in key if r["kind"] == "start"}
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths, ranks, start = decode_block(r["payload"])
                ids = id_of[ranks].astype("<u4", copy=False)
                bounds = np.concatenate(([0], np.cumsum(lengths)))
                view, ends = memoryview(ids).cast("B"), (4 * bounds).tolist()
                out = {
                    "doc_id": pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["nulls"], np.uint8).astype(bool)),
                    "start": base[r["task"]] + start + bounds[:-1],
                    "n_tokens": lengths,
                    "ids_crc32": np.array([zlib.crc32(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    return spark.read.schema(_FILE).parquet(f"{path}/blocks").mapInArrow(read, schema)


def token_output(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write the token files (to the shared scratch folder unless a path is given) and read them back."""
    path = path or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, path)
    return read_tokens(docs.sparkSession, path)
