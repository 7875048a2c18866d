"""Operator 3, n-gram Jaccard join: multiple-global-order filtering.

Under any total order of the tokens, two sets with Jaccard similarity of at least t
share a token among the first n - ceil(t n) + 1 of each. This join orders tokens in
three ways: by rarity with ties by one hash, by rarity with ties by another, and by a
third hash alone. Pairs that share a prefix token under the first order are
candidates; they go on only if they also share one under the second and the third;
then the whole sets are compared. A parity bitmap of each set (every token flips one
of BITMAP * 64 bits) goes with the candidates: two bitmaps differ in no more bits than
the sets do in tokens, so pairs whose bitmaps differ too much are dropped in the join.

Rarity comes from all documents: batches send each distinct shingle hash once to
shards of the hash space and get back a class for each (0: in one set only). A
document in which fewer than ceil(t n) shingles are shared has no link and takes no
further part; in a prefix, unshared shingles fill places without making candidates.

Groups of copies are never expanded into pairs:
1. equal sets fall together, first in each batch and then over the batches;
2. the first tokens of each prefix name a head for each set, and set-head pairs are
   verified: near copies become stars, which form first components;
3. every bucket of the first order that still holds two components has the members
   outside its largest component compared with the members of other components, in
   cells of bounded size that pass all three filters before a pair leaves them, and a
   pair once however many tokens it shares. Each such member first names its CLOSEST
   candidates by bitmap; where a cell held more, the step is repeated on the merged
   components without that limit. So near copies cost a few pairs each, the last step is
   exhaustive, and no link between components is lost; links within one change nothing.

Sets are compared by the hashes of their shingles, 64 bits a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .corpus import BATCH_BYTES, batch_key, batches_and_shards, drop, partitions, scratch, written
from .graph import components
from .tokens import slices

SHINGLE = 3
THRESHOLD = 90  # percent
HEADS = 8  # prefix tokens that name heads in the first round
BITMAP = 16  # longs
CLOSEST = 8  # candidates that a set names in the second round
CELL_BYTES = 4 << 20
CELL_ROWS = 128
_EXPAND = 1 << 20  # token matches looked at together in a cell

Key = tuple[pa.Scalar, ...]
_COUNTS = "shard int, batch int, first long, width int, n long, payload binary, counts binary"
_CLASSES = "batch int, shard int, classes binary"
_SETS = "doc_id long, leader long, n long, set_a long, set_b long, tokens array<long>, order_1 array<long>, order_2 array<long>, order_3 array<long>, " + ", ".join(f"bits_{i} long" for i in range(BITMAP))


def _shingles(table: pa.Table, n: int):
    """Documents in a fixed order; each one's sorted distinct shingle hashes, and where they begin."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    buf, offsets = tk.text_buffer(table.column("text"))
    buf = tk.LOWER[buf]
    starts, ends, words = tk.word_spans(buf, offsets)
    hashes = tk.word_hashes(buf, starts, ends)
    counts = np.diff(words)
    at = tk.window_starts(words, n)
    grams, doc = tk.rolling(hashes, n)[at] if len(at) else np.zeros(0, np.uint64), tk.doc_of(words)[at]
    for k in range(1, n):  # a short document is one shingle, its whole word sequence
        short = np.flatnonzero(counts == k)
        if len(short):
            grams = np.concatenate([grams, tk.rolling(hashes, k, 100 + k)[words[short]]])
            doc = np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    grams, doc = grams[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(counts) + 1)).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        grams[a:b].sort()
    keep = np.ones(len(grams), dtype=bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return table.column("doc_id").to_numpy(), grams, np.searchsorted(doc, np.arange(len(counts) + 1))


def _set_hashes(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits for each set, as two signed columns."""
    out = []
    for salt in (0x9E37, 0x85EB):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(tk.mix(grams ^ np.uint64(salt * 0x1000193)), dtype=np.uint64)))
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return np.stack(out, axis=1)


def _leaders(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each document the first of the batch with an equal, non-empty set."""
    first: dict[tuple[int, int], int] = {}
    sizes = np.diff(bounds).tolist()
    return np.array([i if not n else first.setdefault((a, b), i) for i, (n, (a, b)) in enumerate(zip(sizes, sets.tolist(), strict=True))], dtype=np.int64)


def _distinct_counts(grams: np.ndarray, bounds: np.ndarray, leaders: np.ndarray):
    """The 48-bit hashes of the batch's distinct sets, sorted, and in how many of them each is."""
    own = np.repeat(leaders == np.arange(len(leaders)), np.diff(bounds))
    ordered = np.sort(grams[own] >> np.uint64(16))
    fresh = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return ordered[fresh], np.diff(np.append(fresh, len(ordered))).astype(np.uint32)


def _send(shards: int, n: int):
    def send(key: Key, table: pa.Table) -> pa.Table:
        _, grams, bounds = _shingles(table, n)
        values, counts = _distinct_counts(grams, bounds, _leaders(_set_hashes(grams, bounds), bounds))
        found, edges = tk.shard_bounds(values, shards)
        rows = []
        for s, low, high in zip(found.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            first, width, payload = tk.pack_sorted(values[low:high])
            rows.append((s, key[0].as_py(), first, width, high - low, payload, counts[low:high].tobytes()))
        kinds = {"shard": pa.int32(), "batch": pa.int32(), "first": pa.int64(), "width": pa.int32(), "n": pa.int64(), "payload": pa.binary(), "counts": pa.binary()}
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(kinds.items())})

    return send


def _classify(key: Key, table: pa.Table) -> pa.Table:
    """The rarity class of each hash of a shard: 0 for one set only, then two classes for each doubling."""
    rows = table.to_pylist()
    values = np.concatenate([tk.unpack_sorted(r["first"], r["width"], r["payload"], r["n"]) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    order = np.argsort(values)
    ordered = values[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    total = np.add.reduceat(counts[order], np.flatnonzero(fresh))
    kinds = np.where(total == 1, 0, 1 + np.floor(2 * np.log2(total))).astype(np.uint8)
    out = np.empty(len(values), dtype=np.uint8)
    out[order] = kinds[np.cumsum(fresh) - 1]
    ends = np.cumsum([r["n"] for r in rows])
    return pa.table({
        "batch": pa.array([r["batch"] for r in rows], pa.int32()),
        "shard": pa.array([r["shard"] for r in rows], pa.int32()),
        "classes": pa.array([out[e - r["n"] : e].tobytes() for e, r in zip(ends, rows, strict=True)], pa.binary()),
    })


def _prefixes(grams: np.ndarray, kinds: np.ndarray, size: int) -> list[np.ndarray]:
    """The shared tokens among the first `size` under each of the three orders."""
    out = []
    for k, by_rarity in ((1, True), (2, True), (3, False)):
        place = tk.mix(grams ^ np.uint64(0xA24BAED4963EE407 * k & (1 << 64) - 1))
        if by_rarity:
            place = (place >> np.uint64(8)) | (kinds.astype(np.uint64) << np.uint64(56))
        first = np.argsort(place)[:size]
        out.append(grams[first[kinds[first] > 0]].view(np.int64))
    return out


def _bitmap(grams: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each bit."""
    place = (tk.mix(grams ^ np.uint64(0xB17)) >> np.uint64(40)).astype(np.int64) % (BITMAP * 64)
    return np.packbits((np.bincount(place, minlength=BITMAP * 64) & 1).astype(np.uint8)).view(np.int64)


def _describe(shards: int, n: int, threshold: int):
    kinds_of = {"doc_id": pa.int64(), "leader": pa.int64(), "n": pa.int64(), "set_a": pa.int64(), "set_b": pa.int64(), **dict.fromkeys(("tokens", "order_1", "order_2", "order_3"), pa.list_(pa.int64())), **{f"bits_{i}": pa.int64() for i in range(BITMAP)}}

    def describe(key: Key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = {k: [] for k in kinds_of}
        if docs.num_rows:
            ids, grams, bounds = _shingles(docs, n)
            sets = _set_hashes(grams, bounds)
            leaders = _leaders(sets, bounds)
            values, _ = _distinct_counts(grams, bounds, leaders)
            found, edges = tk.shard_bounds(values, shards)
            place = dict(zip(found.tolist(), edges[:-1].tolist(), strict=True))
            classes = np.zeros(len(values), dtype=np.uint8)
            for r in answers.to_pylist():
                own = np.frombuffer(r["classes"], np.uint8)
                classes[place[r["shard"]] : place[r["shard"]] + len(own)] = own
            kinds = classes[np.searchsorted(values, grams >> np.uint64(16))] if len(values) else np.zeros(len(grams), np.uint8)
            shared = np.concatenate(([0], np.cumsum(kinds > 0)))
            sizes = np.diff(bounds)
            need = -(-sizes * threshold // 100)
            # sets that differ and still link need at least `need` shared tokens and a union of 100 / (100 - threshold)
            alive = (leaders == np.arange(len(ids))) & (sizes > 0) & (shared[bounds[1:]] - shared[bounds[:-1]] >= need) & ((sizes + 1) * (100 - threshold) >= 100)
            out["doc_id"], out["leader"], out["n"] = ids, ids[leaders], sizes
            out["set_a"], out["set_b"] = sets[:, 0], sets[:, 1]
            for i, live in enumerate(alive.tolist()):
                if live:
                    a, b = bounds[i], bounds[i + 1]
                    own = grams[a:b]
                    found = [own[kinds[a:b] > 0].view(np.int64), *_prefixes(own, kinds[a:b], int(sizes[i] - need[i] + 1)), *_bitmap(own).tolist()]
                else:
                    found = [None] * (4 + BITMAP)
                for k, v in zip(list(kinds_of)[5:], found, strict=True):
                    out[k].append(v)
        return pa.table({k: pa.array(v, kinds_of[k]) for k, v in out.items()})

    return describe


_BITS = [f"bits_{i}" for i in range(BITMAP)]


def _count(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                table = pa.table({"doc_id": np.arange(part.num_rows), "text": part.column("text")})
                bounds = _shingles(table, n)[2]
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(np.diff(bounds), pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])

    return count


def _fits(left: str, right: str, threshold: int) -> Column:
    """Whether sizes and bitmaps leave room for the threshold."""
    a, b = F.col(f"{left}n"), F.col(f"{right}n")
    apart = reduce(add, (F.bit_count(F.col(left + c).bitwiseXOR(F.col(right + c))) for c in _BITS))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * threshold) & (apart * (100 + threshold) <= (a + b) * (100 - threshold))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under the other orders, too, and then are similar enough."""

    def with_sides(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
        return pairs

    near = with_sides(pairs.select("a", "b"), "order_2", "order_3").filter(F.arrays_overlap("a_order_2", "b_order_2") & F.arrays_overlap("a_order_3", "b_order_3"))
    near = with_sides(near.select("a", "b").distinct(), "n", "tokens")
    both = F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")
    return near.filter(both * 100 >= (F.col("a_n") + F.col("b_n") - both) * threshold).select("a", "b")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a list column in a row, and where each list begins (n+1)."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


_NEAR = "a long, b long, cut boolean"


def _near(threshold: int, closest: int | None):
    """Pairs of a cell that pass the three orders, the sizes and the bitmaps, each once; of each left set the closest."""

    def near(key: Key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            sides = []
            for t in (left, right):
                bits = np.stack([t.column(c).to_numpy() for c in _BITS], axis=1).view(np.uint64)
                sides.append((*(t.column(c).to_numpy() for c in ("doc_id", "n", "component", "most")), bits, *_flat(t.column("shared"))))
            (ids, n, component, most, bits, tokens, bounds), (r_ids, r_n, r_component, _, r_bits, r_tokens, r_bounds) = sides
            order = np.argsort(r_tokens, kind="stable")
            ordered, row = r_tokens[order], np.repeat(np.arange(len(r_ids)), np.diff(r_bounds))[order]
            low = np.searchsorted(ordered, tokens, side="left")
            count = np.searchsorted(ordered, tokens, side="right") - low
            upto = np.concatenate(([0], np.cumsum(count)))
            prefixes = [[t.column(c).to_pylist() for c in ("order_2", "order_3")] for t in (left, right)]
            at = 0
            while at < len(ids):  # some left sets at a time
                to = max(at + 1, int(np.searchsorted(upto[bounds], upto[bounds[at]] + _EXPAND, side="right")) - 1)
                part = slice(int(bounds[at]), int(bounds[to]))
                c = count[part]
                place = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[part], c)
                mine = np.repeat(np.repeat(np.arange(at, to), np.diff(bounds[at : to + 1])), c)
                x, y = np.divmod(np.unique(mine * len(r_ids) + row[place]), len(r_ids))
                apart = (component[x] != r_component[y]) & ((r_component[y] == most[x]) | (ids[x] < r_ids[y]))
                apart &= np.minimum(n[x], r_n[y]) * 100 >= np.maximum(n[x], r_n[y]) * threshold
                x, y = x[apart], y[apart]
                far = np.zeros(len(x), np.int64)
                for k in range(BITMAP):
                    far += np.bitwise_count(bits[x, k] ^ r_bits[y, k])
                fits = far * (100 + threshold) <= (n[x] + r_n[y]) * (100 - threshold)
                order = np.lexsort((r_ids[y[fits]], far[fits], x[fits]))
                last, met, seen = -1, 0, (set(), set())
                for i, j in zip(x[fits][order].tolist(), y[fits][order].tolist(), strict=True):
                    if i != last:
                        last, met, seen = i, 0, tuple(set(p[i]) for p in prefixes[0])
                    if any(s.isdisjoint(p[j]) for s, p in zip(seen, prefixes[1], strict=True)):
                        continue
                    met += 1
                    if closest is None or met <= closest:
                        a, b = int(ids[i]), int(r_ids[j])
                        for out, v in zip(found, (min(a, b), max(a, b), False), strict=True):
                            out.append(v)
                    else:
                        found[2][-1] = True
                at = to
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64()), "cut": pa.array(found[2], pa.bool_())})

    return near


def _apart(posted: DataFrame, components_: DataFrame, threshold: int, closest: int | None, into: str) -> DataFrame:
    """Candidate pairs of sets in different components that share a prefix token of the first order (_NEAR), written."""
    known = posted.select("doc_id", "n", *_BITS, "order_1", "order_2", "order_3").join(components_.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = known.withColumn("component", F.coalesce("component", "doc_id"))
    post = known.select("doc_id", "component", F.explode("order_1").alias("token"))
    members = components_.groupBy("component").agg(F.count("*").alias("members"))
    sized = post.join(members, "component", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    mixed = sized.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", F.struct("members", "component")).alias("most"))
    mixed = written(mixed.filter("low <> high").select("token", "most"), "mixed", into)
    # what each set shares with the sets around one largest component; a set's tokens bound the list
    shared = written(post.join(mixed, "token"), "shared", into).groupBy("most", "doc_id", "component").agg(F.collect_list("token").alias("shared"))
    rows = written(shared.join(known.drop("component", "order_1"), "doc_id"), "around", into)
    weight = 8 * (F.size("shared") + F.size("order_2") + F.size("order_3") + BITMAP + 4).cast("long")
    outside = (F.col("component") != F.col("most")).cast("long")
    groups = rows.groupBy("most").agg(F.count("*").alias("rows"), F.sum(weight).alias("bytes"), F.sum(outside).alias("left_rows"), F.sum(outside * weight).alias("left_bytes"))
    total = rows.agg(F.count("*").alias("rows"), F.sum(weight).alias("bytes")).first()
    spread = partitions(posted.sparkSession)
    most_rows = min(16 * CELL_ROWS, max(CELL_ROWS, total["rows"] // spread))
    blocks = lambda r, b: F.greatest(F.lit(1), F.ceil(F.col(r) / most_rows), F.ceil(F.col(b) / CELL_BYTES)).cast("int")
    groups = groups.select("most", blocks("left_rows", "left_bytes").alias("down"), blocks("rows", "bytes").alias("across"))
    bins = max(spread, -(-(total["bytes"] or 0) // CELL_BYTES))
    small = (F.col("down") == 1) & (F.col("across") == 1)
    name = F.when(small, F.pmod(F.xxhash64("most"), F.lit(bins))).otherwise(F.col("most"))  # small groups share a cell; its tokens keep them apart
    cells = rows.join(groups, "most").withColumns({"cell": name, "small": small})
    block = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key, columns = ["cell", "small", "i", "j"], ["cell", "small", "doc_id", "n", "component", "most", *_BITS, "shared", "order_2", "order_3"]
    left = cells.filter("component <> most").select(*columns, block("down", 1).alias("i"), every("across").alias("j"))
    right = cells.select(*(F.col(c).alias(c) for c in columns), every("down").alias("i"), block("across", 2).alias("j"))
    return written(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_near(threshold, closest), _NEAR), "near", into)


def ngram_join(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Class of each document under links of Jaccard similarity >= threshold percent over word shingles.

    docs: doc_id long, text string; other columns are not read. Words are lower-cased
    in A-Z only. Returns doc_id, n_shingles (distinct; a document of fewer words than
    a shingle has one) and component_id, the smallest doc_id that links reach.

    Null, empty and blank texts have no shingles and no link. A null doc_id has no
    link and a null component. Rows of equal doc_id count as one node of the graph,
    with one result row each: whatever any of them links with is in one component. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    unnamed = docs.filter("doc_id IS NULL").mapInArrow(_count(shingle), "doc_id long, n_shingles long, component_id long")
    docs = docs.filter("doc_id IS NOT NULL")
    batches, shards = batches_and_shards(docs)
    docs = docs.withColumn("batch", batch_key(batches))
    by_batch = docs.groupBy("batch")
    counts = by_batch.applyInArrow(_send(shards, shingle), _COUNTS)
    classes = counts.groupBy("shard").applyInArrow(_classify, _CLASSES)
    into = scratch(docs.sparkSession, "join")
    base = written(by_batch.cogroup(classes.groupBy("batch")).applyInArrow(_describe(shards, shingle, threshold), _SETS), "shingles", into)

    known = base.filter("n > 0")
    heads = known.filter("doc_id = leader")
    same = written(heads.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep")), "equal", into)
    reps = same.select(F.col("rep").alias("doc_id"))
    posted = known.filter(F.col("tokens").isNotNull()).join(reps, "doc_id", "left_semi")

    # first round: a head for each of the first tokens
    few = posted.select("doc_id", "n", *_BITS, F.explode(F.slice("order_1", 1, HEADS)).alias("token"))
    head = written(few.groupBy("token").agg(F.min(F.struct("doc_id", "n", *_BITS)).alias("head"), F.count("*").alias("c")).filter("c > 1").select("token", "head"), "heads", into)
    pairs = few.join(head, "token").filter(F.col("doc_id") != F.col("head.doc_id")).filter(_fits("", "head.", threshold))
    pairs = pairs.select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = written(_verified(pairs, known, threshold), "links", into)

    # an id with several sets joins them: one node of the graph
    sets = F.struct("set_a", "set_b", "n")
    several = base.groupBy("doc_id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).filter("low <> high").select("doc_id")
    several = written(several.join(base.select("doc_id", "set_a", "set_b", "n"), "doc_id"), "several", into)
    links = links.union(several.join(same, ["set_a", "set_b", "n"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))

    # second round: whatever a bucket of the first order still holds apart
    merged = components(links, into)
    for closest in (CLOSEST, None):
        near = _apart(posted, merged, threshold, closest, into)
        more = written(_verified(near.select("a", "b").distinct(), known, threshold), "links", into)
        if not more.isEmpty():
            links = links.union(more)
            merged = components(links, into)
        if near.filter("cut").isEmpty():
            break

    # equal sets of several batches hang on their smallest document
    owner = same.join(merged, same.rep == merged.node, "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    owner = heads.select("doc_id", "set_a", "set_b", "n").join(owner, ["set_a", "set_b", "n"]).groupBy(F.col("doc_id").alias("leader")).agg(F.min("component").alias("component"))
    result = base.select("doc_id", "leader", "n").join(written(owner, "owners", into), "leader", "left")
    # a row without shingles takes the component of its id's other rows
    blank = several.filter("n = 0").select("doc_id").distinct().join(merged, F.col("doc_id") == merged.node, "left").select("doc_id", F.col("component").alias("other"))
    result = result.join(blank, "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.coalesce("other", "doc_id")).alias("component_id"),
    )
    result = written(result, "components")
    drop(docs.sparkSession, into)
    return result.union(unnamed)
