"""Operator 12, ranked lexical search: recursive graph bisection, clustered index, exact stopping.

The index is made for the terms that the queries ask for; postings of others cannot
change a score. One scan counts each document's terms and writes its postings. Documents
are then reordered by recursive graph bisection: a set of documents is cut in halves, and
documents change sides in pairs while that lowers the log-gap cost of the terms'
postings, again and again down to shards of SHARD_DOCS documents. Bisection of the whole
corpus has two parts:

- The top levels are fitted on a sample of SAMPLE_DOCS documents, chosen by hash. Every
  document then goes down that tree, at each node to the side whose cost it raises less.
- Each of the tree's clusters is dealt to groups of about GROUP_DOCS documents (by row
  number, so copies and hot clusters spread), and a group is bisected on all of its
  documents.

A shard is one row of the index: its documents, their impacts (what a term adds to a
score), and each term's largest impact. The sum of those over a query's terms bounds what
any document of the shard can score. A search visits the shards of a task in order of
that bound and stops when it is below the k-th score so far, or below the score that the
query's k-th document in the sample has: nothing behind it can be among the best. A bound
equal to that score is still visited, as a smaller doc_id wins a tie; the index maps its
order back to doc_ids for that. Each task returns k rows a query.

Queries come in blocks of at most MAX_QUERIES and MAX_BYTES of text; the number of
documents, of their terms and of documents holding a term are counted over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .corpus import written
from .tokens import slices

TOP = 50
MAX_QUERIES = 20_000
MAX_BYTES = 8 << 20
SAMPLE_DOCS = 4096
SAMPLE_POSTINGS = 4 << 20
GROUP_DOCS = 2048
SHARD_DOCS = 128
MAX_DEPTH = 8
ROUNDS = 10  # of exchanges between the halves of a set
_TREE_CELLS = 1 << 22  # numbers that the tree of the top levels may hold
_SLICE = 2 << 20
_SHARDS = 64  # looked at together
_NO_ID = np.iinfo(np.int64).max  # a null doc_id, behind all others

#: Bytes that no term holds: ASCII other than digits and letters.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[:128] = True
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    SEPARATOR[_low:_high] = False

_POSTINGS = "row long, doc_id long, n long, terms array<int>, tfs array<long>"
_INDEX = "docs array<long>, owners array<int>, terms array<int>, impacts array<long>, bound_terms array<int>, bounds array<long>"
_FOUND = "item_id long, doc_id long, score long"


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's terms begin (and one more), and the terms' hashes."""
    buf, offsets = tk.text_buffer(texts)
    buf = tk.LOWER[buf]
    starts, ends, words = tk.word_spans(buf, offsets, SEPARATOR)
    return words, tk.word_hashes(buf, starts, ends)


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (count of them) for each entry, in a row."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


@dataclass
class Queries:
    """A bounded block of queries: their ids and distinct terms, as numbers of the vocabulary (sorted hashes)."""

    ids: list[int]
    terms: list[np.ndarray]
    vocabulary: np.ndarray

    def by_term(self) -> tuple[np.ndarray, np.ndarray]:
        """The queries that ask for each term, as where its queries begin (and one more) and their numbers."""
        term = np.concatenate([*self.terms, np.zeros(0, np.int64)]).astype(np.int64)
        query = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms])
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1)), query[order]


def query_blocks(queries: DataFrame) -> Iterator[Queries]:
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.groupBy("item_id").agg(F.min("text").alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] * 5 // (4 * MAX_QUERIES)), -(-(size["bytes"] or 0) * 5 // (4 * MAX_BYTES)))
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else rows
        found = sorted((r["item_id"], r["text"]) for r in part.collect())  # a block
        words, hashes = _terms(pa.array([t for _, t in found], pa.string()))
        vocabulary, number = np.unique(hashes, return_inverse=True)
        terms = [np.unique(number[a:b]) for a, b in zip(words[:-1], words[1:], strict=True)]
        keep = [i for i, t in enumerate(terms) if len(t)]
        if keep:
            yield Queries([found[i][0] for i in keep], [terms[i] for i in keep], vocabulary)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and where each list begins (and one more)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _count(vocabulary: np.ndarray):
    quick = np.zeros(1 << 20, dtype=bool)
    quick[vocabulary >> np.uint64(44)] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                words, hashes = _terms(part.column("text"))
                near = np.flatnonzero(quick[hashes >> np.uint64(44)])
                place = np.minimum(np.searchsorted(vocabulary, hashes[near]), len(vocabulary) - 1)
                hit = vocabulary[place] == hashes[near]
                key, tf = np.unique((np.searchsorted(words, near[hit], side="right") - 1) * len(vocabulary) + place[hit], return_counts=True)
                n = np.diff(words)
                own = np.flatnonzero(n > 0)
                begin = np.searchsorted(key // len(vocabulary), np.append(own, part.num_rows))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(row + np.arange(len(own)), pa.int64()), "doc_id": part.column("doc_id").take(pa.array(own)), "n": pa.array(n[own], pa.int64()),
                    "terms": _lists(key % len(vocabulary), begin, pa.int32()), "tfs": _lists(tf, begin, pa.int64()),
                })
                row += len(own)

    return count


def weights(docs: int, frequencies: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.floor(1000 * np.log((2.0 * docs + 2) / (2.0 * frequencies + 1))).astype(np.int64)


def impacts(tf: np.ndarray, weight: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms adds to its score."""
    m = 50 + (50 * n * docs) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def bisect(term: np.ndarray, begin: np.ndarray, node: np.ndarray, nodes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The side (0 or 1) of each document in its node: halves with low log-gap cost.

    term: the documents' terms in a row; begin: where each document's begin (and one
    more); node: each document's node. Documents keep their order where nothing is to
    be gained.
    """
    size = np.bincount(node, minlength=nodes)
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
    side = rank >= (size[node] + 1) // 2
    owner = np.repeat(np.arange(len(node)), np.diff(begin))
    key, place = np.unique(node[owner] * (int(term.max(initial=0)) + 1) + term, return_inverse=True)
    of_node = key // (int(term.max(initial=0)) + 1)
    both = np.bincount(place, minlength=len(key)).astype(float)
    left, right = ((size + 1) // 2)[of_node].astype(float), (size // 2)[of_node].astype(float)

    def cost(degree: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return degree * np.log2(np.maximum(docs, 1) / np.maximum(degree + 1, 1))

    for _ in range(rounds):
        on_right = side[owner]
        b = np.bincount(place, weights=on_right, minlength=len(key))
        a = both - b
        now = cost(a, left) + cost(b, right)
        gain = np.stack([now - cost(a - 1, left) - cost(b + 1, right), now - cost(a + 1, left) - cost(b - 1, right)])
        total = np.bincount(owner, weights=gain[on_right.astype(np.int64), place], minlength=len(node))
        order = np.lexsort((-total, side, node))
        cell = (node * 2 + side)[order]
        count = np.bincount(cell, minlength=2 * nodes)
        first = np.cumsum(count) - count
        mine = np.flatnonzero(cell % 2 == 0)  # those on the left, best first in each node
        number = mine - first[cell[mine]]
        paired = number < count[cell[mine] + 1]
        x, y = order[mine[paired]], order[first[cell[mine[paired]] + 1] + number[paired]]
        swap = total[x] + total[y] > 1e-9
        if not swap.any():
            break
        side[x[swap]], side[y[swap]] = True, False
    return side.astype(np.int64)


def fit_tree(term: np.ndarray, begin: np.ndarray, depth: int, vocabulary: int) -> list[np.ndarray]:
    """For each level, node and term: how much more a document with the term costs on the left side than on the right."""
    node = np.zeros(len(begin) - 1, np.int64)
    owner = np.repeat(np.arange(len(node)), np.diff(begin))
    levels = []
    for level in range(depth):
        nodes = 1 << level
        side = bisect(term, begin, node, nodes)
        degree = np.bincount((node[owner] * 2 + side[owner]) * vocabulary + term, minlength=2 * nodes * vocabulary).reshape(nodes, 2, vocabulary)
        size = np.maximum(np.bincount(node * 2 + side, minlength=2 * nodes).reshape(nodes, 2, 1), 1)
        marginal = np.log2(size / (degree + 1.0))
        levels.append((marginal[:, 0] - marginal[:, 1]).astype(np.float32))
        node = node * 2 + side
    return levels


def route(levels: list[np.ndarray], term: np.ndarray, begin: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The cluster of each document; number decides where both sides cost the same."""
    node = np.zeros(len(begin) - 1, np.int64)
    owner = np.repeat(np.arange(len(node)), np.diff(begin))
    for depth, level in enumerate(levels):
        more = np.bincount(owner, weights=level[node[owner], term], minlength=len(node))
        node = node * 2 + np.where(more == 0, number >> depth & 1, more > 0)
    return node


def _routed(levels: list[np.ndarray]):
    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, begin = _flat(batch.column("terms"))
            cluster = route(levels, term, begin, batch.column("row").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32())], names=[*batch.schema.names, "cluster"])

    return routed


def shards_of(docs: pa.Table, weight: np.ndarray, n_docs: int, total: int, most: int = SHARD_DOCS) -> pa.Table:
    """One group of documents as rows of the index, in the order that bisection gives."""
    docs = docs.sort_by("row")
    term, begin = _flat(docs.column("terms"))
    tf, _ = _flat(docs.column("tfs"))
    term = term.astype(np.int64)
    owner = np.repeat(np.arange(docs.num_rows), np.diff(begin))
    impact = impacts(tf, weight[term], docs.column("n").to_numpy()[owner], n_docs, total)
    node, nodes = np.zeros(docs.num_rows, np.int64), 1
    while docs.num_rows > most * nodes:
        node = node * 2 + bisect(term, begin, node, nodes)
        nodes *= 2
    order = np.argsort(node, kind="stable")
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    first = np.searchsorted(node[order], np.arange(nodes + 1))
    shard = node[owner]
    use = impact > 0
    by = np.lexsort((new[owner[use]], term[use], shard[use]))
    shard, term, impact, owner = shard[use][by], term[use][by], impact[use][by], owner[use][by]
    upto = np.searchsorted(shard, np.arange(nodes + 1))
    head = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (shard[1:] != shard[:-1])))) if len(term) else np.zeros(0, np.int64)
    bounds = np.maximum.reduceat(impact, head) if len(head) else impact
    return pa.table({
        "docs": _lists_of(docs.column("doc_id").take(pa.array(order)), first), "owners": _lists(new[owner] - first[shard], upto, pa.int32()),
        "terms": _lists(term, upto, pa.int32()), "impacts": _lists(impact, upto, pa.int64()),
        "bound_terms": _lists(term[head], np.searchsorted(head, upto), pa.int32()), "bounds": _lists(bounds, np.searchsorted(head, upto), pa.int64()),
    })


def _lists_of(ids: pa.ChunkedArray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids.combine_chunks().cast(pa.int64()))


class Search:
    """The best documents so far of each query of a block, over shards that come in any order."""

    def __init__(self, queries: Queries, top: int = TOP, floor: np.ndarray | None = None):
        self.queries, self.top = queries, top
        self.first, self.asking = queries.by_term()
        self.floor = np.ones(len(queries.ids), np.int64) if floor is None else np.maximum(floor, 1)  # scores of 0 do not count
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.ids)
        self.visits = 0

    def add(self, index: pa.RecordBatch | pa.Table) -> None:
        for a in range(0, index.num_rows, _SHARDS):
            self._block(index.slice(a, _SHARDS))

    def _block(self, index: pa.RecordBatch | pa.Table) -> None:
        columns = {name: _flat(index.column(name)) for name in ("owners", "terms", "impacts", "bound_terms", "bounds")}
        ids = index.column("docs")
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        docs, doc_at = ids.flatten().fill_null(_NO_ID).to_numpy(zero_copy_only=False), _flat(ids)[1]
        terms, at = columns["bound_terms"]
        bounds = columns["bounds"][0]
        shard = np.repeat(np.arange(index.num_rows), np.diff(at))
        asking = self.first[terms + 1] - self.first[terms]
        cell = np.repeat(shard, asking) * len(self.queries.ids) + self.asking[_spread(self.first[terms], asking)]
        # sums of whole numbers below 2**53
        bound = np.bincount(cell, weights=np.repeat(bounds, asking).astype(float), minlength=index.num_rows * len(self.queries.ids)).reshape(index.num_rows, -1).astype(np.int64)
        tables: dict[int, np.ndarray] = {}
        for q in np.flatnonzero((bound >= self.floor).any(axis=0)).tolist():
            for s in np.argsort(-bound[:, q], kind="stable").tolist():
                if bound[s, q] < self.floor[q]:
                    break  # no document here or behind can be among the best
                own = terms[at[s] : at[s + 1]]
                if s not in tables:
                    low, high = columns["terms"][1][s : s + 2]
                    table = np.zeros((len(own), doc_at[s + 1] - doc_at[s]), np.int64)
                    table[np.searchsorted(own, columns["terms"][0][low:high]), columns["owners"][0][low:high]] = columns["impacts"][0][low:high]
                    tables[s] = table
                place = np.searchsorted(own, self.queries.terms[q])
                place = place[own[np.minimum(place, len(own) - 1)] == self.queries.terms[q]]
                self._keep(q, tables[s][place].sum(axis=0), docs[doc_at[s] : doc_at[s + 1]])
                self.visits += 1

    def _keep(self, q: int, score: np.ndarray, docs: np.ndarray) -> None:
        near = score >= self.floor[q]
        if not near.any():
            return
        score, docs = np.concatenate([self.best[q][0], score[near]]), np.concatenate([self.best[q][1], docs[near]])
        order = np.lexsort((docs, -score))[: self.top]
        self.best[q] = score[order], docs[order]
        if len(order) == self.top:
            self.floor[q] = max(self.floor[q], score[order[-1]])

    def rows(self) -> pa.RecordBatch:
        count = [len(s) for s, _ in self.best]
        score, docs = (np.concatenate([x[k] for x in self.best]) for k in (0, 1))
        return pa.RecordBatch.from_pydict({
            "item_id": pa.array(np.repeat(np.array(self.queries.ids, np.int64), count)),
            "doc_id": pa.array(docs, pa.int64(), mask=docs == _NO_ID), "score": pa.array(score, pa.int64()),
        })


def _search(queries: Queries, top: int, floor: np.ndarray):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(queries, top, floor.copy())
        for batch in batches:
            found.add(batch)
        yield found.rows()

    return search


def _sample(postings: DataFrame) -> pa.Table:
    """At most SAMPLE_DOCS documents, chosen by hash, with at most some SAMPLE_POSTINGS postings."""
    few = postings.withColumn("_place", F.xxhash64("row", F.lit(12))).orderBy("_place", "row").limit(SAMPLE_DOCS)
    before = F.sum(F.size("terms").cast("long")).over(Window.orderBy("_place", "row").rowsBetween(Window.unboundedPreceding, -1))  # SAMPLE_DOCS rows
    return few.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < SAMPLE_POSTINGS).drop("_place", "_before").toArrow()


def _one_block(docs: DataFrame, queries: Queries, top: int) -> DataFrame:
    spark = docs.sparkSession
    postings = written(docs.mapInArrow(_count(queries.vocabulary), _POSTINGS), "postings")
    size = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not size["docs"]:
        return spark.createDataFrame([], _FOUND)
    n_docs, total, vocabulary = size["docs"], size["terms"], len(queries.vocabulary)
    frequency = np.zeros(vocabulary, np.int64)
    counted = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row a term asked for
    frequency[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    weight = weights(n_docs, frequency)

    sample = _sample(postings)
    term, begin = _flat(sample.column("terms"))
    depth = max(0, min(MAX_DEPTH, int(np.ceil(np.log2(n_docs / GROUP_DOCS))), int(np.log2(max(1, _TREE_CELLS // vocabulary)))))
    levels = fit_tree(term.astype(np.int64), begin, depth, vocabulary)
    # a query's k-th best document in the sample is a score that its k-th best of all has at least
    trial = Search(queries, top)
    trial.add(shards_of(sample, weight, n_docs, total))

    routed = postings.mapInArrow(_routed(levels), _POSTINGS + ", cluster int")
    count = dict.fromkeys(range(1 << depth), 0) | {r["cluster"]: r["n"] for r in routed.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    groups = np.array([max(1, -(-count[c] // GROUP_DOCS)) for c in range(1 << depth)])
    base = F.array(*(F.lit(int(x)) for x in np.cumsum(groups) - groups))[F.col("cluster")]
    group = base + F.pmod(F.xxhash64("row"), F.array(*(F.lit(int(x)) for x in groups))[F.col("cluster")]).cast("int")

    def build(table: pa.Table) -> pa.Table:
        return shards_of(table, weight, n_docs, total)

    index = written(routed.withColumn("group", group).groupBy("group").applyInArrow(build, _INDEX), "index")
    return index.mapInArrow(_search(queries, top, trial.floor), _FOUND)


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` highest-scoring documents of each query.

    docs: doc_id long, text string; queries: item_id long, text string; other columns
    are not read. Terms are maximal runs of digits, ASCII letters (A-Z lower-cased) and
    characters beyond ASCII; they are compared by 64-bit hashes. A document's score sums
    over the query's distinct terms w * ((10**9 * tf) div (1000 * tf + 20 * m)), where w
    is floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 * n * N) div L; N counts the
    documents with a term, L all terms, n the document's. Returns item_id, rank (from
    1), doc_id, score: scores above 0 only, equal ones by ascending doc_id.

    Null, empty and termless texts are no documents, and match nothing as queries. A
    null doc_id comes behind all others of its score. Rows of one doc_id are documents
    of their own and each can be returned; of queries with one item_id the smallest text
    counts, and a null item_id asks nothing. Empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], _FOUND)
    for block in query_blocks(queries):
        found = found.union(_one_block(docs, block, top))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
