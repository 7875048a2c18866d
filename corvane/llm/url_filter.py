"""Operator 11, URL filters: rules of hosts and paths, then a list behind a blocked Bloom filter.

A url is judged by the longest rule that fits its host and path. Where no rule fits, it is
blocked if its canonical form is that of a listed url. The list may be as large as the
corpus: it is put into a blocked Bloom filter (each url sets eight bits of one block of
256), built as a grouped bit_or with map-side combine, and the filter goes to every task.
Urls that miss it are not listed and stay where they are; only possible hits meet the
list in an exact hash join, which removes the filter's false positives.

A filter holds at most FILTER_BYTES. A longer list is cut into slices by hash, with a
filter and a pass over the urls each; the joins see the possible hits only. One hot url is
one row of the distinct list; its many rows among the possible hits are split by
adaptive execution's skew join, as the join needs no rows of a key together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import written
from .textkit import mix

FILTER_BYTES = 16 << 20
BITS_PER_URL = 16
MAX_RULES = 1000

#: One url sets one bit in each of a block's eight words: the top five bits of the low half of its hash times an odd number.
_WORDS = 8
_ODD = [int(x >> np.uint64(32)) | 1 for x in mix(np.arange(1, _WORDS + 1, dtype=np.uint64))]

#: Query parameters that say where a visitor came from, not what the page is.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query of a url; empty where it is null or has no ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """One form for urls of one page: no scheme, www., default port, slashes at the end, tracking parameters or fragment; parameters sorted. Null without a host."""
    host, path, query = parts(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)\z", "")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|\z)"))
    page = F.concat(host, F.regexp_replace(path, r"/+\z", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(""))
    return F.when(host != "", page)


def fitting(host: Column, path: Column, rules: Sequence[Rule], name: bool) -> Column:
    """The longest fitting rule's text (name) or verdict; null where none fits. rules: (verdict, host, path)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; put single urls on the list")
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p if name else verdict)).otherwise(out)
    return out


class Blocks:
    """A blocked Bloom filter over 64-bit hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words  # a row of eight 32-bit words for each block

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may have been put in; one that was is never missed."""
        h = hashes.view(np.uint64)
        row = self.words[((h >> np.uint64(32)) * np.uint64(len(self.words))) >> np.uint64(32)]
        low = h & np.uint64(0x7FFFFFFF)
        out = np.ones(len(h), dtype=bool)
        for k, odd in enumerate(_ODD):
            bit = (low * np.uint64(odd) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
            out &= (row[:, k] >> bit.astype(np.uint32)) & np.uint32(1) == 1
        return out


def _places(hashes: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a hash, and its bit in each of the block's words."""
    low = hashes.bitwiseAND(0x7FFFFFFF)  # 31 bits: products stay within a long
    block = F.shiftright(F.shiftrightunsigned(hashes, 32) * F.lit(blocks), 32).cast("int")
    return block, [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned((low * F.lit(odd)).bitwiseAND(0xFFFFFFFF), 27).cast("int")) for odd in _ODD]


def block_count(count: int) -> int:
    return max(1, -(-count * BITS_PER_URL // (32 * _WORDS)))


def filter_rows(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of a column `hash` as rows (block, w0 to w7), those of empty blocks left out: a grouped bit_or."""
    block, bits = _places(F.col("hash"), blocks)
    made = keys.select(block.alias("block"), *(b.alias(f"w{k}") for k, b in enumerate(bits)))
    return made.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(_WORDS)))


def bloom_filter(keys: DataFrame, count: int) -> Blocks:
    """The filter of a column `hash` of `count` rows: one row of 32 bytes a block to the driver."""
    blocks = block_count(count)
    rows = filter_rows(keys, blocks).toArrow()
    words = np.zeros((blocks, _WORDS), np.uint32)
    for k in range(_WORDS):
        words[rows.column("block").to_numpy(), k] = rows.column(f"w{k}").to_numpy().view(np.uint32)
    return Blocks(words)


def without_keys(rows: DataFrame, key: str, gone: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """rows but those whose key is in gone (column `key`, distinct), as a left anti join; wide rows move only where the filter may hold their key.

    The filter goes to every task as a broadcast table. Beyond filter_bytes it is left out and all rows meet the list.
    """
    count = gone.count()
    if count * BITS_PER_URL > 8 * filter_bytes:
        return rows.join(gone, key, "left_anti").select(rows.columns)
    blocks = block_count(count)
    block, bits = _places(F.xxhash64(key), blocks)
    words = F.broadcast(filter_rows(gone.select(F.xxhash64(key).alias("hash")), blocks).withColumnRenamed("block", "_block"))
    held = [F.col(f"w{k}").bitwiseAND(b) != 0 for k, b in enumerate(bits)]
    maybe = F.coalesce(reduce(and_, held), F.lit(False))
    marked = rows.withColumn("_of", block).join(words, F.col("_of") == F.col("_block"), "left").withColumn("_maybe", maybe)
    asked = marked.filter("_maybe").select(rows.columns)
    return marked.filter("NOT _maybe").select(rows.columns).union(asked.join(gone, key, "left_anti").select(rows.columns))


def _probe(blocks: Blocks):
    @F.pandas_udf("boolean")
    def probe(hashes: pd.Series) -> pd.Series:
        return pd.Series(blocks.might_hold(np.ascontiguousarray(hashes.to_numpy(), dtype=np.int64)))

    return probe


def slice_of(hashes: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(hashes), F.lit(slices))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The verdict on every url of pages.

    pages: page_id long, url string; listed: url string; other columns are not read.
    rules: at most MAX_RULES of (allow or block, host, path); a rule fits its host and
    all subdomains where the url's path starts with its path; the longest wins (then
    the one with the longer host). Returns page_id, host, path, rule (host and path of
    the rule, or null) and verdict: the rule's, else block if the url's canonical form
    is that of a listed url, else allow.

    A null url, or one without ://, has an empty host and path and is allowed. A null
    page_id is carried along; rows that occur twice are judged twice; urls listed twice
    count once. Empty tables: no rows, or verdicts by the rules alone.
    """
    keys = listed.select(canonical(F.col("url").cast("string")).alias("listed_key")).filter("listed_key IS NOT NULL").distinct()
    keys = written(keys.withColumn("hash", F.xxhash64("listed_key")), "listed")
    count = keys.count()
    url = F.col("url").cast("string")
    host, path, _ = parts(url)
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), canonical(url).alias("key"))
    judged = judged.withColumn("rule", fitting(F.col("host"), F.col("path"), rules, True)).withColumn("verdict", fitting(F.col("host"), F.col("path"), rules, False))
    judged = judged.withColumn("hash", F.xxhash64("key"))
    open_ = F.col("rule").isNull() & F.col("key").isNotNull()
    columns = ["page_id", "host", "path", "rule"]
    slices = max(1, -(-count * BITS_PER_URL // (8 * filter_bytes)))
    out = judged.filter(~open_).select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    for s in range(slices):
        own = keys if slices == 1 else keys.filter(slice_of(F.col("hash"), slices) == s)
        blocks = bloom_filter(own, -(-count // slices))
        asked = judged.filter(open_ if slices == 1 else open_ & (slice_of(F.col("hash"), slices) == s)).withColumn("maybe", _probe(blocks)("hash"))
        hits = asked.filter("maybe").join(own.select("listed_key"), F.col("key") == F.col("listed_key"), "left")
        out = out.union(asked.filter("NOT maybe").select(*columns, F.lit("allow").alias("verdict")))
        out = out.union(hits.select(*columns, F.when(F.col("listed_key").isNotNull(), "block").otherwise("allow").alias("verdict")))
    return out
