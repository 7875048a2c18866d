"""URL verdicts against a plain version, and the filter's own promises."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, url_filter

TRACKING = re.compile(rf"(?:{url_filter.TRACKING})(?:=|\Z)")


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    rest = rest[len(host) :]
    path = re.split(r"[?#]", rest, maxsplit=1)[0]
    rest = rest[len(path) :]
    query = rest[1:].split("#", 1)[0] if rest.startswith("?") else ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path, query


def canonical(url):
    host, path, query = parts(url)
    if not host:
        return None
    host = re.sub(r":(80|443)\Z", "", re.sub(r"^www\.", "", host))
    kept = sorted(p for p in query.split("&") if p and not TRACKING.match(p))
    return host + re.sub(r"/+\Z", "", path) + ("?" + "&".join(kept) if kept else "")


def plain(pages, listed, rules):
    known = {canonical(u) for u in listed} - {None}
    out = []
    for page_id, url in pages:
        host, path, _ = parts(url)
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
        out.append((page_id, host, path, best[1] + best[2] if best else None, best[0] if best else "block" if canonical(url) in known else "allow"))
    return sorted(out, key=repr)


PAGES = [
    (1, None), (2, ""), (3, "no scheme.org/x"), (4, "http://a.org"), (5, "http://a.org/"), (6, "HTTP://EXAMPLE.ORG/es/1"), (7, "https://x.example.org/en/1?x#y"), (8, "https://notexample.org/es/1"),
    (9, "http://a.com/fr/x"), (10, "http://a.com/de/x"), (11, "http://com/de/"), (12, "http://a.net/p/?b=2&a=1&utm_source=q#z"), (13, "https://www.a.net:443/p?a=1&b=2"), (13, "https://www.a.net:443/p?a=1&b=2"),
    (None, "ftp://A.net/p///?a=1&ref=x&b=2"), (14, "http://a.net/P?a=1&b=2"), (15, "http://ÄB.net/ü?ref"), (16, "http:///only/path"), (17, "http://b.net?x://y"), (18, "a://b.net/\n?q\n"), (19, "http://b.net/" + "x" * 50_000),
    (20, "http://é.net/" ), (21, "://c.net/de/"), (22, "http://a.net/de/#://b.org/"), (23, "http://example.org.net/es/"),
]


def frames(spark, pages, listed):
    return spark.createDataFrame([(*p, "h", "k", True) for p in pages], "page_id long, url string, host string, key string, maybe boolean"), spark.createDataFrame([(u, 1) for u in listed], "url string, hash int")


def judged(spark, pages, listed, rules=queries.URL_RULES, **options):
    return sorted((tuple(r) for r in url_filter.judge_urls(*frames(spark, pages, listed), rules, **options).collect()), key=repr)


def test_edges(spark):
    listed = [u for _, u in PAGES[10:]] + [None, "", "x", "http://a.net/p?b=2&a=1"]
    assert judged(spark, PAGES, listed) == plain(PAGES, listed, queries.URL_RULES)
    assert judged(spark, PAGES, []) == plain(PAGES, [], queries.URL_RULES)
    assert judged(spark, [], listed) == []
    assert judged(spark, PAGES, listed, ()) == plain(PAGES, listed, ())


def test_slices_and_a_hot_url(spark):
    rnd = random.Random(1)
    pages = [(i, f"http://h{rnd.randrange(50)}.net/{rnd.randrange(60)}?utm_x={i}") for i in range(3000)] + [(i, "http://hot.net/") for i in range(2000)]
    listed = [f"https://www.h{rnd.randrange(50)}.net/{rnd.randrange(60)}/" for _ in range(800)] + ["http://hot.net"] * 5
    want = plain(pages, listed, queries.URL_RULES)
    assert judged(spark, pages, listed) == want
    assert judged(spark, pages, listed, filter_bytes=512) == want  # several slices


def test_filter_misses_nothing_and_passes_little(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("hash"))
    blocks = url_filter.bloom_filter(keys, 20_000)
    inside = np.array([r["hash"] for r in keys.collect()], np.int64)
    outside = np.array([r["hash"] for r in spark.range(20_000, 60_000).select(F.xxhash64("id").alias("hash")).collect()], np.int64)
    assert blocks.might_hold(inside).all()
    assert blocks.might_hold(outside).mean() < 0.01
    assert blocks.words.nbytes <= 20_000 * url_filter.BITS_PER_URL / 8 + 64


def test_only_possible_hits_are_joined(spark):
    pages, listed = frames(spark, [(i, f"http://h.net/{i}") for i in range(2000)], ["http://h.net/5"])
    out = url_filter.judge_urls(pages, listed, ())
    assert out.filter("verdict = 'block'").count() == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter maybe" in plan or "maybe#" in plan


@pytest.mark.parametrize("filter_bytes", [url_filter.FILTER_BYTES, 0])
def test_rows_without_keys(spark, filter_bytes):
    rows = spark.range(20_000).select(F.when(F.col("id") % 1000 > 0, F.col("id") - 50).alias("key"), F.lit("text").alias("text"))
    gone = spark.range(-100, 30_000, 7).select(F.col("id").alias("key"))
    out = url_filter.without_keys(rows, "key", gone, filter_bytes)
    want = [None] * 20 + sorted(k - 50 for k in range(20_000) if k % 1000 and (k + 50) % 7)
    assert sorted((r["key"] for r in out.collect()), key=lambda k: (k is not None, k)) == want
    assert out.columns == ["key", "text"]
    assert url_filter.without_keys(rows, "key", gone.limit(0), filter_bytes).count() == 20_000
