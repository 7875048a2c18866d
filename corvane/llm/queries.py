"""The registered queries of the llm operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import corpus
from .decontaminate import leaks
from .language import identify
from .ngram_join import ngram_join
from .packing import pack
from .periodic_runs import periodic_runs
from .pii import find_pii
from .quality import classify
from .ranked_search import ranked_search
from .secret_scan import find_secrets
from .substring_dedup import substring_dedup
from .token_files import token_output
from .topk import exact_topk
from .url_filter import Rule, judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(corpus.table(spark, sf_dir, "documents"), corpus.table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(corpus.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(corpus.table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(corpus.table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(corpus.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(corpus.table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(corpus.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(corpus.table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(corpus.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(corpus.table(spark, sf_dir, "documents"), corpus.table(spark, sf_dir, "labels"))


#: The rules that the contract of op11 fixes.
URL_RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Pages of fewer characters put their url on the list of op11: no table holds one, so the list is of urls that some crawl found next to empty.
THIN_PAGE = 1000


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.table(spark, sf_dir, "pages")
    return judge_urls(pages, pages.filter(F.length("html") < THIN_PAGE), URL_RULES)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(corpus.table(spark, sf_dir, "documents"), corpus.table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(corpus.table(spark, sf_dir, "documents"), tile=True)


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_language": op4_language,
    "op5_token_output": op5_token_output,
    "op6_pii": op6_pii,
    "op7_secrets": op7_secrets,
    "op8_exact_topk": op8_exact_topk,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_url_filter": op11_url_filter,
    "op12_ranked_search": op12_ranked_search,
    "op13_periodic_runs": op13_periodic_runs,
}

WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
        win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS gram
                FROM d, unnest(range(1, greatest(len(w) - 11, 1))) AS u(p)),
        own AS (SELECT gram, min(doc_id) AS least FROM win GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
        gone AS (SELECT DISTINCT win.doc_id, p + k AS pos FROM win JOIN own USING (gram), unnest(range(0, 13)) AS o(k)
                 WHERE win.doc_id > own.least),
        word AS (SELECT doc_id, pos, w[pos] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(pos)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op3_ngram_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
            FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS gram FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS u(p)
              WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM pair JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
                 WHERE 100 * shared >= 90 * (nx.n + ny.n - shared)),
        edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE x = d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id)""",
    "op8_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_url_filter": r"""
        WITH u AS (SELECT page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
        p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                     list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|\z)'))) AS params FROM u),
        c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)\z', '') || regexp_replace(path, '/+\z', '')
                             || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key FROM p),
        listed AS (SELECT DISTINCT key FROM c WHERE length(html) < 1000 AND key IS NOT NULL),
        r AS (SELECT page_id, host, path, key,
                     CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                          WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                          WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                          WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                          WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
        FROM r LEFT JOIN listed ON listed.key = r.key""",
    "op12_ranked_search": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS row FROM documents),
        d AS (SELECT row, doc_id, w, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
        size AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM d),
        tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY ALL),
        weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, size GROUP BY term, n_docs),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                  FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)),
        s AS (SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
              FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN d USING (row), size GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50""",
}
