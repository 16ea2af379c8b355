"""Registered queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import langid, lmscore, mixing, neardup, neighbours, packing, quotes, repeats, topk, urlfilter

#: The rules of the op4 contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Pages of hosts with this in their name make up the list of blocked canonical URLs.
LISTED_HOSTS = "spam-farm"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    host = urlfilter.host_of(F.col("url"))
    listed = pages.where(host.contains(LISTED_HOSTS)).select(urlfilter.canonical(host, urlfilter.path_of(F.col("url"))).alias("url_key"))
    return urlfilter.judged(pages, rules, listed)


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op10_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_score, op2_mix_sources, op3_nearest_neighbours, op4_url_filter, op5_pack_documents,
        op6_language_id, op7_exact_top_k, op8_near_duplicates, op9_repeated_passages, op10_quote_links,
    )
}

_CANONICAL = "regexp_replace(host, '^www\\.', '') || '/' || regexp_replace(path, '^/|/+$', '', 'g')"

ORACLES = {
    "op4_url_filter": f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN NULL ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), k AS (
  SELECT page_id, host, path, {_CANONICAL} AS url_key FROM p
), listed AS (
  SELECT DISTINCT url_key FROM k WHERE contains(host, 'spam-farm')
), rules(h, p, says) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(says, length(h || p)) AS says
  FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT k.page_id, host, path, rule,
       coalesce(says, CASE WHEN host <> '' AND url_key IN (SELECT url_key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN fit ON k.page_id = fit.page_id""",
    "op9_repeated_passages": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g
  FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS p FROM d)
), f AS (
  SELECT g, min(doc_id) AS low FROM w GROUP BY g
), s AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN f USING (g) WHERE low < doc_id
), r AS (
  SELECT *, count(CASE WHEN before IS NULL OR p > before + 50 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s
), x AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run
), y AS (
  SELECT x.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY x.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY x.doc_id ORDER BY a), 0))) AS gap
  FROM x JOIN d ON x.doc_id = d.doc_id
), z AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(gap, '' ORDER BY a) AS kept, max(b) AS last FROM y GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN z ON d.doc_id = z.doc_id""",
    "op7_exact_top_k": """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda e: isfinite(e)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
