"""The subpackage's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, delta_lloyd, embeddings, html, licenses, lm, mixing, near_dedup, quality, runs, substrings, tokens, urls


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer file; HUESCOPE_TOKENIZERS names another folder."""
    folder = os.environ.get("HUESCOPE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by runs of four words and a similarity of 0.8."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=4, similarity=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: a row for each document and item found in it."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed and kept or not."""
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.extract(read(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those whose crc32(doc_id) mod 10 is not 0."""
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held"))
    return lm.score(docs, tokenizer_path("piece_bpe_32k.model"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures, against dated entries made from their hosts and URLs by rule (the tables have no list)."""
    pages = read(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", ((F.col("page_id") * 37) % 365).alias("fetched"))
    hosts = pages.select(urls.host(F.col("url")).alias("key")).filter("key != ''").distinct()
    v = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long")
    hosts = hosts.withColumn("v", v)
    kind = F.lit("host").alias("kind")
    own = F.substring_index("key", ".", -2)
    exact = pages.filter("page_id % 50 = 0").select(F.lit("url").alias("kind"), urls.bare(F.col("url")).alias("key"), (F.col("page_id") % 300).alias("since"), F.lit("block").alias("action"))
    entries = (
        hosts.filter("v % 4 = 0").select(kind, "key", (F.col("v") % 200).alias("since"), F.lit("block").alias("action"))
        .unionByName(hosts.filter("v % 8 = 0").select(kind, "key", (F.col("v") % 200 + 60).alias("since"), F.lit("allow").alias("action")))
        .unionByName(hosts.select(kind, own.alias("key"), F.lit(330).cast("long").alias("since"), F.lit("block").alias("action")).filter("key = 'example.net'").distinct())
        .unionByName(exact)
        .unionByName(exact.filter("since % 100 = 0").withColumn("since", F.col("since") + 10).withColumn("action", F.lit("allow")))
    )
    return urls.judge(captures, entries)


OP5_SQL = r"""
WITH h AS (SELECT page_id, url, (page_id * 37) % 365 AS fetched,
    translate(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages),
hosts AS (SELECT DISTINCT host AS key, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS v FROM h WHERE host <> ''),
urlist AS (SELECT 'url' AS kind, host || p AS key, page_id % 300 AS since FROM h WHERE page_id % 50 = 0),
e0 AS (
    SELECT 'host' AS kind, key, v % 200 AS since, 'block' AS action FROM hosts WHERE v % 4 = 0
    UNION ALL SELECT 'host', key, v % 200 + 60, 'allow' FROM hosts WHERE v % 8 = 0
    UNION ALL SELECT DISTINCT 'host', 'example.net', 330, 'block' FROM hosts WHERE key = 'example.net' OR key LIKE '%.example.net'
    UNION ALL SELECT kind, key, since, 'block' FROM urlist
    UNION ALL SELECT kind, key, since + 10, 'allow' FROM urlist WHERE since % 100 = 0),
e AS (SELECT kind, key, since, min(action) AS action FROM e0 GROUP BY ALL),
m AS (SELECT h.page_id, h.url, h.fetched, h.host, e.kind, e.key, e.since, e.action,
    row_number() OVER (PARTITION BY h.page_id, h.url ORDER BY e.kind = 'url' DESC, length(e.key) DESC, e.since DESC) AS rn
    FROM h LEFT JOIN e ON h.host <> '' AND e.since <= h.fetched
      AND ((e.kind = 'url' AND e.key = h.host || h.p) OR (e.kind = 'host' AND (e.key = h.host OR ends_with(h.host, '.' || e.key)))))
SELECT page_id, url, fetched, host, kind AS entry_kind, key AS entry_key, since, action, coalesce(action <> 'block', true) AS kept FROM m WHERE rn = 1
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' target weights."""
    return mixing.mix_sizes(read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the known licence digests; the list's size is fixed."""
    return licenses.scan(read(spark, sf_dir, "documents"), F.broadcast(licenses.known(spark)))


def op8_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"translate(text, '{licenses.UPPER}', '{licenses.LOWER}')"
    form = f"regexp_replace(regexp_replace({form}, {quote(licenses.COPYRIGHT)}, ' ', 'g'), '{licenses.RESERVED}', ' ', 'g')"
    form = f"trim(regexp_replace({form}, {quote(licenses.MARKS)}, ' ', 'g'), ' ')"
    words = f"string_split({form}, ' ')"
    pairs = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in licenses.SPELLINGS.items()) + "}"
    same = f"array_to_string(list_transform({words}, lambda w: coalesce(({pairs})[w], w)), ' ')"
    values = ", ".join(f"('{d}', '{n}')" for d, n in licenses.known_digests())
    return f"SELECT d.doc_id, d.digest, k.license FROM (SELECT doc_id, sha256(nullif({same}, '')) AS digest FROM documents) d LEFT JOIN (VALUES {values}) k(digest, license) ON d.digest = k.digest"


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as binary shards, read back and summed up."""
    return tokens.token_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked by a cosine of 0.93 within their label."""
    return embeddings.near_embeddings(read(spark, sf_dir, "embeddings"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in eight clusters after ten rounds."""
    return delta_lloyd.cluster_digests(read(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words that start in one of a smaller doc_id."""
    return substrings.substring_digests(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, with the planted repeats, and what is left of each without its repeated words."""
    return runs.document_runs(read(spark, sf_dir, "documents"), plant=True).drop("n_words")


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_decontamination, op3_quality_classifier, op4_html_extraction, op5_url_filters,
        op6_lm_scoring, op7_mixing, op8_license_scan, op9_token_binary, op10_embedding_near_dedup, op11_centroid_clustering,
        op12_substring_dedup, op13_periodic_runs,
    )
}


def sql() -> dict[str, str]:
    return {"op5_url_filters": OP5_SQL, "op8_license_scan": op8_sql(), "op11_centroid_clustering": delta_lloyd.sql(), "op12_substring_dedup": substrings.SQL}
