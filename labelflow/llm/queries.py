"""The thin registered queries of this folder: each reads its whole table, applies one operator with
production parameters and derives the columns of its contract. ORACLE has DuckDB SQL where SQL can
express the result; the other queries are tested against brute force in tests/llm."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chunk_dedup, exact_dedup, language, minhash, packing, quality, sharding, suffix, topk, url_filter, whitening
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing of all documents into windows of 2048 ids."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup: the largest doc_id of equal texts stays."""
    return (exact_dedup.exact_dedup(documents(spark, sf_dir))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speculative BPE encoding and decoding of every text."""
    return bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_topk", """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 5 by inner product for every 50th vector."""
    return topk.top_k(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learns from the labelled rows that are not held out."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    chain = quality.learn(docs, labels.where(~quality.held_out()))
    return (quality.score(docs, chain)
            .select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")))


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of near-equal bytes; equal texts stay together."""
    return sharding.shard_by_bytes(documents(spark, sf_dir))


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    model = language.learn(language.training_rows(docs))
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op2_minhash", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b
      WHERE 100 * k >= 85 * (len(x.sh) + len(y.sh) - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.id WHERE c.r < e.b)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.r AS component_id, s.doc_id = m.r AS kept
FROM s JOIN (SELECT id, min(r) AS r FROM c GROUP BY id) m ON m.id = s.doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies: three words, similarity of at least 0.85."""
    return minhash.near_duplicates(documents(spark, sf_dir), 3, 85, 100).select("doc_id", "n_shingles", "component_id", "kept")


def removal(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_suffix_array", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     g AS (SELECT doc_id, len(h) // 2 AS n, h, unnest(range(0, CAST((len(h) + 1023) // 1024 AS BIGINT))) AS blk FROM d),
     q AS (SELECT doc_id, n, blk, substr(h, 1024 * blk + 1, 1122) AS h FROM g),
     p AS (SELECT doc_id, blk, unnest(range(0, CAST(least(512, n - 512 * blk) AS BIGINT))) AS j, h FROM q),
     s AS (SELECT doc_id, 512 * blk + j AS i, substr(h, 2 * j + 1, 2) AS byte,
             CASE WHEN 2 * j + 100 <= len(h) THEN md5(substr(h, 2 * j + 1, 100)) END AS w FROM p),
     m AS (SELECT w, min(doc_id) AS first FROM s WHERE w IS NOT NULL GROUP BY w HAVING min(doc_id) < max(doc_id)),
     f AS (SELECT s.doc_id, s.i, s.byte, max(CASE WHEN m.first < s.doc_id THEN s.i END)
             OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
           FROM s LEFT JOIN m USING (w)),
     r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM f),
     k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
             coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in a smaller document too go."""
    return removal(suffix.dedup_substrings(documents(spark, sf_dir)))


@query("op6_chunk_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks that a smaller document holds too go."""
    return removal(chunk_dedup.dedup_chunks(documents(spark, sf_dir)))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings: eight components."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), 8)


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op12_url_filter", url_filter.twin_sql(URL_RULES))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every url: rules first, then path templates."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of two tokenizers in every text."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(documents(spark, sf_dir), a, b, keep_groups=False).drop("groups")
