"""The registered queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .fingerprints import fingerprint_with_edit, near_texts
from .mixing import mix
from .near_dedup import near_duplicates
from .passages import dedup_passages
from .pii import KINDS, find_personal_data, listed
from .quality import select
from .sharding import assign_shards
from .toxicity import fit, held_out, score
from .scratch import small
from .url_filter import RULES, filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, similarity=(85, 100)).withColumnRenamed("id", "doc_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, _table(spark, sf_dir, "benchmark")).drop("text")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's URL is labelled by the quality of the document whose number its path ends in."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    own = _table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg((1 - F.max("quality")).alias("block"))
    number = F.regexp_extract("url", "://[^/?#]*/[a-z]+/([0-9]+)", 1).try_cast("long")
    labelled = pages.select("url", number.alias("doc_id")).join(small(own), "doc_id").select("url", "block")
    return filter_urls(pages, labelled, RULES).drop("url")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edit(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def documents_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banding and verification of the fingerprints over all documents: texts within 5 % edits of one another."""
    return near_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), max_edits=0.05).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "evidence")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",")
    return found.select("doc_id", "n_removed", spans.alias("removed"), F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*(listed(k, F.col("spans")[k]) for k in KINDS))
    counts = [F.size(F.col("spans")[k]).cast("long").alias(f"n_{k}") for k in KINDS]
    secrets = F.col("spans")["secret"]
    every = F.array_join(F.concat(base, listed("secret", secrets), listed("term", F.col("terms"))), ",")
    counts += [F.size(secrets).cast("long").alias("n_secret"), (F.size(base) + F.size(secrets)).cast("long").alias("n_values")]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), every.alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    labelled = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), kind.alias("domain"))
    found = mix(docs, labelled, {"clean": 0.9, "junk": 0.05, "toxic": 0.05}, keep=["doc_id"])
    p = [F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(("clean", "junk", "toxic"))]
    return found.select("doc_id", "n_tokens", *p, "rate", "copies")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), 24, keep=["doc_id"])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return select(docs, _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_quality_classifier": op10_quality_classifier,
    "documents_near_texts": documents_near_texts,
}

_WINDOWS = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_NEAR = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

ORACLES = {"op3_minhash_near_dedup": _NEAR, "op4_benchmark_decontamination": _WINDOWS}
