"""A persistent inverted index, and the planner that chooses between fused and lexical search."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval as R
from . import search as S


def words_of(query: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(r"[^a-z0-9]+", query.lower()) if w))


class SearchIndex:
    """Postings (term, id, tf, dl) in Parquet, dealt to buckets by term and sorted within.

    A search reads its terms' buckets only, and within them the row groups that hold the terms; the texts are not touched.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, id: str, text: Column, path: str, buckets: int | None = None) -> SearchIndex:
        """One shuffle by (bucket, salt): a frequent term's postings are dealt to several files."""
        buckets = buckets or max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        lists = S.postings(docs, id, text)
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        dealt = lists.withColumn("bucket", bucket).repartition(buckets, "bucket", F.pmod(F.xxhash64("id"), F.lit(4)))
        dealt.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        sizes = docs.select(F.size(S.words(text)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return cls(docs.sparkSession, path)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """(id, score): the best documents that hold every word of the query."""
        wanted = words_of(query)
        stats = self.spark.read.parquet(f"{self.path}/stats").first()
        schema = self.spark.read.parquet(f"{self.path}/postings")
        if not wanted or not stats["n"]:
            return schema.select("id", F.lit(0.0).alias("score")).limit(0)
        numbers = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(stats["buckets"])).cast("int") for w in wanted)))).collect()]
        hits = schema.where(F.col("bucket").isin(sorted(set(numbers))) & F.col("term").isin(wanted))
        df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}
        if len(df) < len(wanted):
            return schema.select("id", F.lit(0.0).alias("score")).limit(0)
        weights = F.create_map(*(x for w in wanted for x in (F.lit(w), F.greatest(F.lit(1e-6), F.log(F.lit((stats["n"] - df[w] + 0.5) / (df[w] + 0.5)))))))
        part = weights[F.col("term")] * F.col("tf") * (S.K1 + 1) / (F.col("tf") + S.K1 * (1 - S.B + S.B * F.col("dl") / F.lit(stats["avgdl"])))
        scored = hits.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("held")).where(F.col("held") == len(wanted))
        return scored.select("id", "score").orderBy(F.col("score").desc(), "id").limit(limit)


def route(query: str) -> str:
    """``fused`` for plain words, ``lexical`` where a query filters, negates or quotes, has an expression, is empty or cannot be parsed."""
    try:
        plan = S.parse(query)
    except S.SearchError:
        return "lexical"
    return "fused" if query.strip() and not plan.structured else "lexical"


def expanded(query: list[float], passages: list[list[float]]) -> list[float]:
    """The element-wise mean of a query's vector and those of passages written for it; without a passage the query's own."""
    every = [query, *(p for p in passages if len(p) == len(query))]
    return [sum(x) / len(every) for x in zip(*every, strict=True)]


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float] | None, *, reference, roots: list[str] | None = None, limit: int = 20, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(path, score) by the route of the query: rank fusion of BM25 and vectors (path, embedding), else the lexical search.

    With several ``roots`` each root is searched alone, the first place of a path counts, and all are ordered by score again.
    """
    if route(query) == "lexical" or vector is None:
        return S.search(docs, query, reference, scope=roots, limit=limit).select("path", "score")
    found = []
    for place, root in enumerate(roots or [""]):
        inside, near = docs.where(F.col("path").startswith(root)), vectors.where(F.col(id).startswith(root))
        lex = R.top_ranked(S.bm25(inside, "path", F.concat_ws("\n", "title", "body"), words_of(query)), "id", limit)
        sem = R.top_ranked(R.vector_search(near, vector, limit, id=id, vector=embedding), id, limit)
        found.append(R.fuse(lex, sem, limit).select(F.col("id").alias("path"), "score", F.lit(place).alias("_sl_root")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("path").agg(F.min_by("score", "_sl_root").alias("score")).orderBy(F.col("score").desc(), "path").limit(limit)


def embedded(docs: DataFrame, text: str, model: Column | None = None, dimensions: int = 768) -> DataFrame:
    """``docs`` with vector, model and pending: the caller's vectors where there are any, else the local ones, marked as pending."""
    given = F.lit(None).cast("array<float>") if model is None else model
    return docs.withColumn("_sl_g", given).select(
        *docs.columns, F.coalesce("_sl_g", R.embed_locally(text, dimensions)).alias("vector"), F.when(F.col("_sl_g").isNotNull(), "model").otherwise("local-hash").alias("model"), F.col("_sl_g").isNull().alias("pending")
    )


def notebook_search(docs: DataFrame, sources: DataFrame, query: str, prefix: int = 1500) -> DataFrame:
    """(path, score, snippet) of a notebook's sources (path) only: those that hold every word score 1, the others 0 with their first bytes.

    A character that is cut there is shown as the replacement character.
    """
    mine = docs.join(sources.select("path").distinct(), "path", "left_semi").withColumn("_sl_w", S.words(F.concat_ws("\n", "title", "body")))
    ws = words_of(query)
    hit = reduce(and_, (F.array_contains("_sl_w", w) for w in ws), F.lit(bool(ws)))
    head = F.when(F.octet_length("body") > prefix, F.make_valid_utf8(F.substring(F.encode("body", "UTF-8"), 1, prefix).cast("string"))).otherwise(F.col("body"))
    return mine.select("path", F.when(hit, 1.0).otherwise(0.0).alias("score"), F.when(~hit, head).alias("snippet")).orderBy(F.col("score").desc(), "path")
