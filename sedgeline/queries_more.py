"""Further queries: projections, scoped searches, state tables, summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import retrieval as R
from .operators import search as S
from .queries_docs import _bm25_sql
from .registry import base, query, table
from .sources import sinks as K

NOW = dt.datetime(2025, 6, 1)


@query("D14_metadata_weighting", "SELECT doc_id, trim(concat_ws(' ', t, t, t, a, a, coalesce(status, ''))) AS m FROM (SELECT doc_id, concat_ws(' ', title, array_to_string(tags, ' ')) AS t, person AS a, status FROM files_d)", ("files_d",))
def metadata(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    return f.select("doc_id", R.weighted_metadata(F.col("title"), F.col("tags"), F.array("person"), F.coalesce("status", F.lit(""))).alias("m"))


_CHUNK_SEARCH = f"SELECT id AS path, score FROM ({_bm25_sql('files_d', 'path', 'body', ['the', 'of'], '')}) WHERE starts_with(id, 'notes/en/src1') ORDER BY score DESC, path LIMIT 10"


@query("D15_bm25_prefix", _CHUNK_SEARCH, ("files_d",))
def bm25_prefix(spark, sf_dir):
    hits = S.bm25(base(spark, sf_dir, "files_d"), "path", F.col("body"), ["the", "of"]).where(F.col("id").startswith("notes/en/src1"))
    return hits.select(F.col("id").alias("path"), F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "path").limit(10)


@query("W8_recent_first", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END, TIMESTAMP '1996-01-01') DESC, o_orderkey) AS place FROM orders")
def recent_first(spark, sf_dir):
    at = F.coalesce(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")), F.expr("TIMESTAMP_NTZ'1996-01-01'"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(at.desc(), "o_orderkey")).alias("place"))


@query("X27_quantized", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) / m * 7) AS INT)), ',') AS code FROM (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM embeddings)")
def quantized(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(R.quantized(F.col("embedding")), ",").alias("code"))


@query("K7_view_export", "SELECT title, person, status FROM files_d WHERE type = 'letter'", ("files_d",))
def view_export(spark, sf_dir):
    f = base(spark, sf_dir, "files_d").where("type = 'letter'").select("status", "title", "person")
    return f.select(*K.csv_columns(f, []))


@query("K11_search_notebook", f"SELECT array_to_string(list(path ORDER BY score DESC, path), ';') AS sources FROM (SELECT id AS path, score FROM ({_bm25_sql('files_d', 'path', 'concat_ws(chr(10), title, body)', ['moron'], '')}) ORDER BY score DESC, path LIMIT 20)", ("files_d",))
def search_notebook(spark, sf_dir):
    hits = S.search(base(spark, sf_dir, "files_d"), "moron", NOW).withColumn("score", F.round("score", 6))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "path")))
    return hits.agg(F.array_join(F.transform(ordered, lambda x: x["path"]), ";").alias("sources"))


@query("O4_view_order", "SELECT path FROM files_d WHERE starts_with(path, 'notes/de/') ORDER BY path LIMIT 1000", ("files_d",))
def view_order(spark, sf_dir):
    from .plans.views import View, run

    return run(base(spark, sf_dir, "files_d"), View("v", "notes/de/", columns=("path",), limit=10_000))
