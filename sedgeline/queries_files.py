"""Queries that go through files: snapshots, journals, exports, backups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import dataset as D
from .plans.spec import SpecError, parse
from .queries_data import ORDERS
from .registry import base, query, table
from .sources import files as SRC
from .sources import sinks as K


def workspace(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; a temporary one in plain local mode without a checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sedgeline-files-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root.rstrip('/')}/sedgeline-files/{uuid.uuid4().hex}"


_SNAPSHOTS = "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'new, \"x\"' ELSE o_orderstatus END AS status FROM orders"


@query("S6_snapshots", _SNAPSHOTS)
@query("S3_strict_csv", _SNAPSHOTS)
def snapshots(spark, sf_dir):
    folder = workspace(spark)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"))
    for name, rows in (("2024-01-01", o), ("2024-01-02", o.where("key % 4 = 0").withColumn("status", F.lit('new, "x"')))):
        rows.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    both = [SRC.read_csv(spark, f"{folder}/{n}").withColumn("snapshot", F.lit(n)) for n in ("2024-01-01", "2024-01-02")]
    return D.latest(both[0].unionByName(both[1]), "key", ["snapshot"]).select("key", "status")


@query("S24_journal_segments", "SELECT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS id, CAST(turn AS BIGINT) AS seq, text AS body FROM conversations")
def journal_segments(spark, sf_dir):
    folder = workspace(spark)
    d = table(spark, sf_dir, "conversations")
    event = F.struct(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("author"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("body"))
    d.select(F.to_json(event)).write.text(f"{folder}/parts")
    lines = spark.read.text(f"{folder}/parts").where("trim(value) <> ''")
    return lines.select(F.from_json("value", SRC.EVENT, {"mode": "FAILFAST"}).alias("e")).select("e.id", "e.seq", "e.body")


@query("K8_markdown_table", "SELECT concat('| r_regionkey | r_name |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', r_regionkey, ' | ', r_name, ' |'), chr(10) ORDER BY r_regionkey)) AS md FROM region")
def markdown_table(spark, sf_dir):
    text = K.markdown_table(table(spark, sf_dir, "region").orderBy("r_regionkey"), ["r_regionkey", "r_name"])
    return spark.createDataFrame([(text,)], "md string")


@query("P2_column_validation", "SELECT 'dataset column \"missing\" not found' AS error")
def validation(spark, sf_dir):
    try:
        D.query(base(spark, sf_dir, "orders_d"), ORDERS, parse({"columns": ["missing"]}))
        found = ""
    except SpecError as e:
        found = str(e)
    return spark.createDataFrame([(found,)], "error string")


@query("A6_unsupported_aggregate", "SELECT 'unsupported aggregate \"median\"' AS error")
def unsupported(spark, sf_dir):
    try:
        D.query(base(spark, sf_dir, "orders_d"), ORDERS, parse({"aggregates": [{"function": "median", "column": "total"}]}))
        found = ""
    except SpecError as e:
        found = str(e)
    return spark.createDataFrame([(found,)], "error string")
