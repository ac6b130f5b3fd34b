"""Where queries are registered, and the tables and derived datasets that they run over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Derived datasets in SQL that both engines read; {list} stands for the array constructor, {split} for splitting at blanks.
BASES = {
    "orders_d": """SELECT o_orderkey AS key, o_custkey AS customer, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS total, o_orderdate AS placed, o_orderpriority AS priority, o_totalprice > 150000 AS big FROM orders""",
    "parts_d": "SELECT p_partkey AS key, p_name AS name, p_brand AS brand, {split}(p_name, ' ') AS kinds, p_size AS size, p_retailprice AS price FROM part",
    "files_d": """SELECT doc_id, concat('notes/', lang, '/', source, '/', CAST(doc_id AS STRING), CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.md' END) AS path,
        split_part(text, '.', 1) AS title, text AS body, lang, source AS person, {list}(lang, source) AS tags,
        CASE WHEN doc_id % 4 = 0 THEN 'paid' WHEN doc_id % 4 = 1 THEN 'open' WHEN doc_id % 4 = 2 THEN 'Draft' END AS status,
        CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'invoice' WHEN doc_id % 3 = 1 THEN 'contract' ELSE 'letter' END AS type,
        CASE WHEN doc_id % 17 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 700 AS INT) END AS document_date,
        DATE '2025-01-01' + CAST(doc_id % 400 AS INT) AS due_date, (doc_id * 37) % 101 AS confidence, doc_id % 29 = 0 AS review_ignored,
        CASE WHEN doc_id % 6 = 0 THEN 'stale' END AS index_status,
        CAST(DATE '2024-03-01' + CAST(doc_id % 500 AS INT) AS TIMESTAMP{ntz}) AS created, CAST(DATE '2025-01-01' + CAST(doc_id % 300 AS INT) AS TIMESTAMP{ntz}) AS modified FROM documents""",
    "log_d": """SELECT conv_id, turn, concat('a', CAST(conv_id % 9 AS STRING)) AS author, role AS kind, CAST(turn AS BIGINT) * 3 + conv_id % 5 AS lamport, conv_id * 100 + turn AS ts, conv_id AS seq,
        concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, text AS body FROM conversations""",
}
SPARK_WORDS = {"split": "split", "list": "array", "ntz": "_NTZ"}
DUCK_WORDS = {"split": "string_split", "list": "list_value", "ntz": ""}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived dataset as a DataFrame."""
    sql = BASES[name].format(**SPARK_WORDS)
    source = next(t for t in TABLES if sql.rstrip().endswith(f"FROM {t}"))
    return spark.sql(sql[: -len(source)] + "{t}", t=table(spark, sf_dir, source))


def query(name: str, sql: str | None = None, bases: tuple[str, ...] = ()):
    """Registers a query with its SQL; names of derived datasets in ``bases`` are common table expressions of it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            heads = [f"{b} AS ({BASES[b].format(**DUCK_WORDS)})" for b in bases]
            text = sql.strip()
            if heads:
                text = f"WITH {', '.join(heads)}" + (f", {text[5:]}" if text.upper().startswith("WITH ") else f" {text}")
            ORACLES[name] = text
        return f

    return add
