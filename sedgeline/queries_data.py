"""Queries of the dataset dialect: filters, aggregates, order, paging, typing, latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar as X
from .plans import dataset as D
from .plans.predicates import compile_all, view_filter
from .plans.spec import Filter, Schema, parse
from .registry import base, query, table

ORDERS = Schema({"key": "number", "customer": "number", "status": "text", "total": "number", "placed": "datetime", "priority": "text", "big": "checkbox"}, "key")
PARTS = Schema({"key": "number", "name": "text", "brand": "text", "kinds": "list", "size": "number", "price": "number"}, "key")


def _filter_query(name: str, on: str, spec: dict, where: str) -> None:
    schema = ORDERS if on == "orders_d" else PARTS

    def run(spark, sf_dir):
        return D.filtered(base(spark, sf_dir, on), schema, parse(spec)).select("key")

    query(name, f"SELECT key FROM {on} WHERE {where}", (on,))(run)


def _one(key: str, operator: str, value: object = "") -> dict:
    return {"filters": [{"key": key, "operator": operator, "value": value}]}


for _name, _on, _spec, _where in [
    ("F1_equals_number", "orders_d", _one("customer", "equals", 37), "customer = 37"),
    ("F1_equals_text", "orders_d", _one("status", "is", "o"), "lower(status) = 'o'"),
    ("F1_equals_date", "orders_d", _one("placed", "=", "1995-03-05"), "placed = TIMESTAMP '1995-03-05'"),
    ("F2_equals_empty", "orders_d", _one("status", "equals", ""), "status IS NULL OR status = ''"),
    ("F3_not_equals", "orders_d", _one("status", "is_not", "F"), "status IS NULL OR lower(status) <> 'f'"),
    ("F3_not_equals_number", "orders_d", _one("total", "!=", 1000), "total IS NULL OR total <> 1000"),
    ("F4_is_empty", "orders_d", _one("total", "empty"), "total IS NULL"),
    ("F4_is_not_empty", "orders_d", _one("status", "not_empty"), "status IS NOT NULL AND status <> ''"),
    ("F5_contains", "orders_d", _one("priority", "contains", "URG"), "lower(priority) LIKE '%urg%'"),
    ("F5_contains_wildcard", "orders_d", _one("priority", "contains", "1%_n"), "lower(priority) LIKE '%1%_n%'"),
    ("F5_not_contains", "orders_d", _one("status", "not_contains", "P"), "status IS NULL OR NOT lower(status) LIKE '%p%'"),
    ("F6_starts_with", "orders_d", _one("priority", "prefix", "2-h"), "lower(priority) LIKE '2-h%'"),
    ("F6_ends_with", "orders_d", _one("priority", "suffix", "GENT"), "lower(priority) LIKE '%gent'"),
    ("F7_greater_than", "orders_d", _one("total", "gt", 200000), "total > 200000"),
    ("F7_at_least", "orders_d", _one("total", ">=", "250000.5"), "total >= 250000.5"),
    ("F7_greater_than_text", "orders_d", _one("status", "gt", "Z"), "lower(status) > 'Z'"),
    ("F7_at_most_date", "orders_d", _one("placed", "lte", "1996-02-01"), "placed <= TIMESTAMP '1996-02-01'"),
    ("F8_after", "orders_d", _one("placed", "after", "1996-06-01"), "placed > TIMESTAMP '1996-06-01'"),
    ("F8_on_or_before", "orders_d", _one("placed", "on_or_before", "1995-07-03 10:00"), "placed <= TIMESTAMP '1995-07-03 10:00:00'"),
    ("F9_in", "orders_d", _one("status", "in", "[o, P]"), "lower(status) IN ('o', 'p')"),
    ("F9_in_number", "orders_d", _one("customer", "in", "1 2 3 40"), "customer IN (1, 2, 3, 40)"),
    ("F9_contains_any", "parts_d", _one("kinds", "contains_any", "ring,BOLT"), "list_has_any(list_transform(kinds, lambda x: lower(x)), ['ring', 'bolt'])"),
    ("F10_not_in", "orders_d", _one("status", "not_in", "o,p"), "status IS NULL OR lower(status) NOT IN ('o', 'p')"),
    ("F11_contains_none", "parts_d", _one("kinds", "contains_none", "ring,BOLT"), "NOT list_has_any(list_transform(kinds, lambda x: lower(x)), ['ring', 'bolt'])"),
    ("F11_contains_none_scalar", "orders_d", _one("status", "contains_none", "o"), "TRUE"),
    ("F12_contains_all", "parts_d", _one("kinds", "contains_all", "red widget"), "list_has_all(list_transform(kinds, lambda x: lower(x)), ['red', 'widget'])"),
    ("F13_empty_set", "orders_d", _one("status", "not_in", ""), "TRUE"),
    ("F14_unknown_operator", "orders_d", _one("status", "resembles", "F"), "lower(status) = 'f'"),
    (
        "F15_nested_groups",
        "orders_d",
        {"filter_group": {"operator": "any", "filters": [{"key": "status", "operator": "equals", "value": "P"}], "groups": [{"operator": "all", "filters": [{"key": "total", "operator": "gt", "value": 300000}, {"key": "priority", "operator": "prefix", "value": "1"}], "groups": [{"operator": "any"}]}]}},
        "lower(status) = 'p' OR (total > 300000 AND lower(priority) LIKE '1%')",
    ),
    (
        "F16_filters_and_group",
        "orders_d",
        _one("big", "equals", "true") | {"filter_group": {"operator": "any", "filters": [{"key": "status", "operator": "is_empty"}, {"key": "customer", "operator": "lt", "value": 20}]}},
        "big AND (status IS NULL OR status = '' OR customer < 20)",
    ),
    ("F18_boolean_set", "orders_d", _one("big", "in", "true"), "big"),
]:
    _filter_query(_name, _on, _spec, _where)


def _dataset_query(name: str, on: str, spec: dict, sql: str, strict: bool = False) -> None:
    schema = ORDERS if on == "orders_d" else PARTS

    def run(spark, sf_dir):
        out = D.query(base(spark, sf_dir, on), schema, parse(spec), strict)
        return out.select(*(F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

    query(name, sql, (on,))(run)


_dataset_query(
    "dataset_group_query",
    "orders_d",
    {"group_by": "priority", "aggregates": [{"function": "count"}, {"function": "sum", "column": "total", "as": "total"}], "filters": [{"key": "placed", "operator": "on_or_after", "value": "1996-01-01"}], "limit": 10},
    "SELECT priority, count(*) AS count, round(sum(total), 2) AS total FROM orders_d WHERE placed >= TIMESTAMP '1996-01-01' GROUP BY priority ORDER BY priority LIMIT 10",
)
_dataset_query("P1_projection", "orders_d", {"columns": ["_key", " status", "status", "total"], "limit": 25}, "SELECT key, status, round(total, 2) AS total FROM orders_d ORDER BY key LIMIT 25")
_dataset_query("P1_default_columns", "orders_d", {"limit": 3}, "SELECT big, customer, key, placed, priority, status, round(total, 2) AS total FROM orders_d ORDER BY key LIMIT 3")
_dataset_query("F17_strict_page", "orders_d", {"columns": ["key"], "filters": [{"key": "total", "operator": "gt", "value": 100}], "limit": 40, "offset": 7}, "SELECT key FROM orders_d WHERE total > 100 ORDER BY key LIMIT 40 OFFSET 7", True)
_dataset_query("A1_counts", "orders_d", {"aggregates": [{"function": "count"}, {"function": "count", "column": "status"}]}, "SELECT count(*) AS count, count(status) AS count_status FROM orders_d")
_dataset_query("A2_sum_average", "orders_d", {"group_by": "status", "aggregates": [{"function": "sum", "column": "total"}, {"function": "average", "column": "total"}]}, "SELECT status, round(sum(total), 2) AS sum_total, round(avg(total), 2) AS average_total FROM orders_d GROUP BY status ORDER BY status NULLS FIRST LIMIT 10")
_dataset_query("A3_min_max", "orders_d", {"group_by": "priority", "aggregates": [{"function": "min", "column": "total"}, {"function": "max", "column": "placed"}]}, "SELECT priority, round(min(total), 2) AS min_total, max(placed) AS max_placed FROM orders_d GROUP BY priority LIMIT 10")
_dataset_query("A4_group_default", "orders_d", {"group_by": "status", "limit": 2, "offset": 1}, "SELECT status, count(*) AS count FROM orders_d GROUP BY status ORDER BY status NULLS FIRST LIMIT 2 OFFSET 1")
_dataset_query("A5_aliases", "parts_d", {"group_by": "brand", "aggregates": [{"function": "MAX", "column": "size"}, {"function": "sum", "column": "price", "as": "worth"}], "limit": 1000}, "SELECT brand, max(size) AS max_size, round(sum(price), 2) AS worth FROM parts_d GROUP BY brand")
_dataset_query("O1_sorts_nulls_last", "orders_d", {"columns": ["key", "status", "total"], "sorts": [{"key": "status", "ascending": False}, {"key": "total"}], "limit": 300}, "SELECT key, status, round(total, 2) AS total FROM orders_d ORDER BY status DESC NULLS LAST, orders_d.total ASC NULLS LAST, key LIMIT 300")
_dataset_query("O2_default_order", "parts_d", {"columns": ["name"]}, "SELECT name FROM parts_d ORDER BY key LIMIT 10")
_dataset_query("O3_limits", "orders_d", {"columns": ["key"], "limit": 5000, "offset": -3}, "SELECT key FROM orders_d ORDER BY key LIMIT 1000")


@query("A8_total_rows", "SELECT count(*) AS total_rows, least(25, count(*)) AS returned_rows, count(*) > 25 AS capped FROM orders_d WHERE total > 200000", ("orders_d",))
def total_rows(spark, sf_dir):
    return D.total(base(spark, sf_dir, "orders_d"), ORDERS, parse(_one("total", "gt", 200000) | {"limit": 25}))


@query("A7_group_count", "SELECT priority, count(*) AS count, (SELECT count(DISTINCT priority) FROM orders_d) AS total_groups, (SELECT count(DISTINCT priority) FROM orders_d) > 3 AS capped FROM orders_d GROUP BY priority ORDER BY priority LIMIT 3", ("orders_d",))
def group_count(spark, sf_dir):
    return D.group_count(base(spark, sf_dir, "orders_d"), "priority", 3)


@query("A12_coverage", "SELECT min(coalesce(o, l)) AS first_date, max(coalesce(o, l)) AS last_date FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS o, TIMESTAMP '1990-01-01' AS l FROM orders)")
def coverage(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("o"), F.expr("TIMESTAMP_NTZ'1990-01-01'").alias("l"))
    return D.coverage(d, ["o", "l"])


@query("A13_infer_types", "SELECT * FROM (VALUES ('flag', 'checkbox'), ('n', 'number'), ('d', 'date'), ('t', 'text')) AS v(\"column\", type)")
def infer(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2
    return D.infer_types(d.select(even.cast("string").alias("flag"), F.when(even == 0, "").otherwise(F.col("o_totalprice").cast("string")).alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderpriority").alias("t")))


@query("A14_options", "SELECT min(o) AS option FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o FROM orders) GROUP BY lower(o)")
def options(spark, sf_dir):
    return D.options(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("o")), "o")


@query("A9_space_histogram", "SELECT len(embedding) AS dim, label, count(*) AS n FROM embeddings GROUP BY ALL")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dim"), "label").agg(F.count("*").alias("n"))


@query("A10_status_snapshot", "SELECT count(*) AS files, max(modified) AS updated, count(*) FILTER (index_status = 'stale') AS pending, count(DISTINCT lang) > 1 AS mixed FROM files_d", ("files_d",))
def snapshot(spark, sf_dir):
    stale = F.count(F.when(F.col("index_status") == "stale", 1))
    return base(spark, sf_dir, "files_d").agg(F.count("*").alias("files"), F.max("modified").alias("updated"), stale.alias("pending"), (F.countDistinct("lang") > 1).alias("mixed"))


@query("A20_distinct_pending", "SELECT count(DISTINCT person) AS n FROM files_d WHERE index_status = 'stale'", ("files_d",))
def distinct_pending(spark, sf_dir):
    return base(spark, sf_dir, "files_d").where("index_status = 'stale'").agg(F.countDistinct("person").alias("n"))


@query("W2_latest_row", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest(spark, sf_dir):
    return D.latest(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("X20_row_hash", "SELECT p_partkey, sha256(concat('7:p_brand=', strlen(p_brand), ':', p_brand, chr(10), '6:p_name=', strlen(p_name), ':', p_name, chr(10))) AS h FROM part")
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.row_hash(["p_name", "p_brand"]).alias("h"))


@query("X20_row_key", "SELECT c_custkey, concat('identity:', c_name) AS k FROM customer")
def keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.row_key(F.col("c_name"), ["c_mktsegment"]).alias("k"))


@query("X7_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_exists(props, '$.k')")
def json(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").where(k.isNotNull()).select("event_id", k.cast("long").alias("k"))


@query("X8_numbers", "SELECT p_partkey, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS s FROM (SELECT p_partkey, p_size / 2.0 AS x FROM part)")
def numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.render_number((F.col("p_size") / 2.0).cast("double")).alias("s"))


@query("X9_formula", "SELECT p_partkey, concat(p_brand, ' / ', p_name, '') AS label FROM part")
def formula(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.template("{p_brand} / {p_name}{gone}", {"p_brand": F.col("p_brand"), "p_name": F.col("p_name")}).alias("label"))


@query("X10_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slugify(F.col("p_type")).alias("slug"))


@query("X30_path_template", "SELECT o_orderkey, concat('out/', o_orderpriority, '/', strftime(o_orderdate, '%Y-%m'), '/unknown') AS p FROM orders")
def paths(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.path_template("out/{o_orderpriority}/{date:%Y-%m}/{gone}", {"o_orderpriority": F.col("o_orderpriority")}, F.col("o_orderdate")).alias("p"))


@query("X29_contact_values", "SELECT c_custkey, concat('+', regexp_replace(concat(c_custkey, ' (0) ', c_nationkey), '[^0-9]', '', 'g')) AS phone, lower(c_name) AS handle FROM customer")
def contact_values(spark, sf_dir):
    d = table(spark, sf_dir, "customer")
    phone = F.concat(F.lit("+"), F.col("c_custkey").cast("string"), F.lit(" (0) "), F.col("c_nationkey").cast("string"))
    return d.select("c_custkey", X.contact_value(F.lit("phone"), phone).alias("phone"), X.contact_value(F.lit("handle"), F.concat(F.lit("@"), F.col("c_name"))).alias("handle"))


@query("X33_sensitivity", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS r FROM customer")
def sensitivity(spark, sf_dir):
    level = F.when(F.col("c_mktsegment") == "BUILDING", "public").when(F.col("c_mktsegment") == "MACHINERY", "confidential")
    return table(spark, sf_dir, "customer").select("c_custkey", X.sensitivity_rank(level).alias("r"))


@query("X35_clock", "SELECT event_id, printf('%02d:%02d:%02d.%03d', event_id * 977 // 3600000, event_id * 977 // 60000 % 60, event_id * 977 // 1000 % 60, event_id * 977 % 1000) AS t FROM events")
def clock(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.clock(F.col("event_id") * 977).alias("t"))


@query("X38_import_identity", "SELECT c_custkey, concat('import:', substr(sha256(concat(c_name, '|', c_mktsegment)), 1, 16)) AS k FROM customer")
def import_identity(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("import:"), F.substring(F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256), 1, 16)).alias("k"))


def _view_query(name: str, f: Filter, column: str, where: str) -> None:
    def run(spark, sf_dir):
        return base(spark, sf_dir, "orders_d").where(view_filter(f, F.col(column).cast("string"))).select("key")

    query(name, f"SELECT key FROM orders_d WHERE {where}", ("orders_d",))(run)


_view_query("V1_number", Filter("total", "gt", "2_00000"), "total", "total > 200000")
_view_query("V1_text", Filter("status", "not_equals", "O"), "status", "lower(coalesce(status, '')) <> 'o'")
_view_query("V2_number_equality", Filter("customer", "equals", "37.0"), "customer", "customer = 37")
_view_query("V3_date", Filter("placed", "on_or_after", "1997-01-01"), "placed", "placed >= TIMESTAMP '1997-01-01'")
_view_query("V4_set", Filter("status", "not_in", "o, f"), "status", "coalesce(lower(status), '') NOT IN ('o', 'f')")


@query("V5_groups", "SELECT key FROM orders_d WHERE contains(lower(priority), 'low') OR total > 300000", ("orders_d",))
def view_groups(spark, sf_dir):
    d = base(spark, sf_dir, "orders_d")
    return d.where(view_filter(Filter("priority", "contains", "LOW"), F.col("priority")) | view_filter(Filter("total", "gt", "300000"), F.col("total").cast("string"))).select("key")


@query("S8_rows_of_dataset", "SELECT key, status FROM orders_d WHERE customer = 11 ORDER BY key LIMIT 50", ("orders_d",))
def dataset_rows(spark, sf_dir):
    return base(spark, sf_dir, "orders_d").where("customer = 11").orderBy("key").limit(50).select("key", "status")


@query("F16_compiled_pushdown", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND lower(o_orderstatus) = 'f'")
def pushdown(spark, sf_dir):
    schema = Schema({"o_orderkey": "number", "o_totalprice": "number", "o_orderstatus": "text"}, "o_orderkey")
    return table(spark, sf_dir, "orders").where(compile_all((Filter("o_totalprice", "gt", "250000"), Filter("o_orderstatus", "is", "F")), None, schema)).select("o_orderkey")
