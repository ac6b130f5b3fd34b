"""Queries over sources, sinks, joins, sets, change streams and a few extensions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .functions import scalar as X
from .functions import text as TX
from .registry import base, query, table
from .sources import files as SRC
from .sources import sinks as K
from .streaming import changes as ST

# --- joins --------------------------------------------------------------------------------------------------------------


@query("J1_properties", "SELECT f.doc_id, f.type, l.quality, l.toxic FROM files_d f LEFT JOIN labels l ON l.doc_id = f.doc_id", ("files_d",))
def properties(spark, sf_dir):
    return base(spark, sf_dir, "files_d").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "type", "quality", "toxic")


@query("J2_lifecycle", "SELECT doc_id, coalesce(index_status, 'indexed') AS state FROM files_d", ("files_d",))
@query("D44_index_status", "SELECT doc_id, coalesce(index_status, 'indexed') AS state FROM files_d", ("files_d",))
def lifecycle(spark, sf_dir):
    return base(spark, sf_dir, "files_d").select("doc_id", F.coalesce("index_status", F.lit("indexed")).alias("state"))


@query("J3_hits", "SELECT f.doc_id, f.status FROM files_d f JOIN labels l ON l.doc_id = f.doc_id WHERE l.toxic = 1", ("files_d",))
def hits(spark, sf_dir):
    return base(spark, sf_dir, "files_d").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id", "status")


@query("J4_property_absent", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def absent(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("J5_pending", "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 0)")
def pending(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_semi").select("doc_id")


@query("J7_job_page", "SELECT o_orderkey, c_name, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey) AS total FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def job_page(spark, sf_dir):
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return d.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(20).join(F.broadcast(d.agg(F.count("*").alias("total")))).select("o_orderkey", "c_name", "total")


@query("J9_classification_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def classified(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("J10_document_access", "SELECT doc_id FROM files_d WHERE doc_id % 3 <> 0 OR person = 'src4' OR (doc_id % 3 = 0 AND doc_id % 4 = 1) OR (doc_id % 3 = 0 AND lang = 'de')", ("files_d",))
def access(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    rules = f.where("doc_id % 3 = 0").select("path", F.col("person").alias("owner"), F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("src4"))).otherwise(F.array()).alias("users"), F.array("lang").alias("groups"))
    return K.allowed(f, rules, "src4", ["de"]).select("doc_id")


@query("J19_stale_derived", "SELECT a.doc_id FROM files_d a LEFT JOIN files_d b ON b.doc_id = a.doc_id - 1 WHERE b.modified > a.modified", ("files_d",))
def stale(spark, sf_dir):
    f = base(spark, sf_dir, "files_d").select("doc_id", "modified")
    return f.join(f.select((F.col("doc_id") + 1).alias("doc_id"), F.col("modified").alias("source")), "doc_id", "left").where("source > modified").select("doc_id")


@query("J8_points_of_persons", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000")
@query("J6_bodies", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000")
def points(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 5000").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")


@query("J22_candidates", "SELECT vec_id FROM embeddings WHERE label IN (1, 3)")
def candidates(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").join(spark.createDataFrame([(1,), (3,)], "label int"), "label", "left_semi").select("vec_id")


# --- sets ---------------------------------------------------------------------------------------------------------------


@query("U1_union_legs", "SELECT doc_id, 'q' AS leg FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 't' FROM labels WHERE toxic = 1")
def union_legs(spark, sf_dir):
    d = table(spark, sf_dir, "labels")
    return d.where("quality = 0").select("doc_id", F.lit("q").alias("leg")).unionByName(d.where("toxic = 1").select("doc_id", F.lit("t").alias("leg")))


@query("U5_stale_paths", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def stale_paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@query("U6_first_root_wins", "SELECT path, min(root) AS root FROM (SELECT title AS path, 1 AS root FROM files_d WHERE doc_id % 2 = 0 UNION ALL SELECT title, 2 FROM files_d WHERE doc_id % 3 = 0) GROUP BY path", ("files_d",))
def roots(spark, sf_dir):
    f = base(spark, sf_dir, "files_d").select("doc_id", F.col("title").alias("path"))
    return f.where("doc_id % 2 = 0").select("path", F.lit(1).alias("root")).union(f.where("doc_id % 3 = 0").select("path", F.lit(2))).groupBy("path").agg(F.min("root").alias("root"))


@query("U7_token_intersection", "SELECT doc_id FROM documents WHERE list_has_all(string_split(lower(text), ' '), ['the', 'and', 'of'])")
def token_and(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.size(F.array_except(F.array(F.lit("the"), F.lit("and"), F.lit("of")), F.split(F.lower("text"), " "))) == 0).select("doc_id")


@query("U8_contact_export", "SELECT c_custkey, c_name, n_name, count(o_orderkey) AS interactions FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def contact_export(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("interactions"))
    return c.join(n, "c_custkey", "left").select("c_custkey", "c_name", "n_name", F.coalesce("interactions", F.lit(0)).alias("interactions"))


@query("A18_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


# --- sources and sinks --------------------------------------------------------------------------------------------------


@query("S13_html_text")
def html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", SRC.page_text("html").alias("text"))


@query("S5_csv_text", "SELECT p_partkey, concat_ws(chr(9), p_name, p_brand, CAST(p_size AS VARCHAR)) AS t FROM part")
def csv_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", SRC.csv_text(["p_name", "p_brand", "p_size"]).alias("t"))


@query("S9_file_listing", "SELECT path FROM files_d WHERE starts_with(path, 'notes/de/') ORDER BY path", ("files_d",))
def listing(spark, sf_dir):
    return base(spark, sf_dir, "files_d").where(F.col("path").startswith("notes/de/")).orderBy("path").select("path")


@query("S10_property_map", "SELECT doc_id, person, CASE WHEN lang = 'xx' THEN lang END AS other FROM files_d", ("files_d",))
def property_map(spark, sf_dir):
    m = F.create_map(F.lit("person"), "person", F.lit("lang"), "lang")
    return base(spark, sf_dir, "files_d").select("doc_id", m["person"].alias("person"), F.try_element_at(m, F.lit("other")).alias("other"))


@query("S18_file_kind", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'txt' ELSE 'md' END AS kind FROM documents")
def kinds(spark, sf_dir):
    return base(spark, sf_dir, "files_d").select("doc_id", SRC.kind_of(F.col("body").cast("binary"), F.col("path")).alias("kind"))


@query("S26_header_mapping", "SELECT c_name AS name, c_mktsegment AS organization, c_custkey AS id FROM customer")
def headers(spark, sf_dir):
    return SRC.map_headers(table(spark, sf_dir, "customer").select(F.col("c_name").alias("Full Name"), F.col("c_mktsegment").alias("Company"), F.col("c_custkey").alias("id")))


@query("K1_replace_rows", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey END AS c FROM orders")
def upserts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return K.upsert(o.select("o_orderkey", F.col("o_custkey").alias("c")), o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit(0).cast("long").alias("c")), "o_orderkey")


@query("K4_delete", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def deletes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return K.delete(o, o.where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey").select("o_orderkey")


_NOTES = "SELECT p_partkey, concat('parts/', slug, CASE WHEN n > 1 THEN concat('-', n) ELSE '' END, '.md') AS path FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part))"


@query("K9_import_paths", _NOTES)
@query("W7_collision_numbers", _NOTES)
def import_paths(spark, sf_dir):
    return K.note_paths(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name"), "parts").select("p_partkey", "path")


_CONV = "SELECT conv_id AS meeting, string_agg(concat('**', role, '**: ', left(text, 20)), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


@query("K12_transcript_md", _CONV)
@query("O11_transcript_order", _CONV)
def transcripts(spark, sf_dir):
    d = table(spark, sf_dir, "conversations")
    seg = d.select(F.col("conv_id").alias("meeting"), F.col("turn").alias("id"), F.col("role").alias("speaker"), (F.col("turn") * 1000).alias("start"), (F.col("turn") * 1000 + 900).alias("end"), F.left("text", F.lit(20)).alias("text"))
    return K.transcript(seg, "md")


@query("K12_transcript_srt")
def transcripts_srt(spark, sf_dir):
    d = table(spark, sf_dir, "conversations")
    seg = d.select(F.col("conv_id").alias("meeting"), F.col("turn").alias("id"), F.col("role").alias("speaker"), (F.col("turn") * 1000).alias("start"), (F.col("turn") * 1000 + 900).alias("end"), "text")
    return K.transcript(seg, "srt")


@query("K16_snapshot", "SELECT count(*) AS n, min(path) AS first FROM files_d WHERE doc_id % 3 <> 0", ("files_d",))
def snapshot(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    rules = f.where("doc_id % 3 = 0").select("path", F.lit("nobody").alias("owner"), F.array().cast("array<string>").alias("users"), F.array().cast("array<string>").alias("groups"))
    return K.allowed(f, rules, "me", []).agg(F.count("*").alias("n"), F.min("path").alias("first"))


# --- text and documents -------------------------------------------------------------------------------------------------


@query("X13_dehyphenate", "SELECT doc_id, concat('Kranken', lang, 'versicherung Vor-', chr(10), 'und Nachname ', replace(text, '-', ' ')) AS t FROM documents WHERE text IS NOT NULL")
def dehyphenate(spark, sf_dir):
    t = F.concat(F.lit("Kranken"), "lang", F.lit("-\nversicherung Vor-\nund Nachname "), F.replace("text", F.lit("-"), F.lit(" ")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.dehyphenate(t).alias("t"))


@query("X15_normalize", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS t FROM documents")
def normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("t"))


@query("X18_inline_tags", "SELECT doc_id, concat('tag,a/', lang) AS tags FROM documents WHERE text IS NOT NULL")
def tags(spark, sf_dir):
    md = F.concat(F.lit("# Head #tag and #Tag #123 `#no` http://x.y/#frag #a/"), "lang", F.lit(" "), F.regexp_replace("text", "[#`]", ""))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(TX.inline_tags(md), ",").alias("tags"))


@query("X31_paths", "SELECT doc_id, regexp_extract(path, '[^/]*$') AS b, regexp_extract(path, '[.]([^.]*)$', 1) AS e, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM files_d", ("files_d",))
def paths(spark, sf_dir):
    p = F.col("path")
    return base(spark, sf_dir, "files_d").select("doc_id", X.base_name(p).alias("b"), X.extension(p).alias("e"), X.directory(p).alias("d"))


@query("X2_fold_equality", "SELECT count(*) AS n FROM orders WHERE lower(o_orderpriority) = lower('5-low')")
@query("X1_lower", "SELECT count(*) AS n FROM orders WHERE lower(o_orderpriority) = lower('5-low')")
def folds(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.collate("o_orderpriority", "UTF8_LCASE") == F.collate(F.lit("5-low"), "UTF8_LCASE")).agg(F.count("*").alias("n"))


@query("X3_numbers", "SELECT doc_id, TRY_CAST(regexp_extract(text, '[0-9]+') AS DOUBLE) AS v FROM documents")
def casts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.parse_number(F.regexp_extract("text", "[0-9]+", 0)).alias("v"))


@query("X4_dates", "SELECT o_orderkey, o_orderdate AS d FROM orders")
@query("X5_date_layouts", "SELECT o_orderkey, o_orderdate AS d FROM orders")
def dates(spark, sf_dir):
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.parse_date(form).alias("d"))


@query("X11_property_keys", "SELECT DISTINCT trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9_-]+', '_', 'g'), '_') AS k FROM orders")
def property_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(X.property_key(F.col("o_orderpriority")).alias("k")).distinct()


@query("X37_redact", "SELECT c_custkey, concat('[email] ', regexp_replace(c_name, '[0-9]{8,}', '[number]')) AS t FROM customer")
def redact(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.redact(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@x.org "), "c_name")).alias("t"))


@query("X6_date_ranges", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-31 23:59:59.999999'")
def ranges(spark, sf_dir):
    from .operators.search import date_range

    a, b = date_range("1996-01-01..1996-01-31", dt.datetime(2020, 1, 1))
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))).select("o_orderkey")


@query("X23_short_cap", "SELECT 1 AS n, 50 AS a, 100 AS b")
def short_cap(spark, sf_dir):
    s = F.lit(5).cast("long")
    return spark.range(1, 2).select(F.col("id").cast("int").alias("n"), TX.similarity(s, s, F.lit(True)).alias("a"), TX.similarity(s, s).alias("b"))


@query("X36_alias_list", "SELECT 1 AS n, 'a|b c' AS x")
def aliases(spark, sf_dir):
    return spark.range(1, 2).select(F.col("id").cast("int").alias("n"), F.array_join(TX.alias_list(F.lit("[a, \"b c\"]")), "|").alias("x"))


@query("D29_fingerprint", "SELECT sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM (SELECT sha256(concat('6:p_name=', strlen(p_name), ':', p_name, chr(10))) AS h FROM part)")
def fingerprint(spark, sf_dir):
    h = table(spark, sf_dir, "part").select(X.row_hash(["p_name"]).alias("h"))
    return h.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("fingerprint"))


_MERGED_TAGS = "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: CASE WHEN lower(t) = 'de' THEN 'german' ELSE t END))), ',') AS t FROM files_d"


@query("X19_tag_rewrite", _MERGED_TAGS, ("files_d",))
def rename_tags(spark, sf_dir):
    new = F.transform("tags", lambda t: F.when(F.lower(t) == "de", "german").otherwise(t))
    return base(spark, sf_dir, "files_d").select("doc_id", F.array_join(F.array_sort(F.array_distinct(new)), ",").alias("t"))


@query("D51_conflict_files", "SELECT concat(replace(path, '.md', ''), ' (conflict ', doc_id, ').md') AS conflict, replace(path, '.md', '') || '.md' AS original FROM files_d WHERE doc_id % 40 = 3", ("files_d",))
def conflicts(spark, sf_dir):
    name = F.concat(F.replace("path", F.lit(".md"), F.lit("")), F.lit(" (conflict "), F.col("doc_id").cast("string"), F.lit(").md"))
    files = base(spark, sf_dir, "files_d").select(F.when(F.col("doc_id") % 40 == 3, name).otherwise(F.col("path")).alias("path"))
    return SRC.conflict_files(files)


@query("D52_erase", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 4)")
def erase(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return K.delete(c, c.where("c_custkey % 10 = 4").select("c_custkey"), "c_custkey").select("c_custkey")


@query("D40_view_by_folder", "SELECT doc_id, concat(person, ' - ', coalesce(status, '')) AS label FROM files_d WHERE starts_with(path, 'notes/en/src1/') AND lower(coalesce(status, '')) = 'open' ORDER BY path", ("files_d",))
def view(spark, sf_dir):
    from .plans.spec import Filter
    from .plans.views import View, run

    v = View("v", source="notes/en/src1/", filters=(Filter("status", "is", "OPEN"),), formulas={"label": "{person} - {status}"}, columns=("doc_id", "label"))
    return run(base(spark, sf_dir, "files_d"), v)


# --- changes ------------------------------------------------------------------------------------------------------------


def _ops(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("path"), "ts", F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 4).otherwise(2).alias("op"), "event_id")


@query(
    "R1_debounce",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 4 ELSE 2 END AS op FROM events), b AS (SELECT path, min(ts) AS ts FROM e GROUP BY path
    UNION ALL SELECT b.path, (SELECT min(e.ts) FROM e WHERE e.path = b.path AND e.ts >= b.ts + INTERVAL 3600 SECOND) FROM b WHERE EXISTS (SELECT 1 FROM e WHERE e.path = b.path AND e.ts >= b.ts + INTERVAL 3600 SECOND))
    SELECT b.path, b.ts, CASE WHEN bit_or(e.op) & 1 > 0 THEN 'create' WHEN bit_or(e.op) & 2 > 0 THEN 'write' ELSE 'remove' END AS op FROM b JOIN e ON e.path = b.path AND e.ts >= b.ts AND e.ts < b.ts + INTERVAL 3600 SECOND GROUP BY b.path, b.ts""",
)
def debounce(spark, sf_dir):
    return ST.debounced(_ops(spark, sf_dir), 3_600_000)


@query(
    "R2_quiet_periods",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200 THEN 0 ELSE 1 END AS s FROM events),
    p AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM p GROUP BY user_id, k""",
)
def quiet(spark, sf_dir):
    return ST.quiet_periods(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", 7_200_000)


_CHANGED = """WITH a AS (SELECT doc_id AS path, n_chars + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 5 = 1 THEN 2 ELSE 1 END AS mtime, CASE WHEN doc_id % 10 = 1 THEN 'x' ELSE 'y' END AS h FROM documents WHERE doc_id % 7 <> 0),
    b AS (SELECT doc_id AS path, n_chars AS size, 1 AS mtime, 'y' AS h FROM documents WHERE doc_id % 9 <> 0)
    SELECT path, change FROM (SELECT path, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' WHEN a.size = b.size AND a.mtime = b.mtime THEN NULL WHEN a.h = b.h THEN 'touched' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path)) WHERE change IS NOT NULL"""


@query("R7_incremental_refresh", _CHANGED)
def refresh(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    now = d.where("doc_id % 7 <> 0").select(k.alias("path"), (F.col("n_chars") + F.when(k % 10 == 1, 1).otherwise(0)).alias("size"), F.when(k % 5 == 1, 2).otherwise(1).alias("mtime"), F.when(k % 10 == 1, "x").otherwise("y").alias("sha256"))
    return ST.changed(now, d.where("doc_id % 9 <> 0").select(k.alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), F.lit("y").alias("sha256")))


_JOBS = """SELECT event_id AS job_id FROM (SELECT event_id, ts AS created_at, ts + INTERVAL 5 SECOND AS updated_at, CASE user_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'done' END AS status, event_id % 5 AS attempts, ts + INTERVAL 15 MINUTE AS lease_until FROM events)
    WHERE status = 'pending' OR (status = 'failed' AND attempts < 3 AND updated_at + INTERVAL 10 SECOND <= TIMESTAMP '2024-01-05') OR (status = 'processing' AND lease_until < TIMESTAMP '2024-01-05') ORDER BY created_at, event_id LIMIT 100"""


@query("R5_claim_jobs", _JOBS)
def claims(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = F.col("user_id") % 4
    jobs = e.select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.expr("ts + INTERVAL 5 SECOND").alias("updated_at"), F.when(u == 0, "pending").when(u == 1, "failed").when(u == 2, "processing").otherwise("done").alias("status"), (F.col("event_id") % 5).alias("attempts"), F.expr("ts + INTERVAL 15 MINUTE").alias("lease_until"))
    return ST.claimable(jobs, F.expr("TIMESTAMP_NTZ'2024-01-05'"), 100).select("job_id")


@query("R12_out_of_order", "SELECT id FROM log_d ORDER BY lamport, ts, author, seq, id LIMIT 100", ("log_d",))
def out_of_order(spark, sf_dir):
    from .operators.journal import merged

    return merged(base(spark, sf_dir, "log_d").orderBy(F.xxhash64("id")), 100).select("id")


@query("R8_first_messages", "SELECT event_type, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1")
def first_messages(spark, sf_dir):
    return ST.first_seen(table(spark, sf_dir, "events").select("event_type", "ts", F.col("event_id").alias("id")), "event_type").select("event_type", "id")


_STABLE = """WITH s AS (SELECT user_id AS path, ts, event_id // 200 AS size FROM events), r AS (SELECT *, CASE WHEN coalesce(lag(size) OVER (PARTITION BY path ORDER BY ts), -1) <> size THEN 1 ELSE 0 END AS n FROM s),
    k AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY ts) AS run FROM r), b AS (SELECT *, min(ts) OVER (PARTITION BY path, run) AS began FROM k) SELECT path, min(ts) AS ts FROM b WHERE epoch(ts) - epoch(began) >= 600 GROUP BY path"""


@query("R4_stable_files", _STABLE)
def stable(spark, sf_dir):
    return ST.stable_files(table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", F.expr("event_id div 200").alias("size")), 600)


# --- extensions: what Spark has and no caller of the reference behaviour expects -----------------------------------------


@query("EXT_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("EXT_time_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def time_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")

