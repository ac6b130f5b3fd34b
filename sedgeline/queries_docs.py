"""Queries over documents: metadata, search, retrieval, near copies, graph, journal, contacts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .functions import scalar as X
from .functions import text as TX
from .operators import contacts as C
from .operators import documents as DOC
from .operators import graph as G
from .operators import journal as J
from .operators import retrieval as R
from .operators import search as S
from .registry import base, query, table

NOW = dt.datetime(2025, 6, 1)
_FOLD = "translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
#: Words as the ranking index sees them, in SQL.
_WORDS = f"list_filter(string_split_regex({_FOLD.format('{0}')}, '[^a-z0-9]+'), lambda w: w <> '')"


@query("D1_docs_list", "SELECT doc_id, path, type FROM files_d WHERE type = 'invoice' AND status = 'open' AND CAST(document_date AS VARCHAR) LIKE '2024%' AND confidence BETWEEN 10 AND 90", ("files_d",))
def docs_list(spark, sf_dir):
    return DOC.docs_list(base(spark, sf_dir, "files_d"), kind="invoice", status="open", year=2024, confidence=(10, 90)).select("doc_id", "path", "type")


@query("D1_docs_due", "SELECT doc_id, due_date FROM files_d WHERE due_date < DATE '2025-03-01' AND person = 'src3'", ("files_d",))
def docs_due(spark, sf_dir):
    return DOC.docs_list(base(spark, sf_dir, "files_d"), person="src3", due_before="2025-03-01").select("doc_id", "due_date")


@query(
    "D2_docs_review",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN confidence < 40 THEN 'low_confidence' END, CASE WHEN type IS NULL THEN 'missing_type' END,
       CASE WHEN document_date IS NULL THEN 'missing_date' END], lambda r: r IS NOT NULL), ',') AS reasons FROM files_d
       WHERE (confidence < 40 OR type IS NULL OR document_date IS NULL) AND NOT review_ignored""",
    ("files_d",),
)
def docs_review(spark, sf_dir):
    return DOC.review(base(spark, sf_dir, "files_d"), 40).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("D3_timeline_docs", "SELECT doc_id FROM files_d WHERE document_date BETWEEN DATE '2024-06-01' AND DATE '2024-08-31' OR modified BETWEEN TIMESTAMP '2025-02-01' AND TIMESTAMP '2025-02-28'", ("files_d",))
def timeline_docs(spark, sf_dir):
    c = F.col("document_date").between("2024-06-01", "2024-08-31") | F.col("modified").between(F.expr("TIMESTAMP_NTZ'2025-02-01'"), F.expr("TIMESTAMP_NTZ'2025-02-28'"))
    return base(spark, sf_dir, "files_d").where(c).select("doc_id")


_TIMELINE = """SELECT DISTINCT ts, kind, action, path FROM (
    SELECT created AS ts, 'document' AS kind, 'created' AS action, path FROM files_d UNION ALL SELECT modified, 'document', 'modified', path FROM files_d
    UNION ALL SELECT date_trunc('day', ts), 'journal', event_type, CAST(user_id AS VARCHAR) FROM events)
    WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-03-20' ORDER BY ts, kind, action, path LIMIT 200"""


@query("D4_vault_timeline", _TIMELINE, ("files_d",))
def vault_timeline(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    docs = f.select(F.col("created").alias("ts"), F.lit("created").alias("action"), "path").unionByName(f.select(F.col("modified").alias("ts"), F.lit("modified").alias("action"), "path"))
    e = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("path"))
    return DOC.timeline({"document": docs, "journal": e}, dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 20), 200)


@query("D27_retention", "SELECT doc_id, document_date + INTERVAL 365 DAY AS expires FROM files_d WHERE type = 'invoice' AND list_has_all(tags, ['en']) AND document_date + INTERVAL 365 DAY <= TIMESTAMP '2025-06-01'", ("files_d",))
def retention(spark, sf_dir):
    return DOC.retention(base(spark, sf_dir, "files_d"), kind="invoice", tags=["en"], period_days=365, now=NOW).select("doc_id", F.col("expires").cast("timestamp_ntz").alias("expires"))


_RULES = [("the license", "category", "legal"), ("idiot", "category", "abuse"), ("licensed", "tags", "license"), ("released", "tags", "license"), ("and", "tags", "english"), ("token", "tags", "secret")]


@query(
    "D23_classify",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'the license') THEN 'legal' WHEN contains(lower(text), 'idiot') THEN 'abuse' END AS category,
       array_to_string(list_filter([CASE WHEN contains(lower(text), 'licensed') OR contains(lower(text), 'released') THEN 'license' END, CASE WHEN contains(lower(text), 'and') THEN 'english' END,
       CASE WHEN contains(lower(text), 'token') THEN 'secret' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents""",
)
def classify(spark, sf_dir):
    return DOC.classify(table(spark, sf_dir, "documents"), _RULES, F.col("text")).select("doc_id", "category", F.array_join("tags", ",").alias("tags"))


_PATTERNS = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "year": "\\b20[0-9][0-9]\\b", "license": "Licensed under [A-Za-z0-9 .,-]+"}


@query("D25_annotate", " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{f}' AS field, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for f, p in _PATTERNS.items()))
def annotate(spark, sf_dir):
    return DOC.annotate(table(spark, sf_dir, "documents"), "doc_id", "text", _PATTERNS)


# --- search -------------------------------------------------------------------------------------------------------------


def _bm25_sql(docs: str, id: str, text: str, terms: list[str], limit: str) -> str:
    tf = ", ".join(f"len(list_filter(ws, lambda w: w = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""WITH tok AS (SELECT {id} AS id, {_WORDS.format(text)} AS ws FROM {docs}), cnt AS (SELECT id, len(ws) AS dl, {tf} FROM tok),
        st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM cnt) SELECT id, round({score}, 6) AS score FROM cnt, st WHERE {hit} {limit}"""


@query("T6_bm25", _bm25_sql("documents", "doc_id", "text", ["the", "idiot"], ""))
def bm25(spark, sf_dir):
    return S.bm25(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), ["the", "idiot"]).select("id", F.round("score", 6).alias("score"))


@query("T18_top20", f"SELECT id AS path, score FROM ({_bm25_sql('files_d', 'path', 'concat_ws(chr(10), title, body)', ['that', 'worthless'], '')}) ORDER BY score DESC, path LIMIT 20", ("files_d",))
def search_top(spark, sf_dir):
    return S.search(base(spark, sf_dir, "files_d"), "that worthless", NOW).select("path", F.round("score", 6).alias("score"))


@query("T3_phrase", f"SELECT path FROM files_d WHERE contains(concat(' ', array_to_string({_WORDS.format('concat_ws(chr(10), title, body)')}, ' '), ' '), ' of the ') ORDER BY path LIMIT 20", ("files_d",))
def phrase(spark, sf_dir):
    return S.search(base(spark, sf_dir, "files_d"), '"of the"', NOW).select("path")


@query("T4_substring", f"SELECT doc_id FROM documents WHERE contains({_FOLD.format('text')}, 'thless')")
def substring(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(X.fold(F.col("text")).contains("thless")).select("doc_id")


@query(
    "T5_three_legs",
    f"""WITH raw AS ({_bm25_sql("documents", "doc_id", "text", ["idiot"], "")}), part AS (SELECT doc_id AS id, CAST(NULL AS DOUBLE) AS score FROM documents WHERE contains({_FOLD.format("text")}, 'idiot')),
    stem AS (SELECT doc_id AS id, CAST(NULL AS DOUBLE) AS score FROM documents WHERE len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: starts_with(regexp_replace(w, '^[^\\pL\\pN]+', ''), 'idiot'))) > 0)
    SELECT id, max(score) AS score FROM (SELECT * FROM raw UNION ALL SELECT * FROM part UNION ALL SELECT * FROM stem) GROUP BY id""",
)
def legs(spark, sf_dir):
    return S.three_legs(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "idiot").select("id", F.round("score", 6).alias("score"))


@query("T8_negation", f"SELECT path FROM files_d WHERE NOT contains(concat(' ', array_to_string({_WORDS.format('concat_ws(chr(10), title, body)')}, ' '), ' '), ' the ') ORDER BY path LIMIT 20", ("files_d",))
def negated(spark, sf_dir):
    return S.search(base(spark, sf_dir, "files_d"), "-the", NOW).select("path")


for _name, _q, _where in [
    ("T9_path", "path:en/src1,DE/src2", "contains(lower(path), 'en/src1') OR contains(lower(path), 'de/src2')"),
    ("T10_status_type", "status:OPEN type:invoice", "lower(status) = 'open' AND lower(type) = 'invoice'"),
    ("T10_index", "index:stale", "coalesce(index_status, 'indexed') = 'stale'"),
    ("T11_tag", "tag:DE -tag:src9", "list_contains(tags, 'de') AND NOT list_contains(tags, 'src9')"),
    ("T12_filename", "filename:12 filetype:txt", "contains(lower(regexp_extract(path, '[^/]*$')), '12') AND lower(regexp_extract(path, '[.]([^.]*)$', 1)) = 'txt'"),
    ("T13_dates", "created:2024-04-01..2024-04-30,2024-06-05 modified:2025-01-01..2025-12-31", "(created BETWEEN TIMESTAMP '2024-04-01' AND TIMESTAMP '2024-04-30 23:59:59.999999' OR created BETWEEN TIMESTAMP '2024-06-05' AND TIMESTAMP '2024-06-05 23:59:59.999999') AND modified BETWEEN TIMESTAMP '2025-01-01' AND TIMESTAMP '2025-12-31 23:59:59'"),
    ("T13_relative", "modified:last month", "modified BETWEEN TIMESTAMP '2025-05-02' AND TIMESTAMP '2025-06-01'"),
    ("T14_regex", "/[0-9]{3}[.][0-9]+[.]/ -/License/", "regexp_matches(concat(title, chr(10), body), '[0-9]{3}[.][0-9]+[.]') AND NOT regexp_matches(concat(title, chr(10), body), 'License')"),
]:

    def _run(spark, sf_dir, q=_q):
        return S.search(base(spark, sf_dir, "files_d"), q, NOW).select("path")

    query(_name, f"SELECT path FROM files_d WHERE {_where} ORDER BY path LIMIT 20", ("files_d",))(_run)


@query("T15_scope", "SELECT path FROM files_d WHERE (starts_with(path, 'notes/fr/') OR starts_with(path, 'notes/es/src2')) AND lower(status) = 'paid' ORDER BY path LIMIT 20", ("files_d",))
def scope(spark, sf_dir):
    return S.search(base(spark, sf_dir, "files_d"), "status:paid", NOW, scope=["notes/fr/", "notes/es/src2"]).select("path")


@query("T16_allow_list", "SELECT path FROM files_d WHERE path IN (SELECT path FROM files_d WHERE doc_id % 50 = 0)", ("files_d",))
def allow_list(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    return f.join(f.where("doc_id % 50 = 0").select("path"), "path", "left_semi").select("path")


@query("T17_syntax_fallback", f"SELECT id AS path FROM ({_bm25_sql('files_d', 'path', 'concat_ws(chr(10), title, body)', ['that', 'the'], '')}) ORDER BY score DESC, path LIMIT 20", ("files_d",))
def fallback(spark, sf_dir):
    return S.search(base(spark, sf_dir, "files_d"), "that:the", NOW).select("path")


_SNIP = f"coalesce(nullif(strpos({_FOLD.format('text')}, 'moron'), 0), 1)"


@query("T7_snippet", f"SELECT doc_id, substring(text, greatest(1, {_SNIP} - 150), 300) AS s FROM documents WHERE contains({_FOLD.format('text')}, 'moron')")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(X.fold(F.col("text")).contains("moron")).select("doc_id", S.snippet(F.col("text"), ["moron"]).alias("s"))


_EXACT = "CASE WHEN list_contains({0}, 'the') THEN {1} WHEN len(list_filter({0}, lambda w: starts_with(w, 'the'))) > 0 THEN 0.6 * {1} ELSE 0 END"


@query(
    "T21_weighted_search",
    f"""WITH w AS (SELECT doc_id, modified, {_WORDS.format("title")} AS a, {_WORDS.format("body")} AS b FROM files_d), s AS (SELECT doc_id, modified, {_EXACT.format("a", "6.0")} + {_EXACT.format("b", "1.0")} AS p FROM w)
    SELECT doc_id, round(p + 1.5 * power(0.5, greatest(0, date_diff('second', modified, TIMESTAMP '2025-06-01') / 86400.0) / 30), 6) AS score FROM s WHERE p > 0""",
    ("files_d",),
)
def weighted(spark, sf_dir):
    return S.weighted_search(base(spark, sf_dir, "files_d"), {"title": 6.0, "body": 1.0}, "the", "doc_id", NOW, "modified").select("doc_id", F.round("score", 6).alias("score"))


@query("T22_facets", "SELECT facet, min(value) AS value, count(*) AS count FROM (SELECT 'status' AS facet, status AS value FROM files_d UNION ALL SELECT 'type', type FROM files_d UNION ALL SELECT 'person', person FROM files_d) WHERE coalesce(value, '') <> '' GROUP BY facet, lower(value)", ("files_d",))
def facets(spark, sf_dir):
    return S.facets(base(spark, sf_dir, "files_d"), ["status", "type", "person"])


@query("X16_wikilinks", "SELECT doc_id, concat('n', doc_id, ';Beta note') AS links FROM documents WHERE text IS NOT NULL")
def wikilinks(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    md = F.concat(F.lit("see [[n"), n, F.lit("|a]] and [[ Beta note#part ]] `[[code]]`\n```\n[[fenced]]\n```\n"), F.regexp_replace("text", r"[\[\]`#|()]", ""), F.lit(" [[n"), n, F.lit("]]"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(TX.wikilinks(md), ";").alias("links"))


_SIGNALS = ", ".join(f"'{w}'" for w in X.GERMAN), ", ".join(f"'{w}'" for w in X.ENGLISH)


@query(
    "X14_language",
    rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}]+') AS ws FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda w: w IN ({_SIGNALS[0]}))) + CASE WHEN regexp_matches(text, '[äöüßÄÖÜ]') THEN 3 ELSE 0 END AS d, len(list_filter(ws, lambda w: w IN ({_SIGNALS[1]}))) AS e FROM w)
    SELECT doc_id, CASE WHEN n < 20 THEN '' WHEN d >= e * 1.5 THEN CASE WHEN d >= 3 THEN 'deu' ELSE '' END WHEN e >= d * 1.5 THEN CASE WHEN e >= 3 THEN 'eng' ELSE '' END ELSE '' END AS lang FROM c""".replace("\\\\p", "\\p"),
)
def languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.language(F.col("text")).alias("lang"))


@query("X12_german_tokens", "SELECT 1 AS n, 'rechnung gepruft' AS t, 'grosser uberweisung' AS u")
def german(spark, sf_dir):
    return spark.range(1, 2).select(F.col("id").cast("int").alias("n"), F.array_join(TX.german_tokens(F.lit("Die Rechnungen sind geprüft")), " ").alias("t"), F.array_join(TX.german_tokens(F.lit("größere Überweisungen")), " ").alias("u"))


# --- retrieval ----------------------------------------------------------------------------------------------------------

QUERY_VECTOR = [((i * 37) % 19 - 9) / 10.0 for i in range(64)]


def _dim(spark, sf_dir):
    return len(table(spark, sf_dir, "embeddings").select("embedding").first()[0])


_QV = "list_transform(range(len(embedding)), lambda i: ((i * 37) % 19 - 9) / 10.0)"
_COS = f"list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_QV} AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST({_QV} AS DOUBLE[]), CAST({_QV} AS DOUBLE[]))))"


@query("D16_vector_search", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 15")
def vectors(spark, sf_dir):
    q = [((i * 37) % 19 - 9) / 10.0 for i in range(_dim(spark, sf_dir))]
    return R.vector_search(table(spark, sf_dir, "embeddings"), q, 15).select("vec_id", F.round("score", 6).alias("score"))


_HAM = f"list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST((embedding[i] >= 0) <> ({_QV}[i] >= 0) AS INT)))"


@query("D17_hamming_shortlist", f"SELECT vec_id, round(c, 6) AS score FROM (SELECT vec_id, {_COS} AS c, {_HAM} AS h FROM embeddings ORDER BY h, vec_id LIMIT 40) ORDER BY c DESC, vec_id LIMIT 10")
def shortlist(spark, sf_dir):
    q = [((i * 37) % 19 - 9) / 10.0 for i in range(_dim(spark, sf_dir))]
    return R.shortlist_search(table(spark, sf_dir, "embeddings"), q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("X25_signature_distance", f"SELECT vec_id, CAST({_HAM} AS INT) AS h FROM embeddings")
def signatures(spark, sf_dir):
    q = [((i * 37) % 19 - 9) / 10.0 for i in range(_dim(spark, sf_dir))]
    return table(spark, sf_dir, "embeddings").select("vec_id", R.signature_distance(R.signature(F.col("embedding")), R.signature(R._literal(q))).alias("h"))


@query("D18_ivf_full_probe", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def ivf(spark, sf_dir):
    q = [((i * 37) % 19 - 9) / 10.0 for i in range(_dim(spark, sf_dir))]
    index = R.IvfIndex(table(spark, sf_dir, "embeddings"))
    return index.search(q, 10, probes=index.cells).select("vec_id", F.round("score", 6).alias("score"))


@query("D18_ivf_search")
def ivf_probes(spark, sf_dir):
    q = [((i * 37) % 19 - 9) / 10.0 for i in range(_dim(spark, sf_dir))]
    return R.IvfIndex(table(spark, sf_dir, "embeddings")).search(q, 10)


_LEX = _bm25_sql("documents", "doc_id", "text", ["the", "of"], "")


@query(
    "D19_hybrid",
    f"""WITH lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_LEX}) ORDER BY rank LIMIT 50),
    sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 50)
    SELECT id, round(coalesce(1.0 / (60 + lex.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0), 6) AS score FROM lex FULL JOIN sem USING (id) ORDER BY coalesce(1.0 / (60 + lex.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0) DESC, id LIMIT 12""",
)
def hybrid(spark, sf_dir):
    q = [((i * 37) % 19 - 9) / 10.0 for i in range(_dim(spark, sf_dir))]
    lex = R.top_ranked(S.bm25(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), ["the", "of"]).withColumn("score", F.round("score", 6)), "id", 50)
    sem = R.top_ranked(R.vector_search(table(spark, sf_dir, "embeddings"), q, 50), "vec_id", 50)
    return R.fuse(lex, sem, 12).select("id", F.round("score", 6).alias("score"))


@query("D13_chunks")
def chunks(spark, sf_dir):
    return R.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "J11_extraction_chunk",
    """WITH c AS (SELECT doc_id AS doc, i AS chunk_index, i * 300 AS cs, i * 300 + 250 AS ce FROM documents, unnest(range(0, 4)) AS t(i)), e AS (SELECT doc_id AS doc, doc_id % 3 AS extraction, (doc_id * 41) % 1300 AS s, (doc_id * 41) % 1300 + 20 AS f FROM documents),
    d AS (SELECT e.doc, extraction, chunk_index, CASE WHEN cs <= (s + f) / 2 AND (s + f) / 2 < ce THEN 0 ELSE least(abs((s + f) / 2 - cs), abs((s + f) / 2 - ce)) END AS away FROM e JOIN c USING (doc))
    SELECT doc, extraction, chunk_index FROM d QUALIFY row_number() OVER (PARTITION BY doc, extraction ORDER BY away, chunk_index) = 1""",
)
def attach(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    c = d.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("chunk_index")).withColumn("start", F.col("chunk_index") * 300).withColumn("end", F.col("start") + 250)
    e = d.select("doc", (F.col("doc") % 3).alias("extraction"), (F.col("doc") * 41 % 1300).alias("start"), (F.col("doc") * 41 % 1300 + 20).alias("end"))
    return R.attach(e, c)


# --- near copies by SimHash ---------------------------------------------------------------------------------------------


# --- graph --------------------------------------------------------------------------------------------------------------

_NODES = "nodes AS (SELECT concat('n/', n_name, '.md') AS path, concat('Title ', n_nationkey) AS title, [concat('alias', n_nationkey % 7)] AS aliases, n_nationkey AS k FROM nation)"
_EDGES = """edges AS (SELECT concat('n/', n_name, '.md') AS src, CASE n_nationkey % 5 WHEN 0 THEN concat('n/', n_name) WHEN 1 THEN concat('alias', n_nationkey % 9) WHEN 2 THEN concat('TITLE ', 24 - n_nationkey) WHEN 3 THEN 'nowhere'
    ELSE concat(upper(n_name), '.MD') END AS target FROM nation)"""
_FORMS = """forms AS (SELECT lower(path) AS form, 0 AS level, path FROM nodes UNION ALL SELECT regexp_replace(lower(path), '\\.md$', ''), 1, path FROM nodes UNION ALL SELECT regexp_extract(lower(path), '[^/]*$'), 2, path FROM nodes
    UNION ALL SELECT regexp_replace(regexp_extract(lower(path), '[^/]*$'), '\\.md$', ''), 3, path FROM nodes UNION ALL SELECT lower(title), 4, path FROM nodes UNION ALL SELECT lower(unnest(aliases)), 5, path FROM nodes),
    best AS (SELECT form, arg_min(path, (level, path)) AS dst FROM forms GROUP BY form)"""


def _vault(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    path = F.concat(F.lit("n/"), "n_name", F.lit(".md"))
    k = F.col("n_nationkey")
    nodes = n.select(path.alias("path"), F.concat(F.lit("Title "), k.cast("string")).alias("title"), F.array(F.concat(F.lit("alias"), (k % 7).cast("string"))).alias("aliases"))
    target = (
        F.when(k % 5 == 0, F.concat(F.lit("n/"), "n_name"))
        .when(k % 5 == 1, F.concat(F.lit("alias"), (k % 9).cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("TITLE "), (24 - k).cast("string")))
        .when(k % 5 == 3, "nowhere")
        .otherwise(F.concat(F.upper("n_name"), F.lit(".MD")))
    )
    return nodes, n.select(path.alias("src"), target.alias("target"))


@query("J14_resolve_links", f"WITH {_NODES}, {_EDGES}, {_FORMS} SELECT src, target, dst FROM edges LEFT JOIN best ON form = lower(target)")
def resolve(spark, sf_dir):
    nodes, edges = _vault(spark, sf_dir)
    return G.resolve(edges, nodes)


@query("D8_graph", f"WITH {_NODES}, {_EDGES}, {_FORMS} SELECT DISTINCT src AS source, dst AS target FROM edges JOIN best ON form = lower(target) WHERE src <> dst")
@query("U4_distinct_edges", f"WITH {_NODES}, {_EDGES}, {_FORMS} SELECT DISTINCT src AS source, dst AS target FROM edges JOIN best ON form = lower(target) WHERE src <> dst")
def graph(spark, sf_dir):
    nodes, edges = _vault(spark, sf_dir)
    return G.graph(edges, nodes)


@query("D7_backlinks", f"WITH {_NODES}, {_EDGES}, {_FORMS} SELECT DISTINCT src FROM edges WHERE lower(target) IN (SELECT form FROM forms WHERE path = (SELECT path FROM nodes WHERE k = 2))")
def backlinks(spark, sf_dir):
    nodes, edges = _vault(spark, sf_dir)
    path = table(spark, sf_dir, "nation").where("n_nationkey = 2").select(F.concat(F.lit("n/"), "n_name", F.lit(".md"))).first()[0]
    return G.backlinks(edges, nodes, path)


@query("J18_broken_links", f"WITH {_NODES}, {_EDGES}, {_FORMS} SELECT src, target FROM edges ANTI JOIN best ON form = lower(target)")
def broken(spark, sf_dir):
    nodes, edges = _vault(spark, sf_dir)
    return G.broken(edges, nodes)


@query("D9_inverse_relations", "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS path, key FROM (SELECT doc_id, 'person' AS key, person AS value FROM files_d UNION ALL SELECT doc_id, 'lang', lang FROM files_d) WHERE lower(value) = 'src4'", ("files_d",))
@query("J16_property_inverse", "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS path, key FROM (SELECT doc_id, 'person' AS key, person AS value FROM files_d UNION ALL SELECT doc_id, 'lang', lang FROM files_d) WHERE lower(value) = 'src4'", ("files_d",))
def inverse(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    pairs = F.explode(F.map_entries(F.create_map(F.lit("person"), "person", F.lit("lang"), "lang"))).alias("x")
    return G.inverse_relations(f.select(F.col("doc_id").cast("string").alias("path"), pairs).select("path", "x.key", "x.value"), "SRC4")


@query(
    "D10_related",
    """WITH ent(entity, name) AS (VALUES (1, 'idiot'), (2, 'moron'), (3, 'clown'), (4, 'pathetic')), men AS (SELECT DISTINCT path, entity FROM files_d JOIN ent ON contains(lower(concat(title, chr(10), body)), name)),
    near AS (SELECT DISTINCT entity FROM (SELECT entity FROM men WHERE path = (SELECT path FROM files_d WHERE doc_id = 28) UNION ALL SELECT 4 FROM men WHERE entity = 1 AND path = (SELECT path FROM files_d WHERE doc_id = 28) UNION ALL SELECT 1 FROM men WHERE entity = 4 AND path = (SELECT path FROM files_d WHERE doc_id = 28)))
    SELECT path, count(*) AS shared FROM men SEMI JOIN near USING (entity) WHERE path <> (SELECT path FROM files_d WHERE doc_id = 28) GROUP BY path""",
    ("files_d",),
)
def related(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    ent = spark.createDataFrame([(1, "Idiot"), (2, "moron"), (3, "clown"), (4, "pathetic")], "entity int, name string")
    return G.related(f, ent, spark.createDataFrame([(1, 4)], "a int, b int"), f.where("doc_id = 28").first()["path"])


@query(
    "J17_entity_mentions",
    "WITH ent(entity, name) AS (VALUES (1, 'idiot'), (2, 'moron')) SELECT DISTINCT path, entity FROM files_d JOIN ent ON contains(lower(concat(title, chr(10), body)), name)",
    ("files_d",),
)
def mentions(spark, sf_dir):
    ent = spark.createDataFrame([(1, "idiot"), (2, "moron")], "entity int, name string")
    return G.mentions(base(spark, sf_dir, "files_d"), ent, F.concat_ws("\n", "title", "body"))


@query("A11_rollup", "SELECT o_custkey AS src, count(*) AS n, round(sum(l_quantity), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def rollup(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return G.rollup(table(spark, sf_dir, "lineitem"), edges, "l_orderkey", "l_quantity").select("src", "n", "total")


# --- journal and intervals ----------------------------------------------------------------------------------------------


@query("D31_journal_merge", "SELECT id, lamport, author FROM log_d ORDER BY lamport, ts, author, seq, id LIMIT 300", ("log_d",))
def merge(spark, sf_dir):
    return J.merged(base(spark, sf_dir, "log_d"), 300).select("id", "lamport", "author")


_LINES = """lines AS (SELECT conv_id AS author, turn + 1 AS line_no, CASE WHEN conv_id % 10 = 3 AND turn = 2 THEN 2 ELSE turn + 1 END AS seq, md5(text) AS hash,
    CASE WHEN conv_id % 8 = 5 AND turn = 1 THEN 'x' ELSE coalesce(lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn), '') END AS prev FROM conversations)"""
_FIND = f"""WITH {_LINES}, s AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY line_no) AS place, lag(hash) OVER (PARTITION BY author ORDER BY line_no) AS before, count(*) OVER (PARTITION BY author, seq) AS times FROM lines)
    SELECT author, line_no, seq, 'seq_mismatch' AS finding FROM s WHERE seq <> place UNION ALL SELECT author, line_no, seq, 'chain_broken' FROM s WHERE prev <> coalesce(before, '') UNION ALL SELECT author, line_no, seq, 'fork_detected' FROM s WHERE times > 1"""


@query("D32_journal_verify", _FIND)
def verify(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "conversations")
    before = F.coalesce(F.lag(F.md5("text")).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    lines = d.select(
        F.col("conv_id").alias("author"), (F.col("turn") + 1).alias("line_no"), F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 2), 2).otherwise(F.col("turn") + 1).alias("seq"),
        F.md5("text").alias("hash"), F.when((F.col("conv_id") % 8 == 5) & (F.col("turn") == 1), "x").otherwise(before).alias("prev"),
    )
    return J.verify(lines)


@query("A16_journal_stats", "SELECT author, count(*) AS events, max(seq) AS last_seq, max(lamport) AS lamport FROM log_d GROUP BY author", ("log_d",))
def journal_stats(spark, sf_dir):
    return J.stats(base(spark, sf_dir, "log_d").withColumn("hash", F.col("id"))).select("author", "events", "last_seq", "lamport")


@query("D33_last_state", "SELECT author, id FROM log_d QUALIFY row_number() OVER (PARTITION BY author ORDER BY lamport DESC, ts DESC, author DESC, seq DESC, id DESC) = 1", ("log_d",))
def last_state(spark, sf_dir):
    return J.last_state(base(spark, sf_dir, "log_d"), "author").select("author", "id")


@query(
    "D34_members",
    """WITH e AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'member_added' WHEN 1 THEN 'role_changed' ELSE 'member_removed' END AS what, conv_id % 40 AS member, concat('role', CAST(turn AS VARCHAR)) AS r FROM log_d)
    SELECT member, r AS role FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY member ORDER BY lamport DESC, ts DESC, author DESC, seq DESC, id DESC) = 1) WHERE what <> 'member_removed'""",
    ("log_d",),
)
def members(spark, sf_dir):
    d = base(spark, sf_dir, "log_d")
    what = F.when(F.col("turn") % 3 == 0, "member_added").when(F.col("turn") % 3 == 1, "role_changed").otherwise("member_removed")
    return J.members(d.withColumn("kind", what).withColumn("member", F.col("conv_id") % 40).withColumn("role", F.concat(F.lit("role"), F.col("turn").cast("string"))))


@query("D46_journal_query", "SELECT id FROM log_d WHERE kind = 'user' AND lower(author) = 'a3' AND ts >= 300 AND id NOT IN (SELECT id FROM log_d WHERE conv_id % 6 = 0) ORDER BY lamport, ts, author, seq, id LIMIT 50", ("log_d",))
def journal_query(spark, sf_dir):
    d = base(spark, sf_dir, "log_d")
    return J.query_log(d, d.where("conv_id % 6 = 0"), kinds=["user"], author="A3", since=300).select("id")


@query(
    "J12_segment_speaker",
    """WITH seg AS (SELECT event_id AS id, event_id % 5 AS track, event_id * 70 AS s, event_id * 70 + 400 AS e FROM events), turn AS (SELECT concat('sp', user_id % 4) AS speaker, event_id % 5 AS track, event_id * 70 + 111 AS s, event_id * 70 + 111 + CAST(floor(value * 20) AS BIGINT) AS e FROM events),
    o AS (SELECT seg.id, seg.s, seg.e, speaker, sum(least(seg.e, turn.e) - greatest(seg.s, turn.s)) AS overlap FROM seg JOIN turn ON seg.track = turn.track AND turn.s < turn.e AND turn.s < seg.e AND seg.s < turn.e GROUP BY ALL),
    b AS (SELECT id, s, e, arg_min(speaker, (-overlap, speaker)) AS speaker, max(overlap) AS overlap, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers FROM o GROUP BY id, s, e)
    SELECT id, speaker, CAST(overlap AS BIGINT) AS overlap, speakers, round(overlap / (e - s), 6) AS confidence FROM b""",
)
def speakers(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    k = F.col("event_id")
    seg = d.select(k.alias("id"), (k % 5).alias("track"), (k * 70).alias("start"), (k * 70 + 400).alias("end"))
    end = k * 70 + 111 + F.floor(F.col("value") * 20)
    turn = d.select(F.concat(F.lit("sp"), (F.col("user_id") % 4).cast("string")).alias("speaker"), (k % 5).alias("track"), (k * 70 + 111).alias("start"), end.alias("end"))
    return J.overlap_join(seg, turn, 1000)


# --- contacts -----------------------------------------------------------------------------------------------------------


@query(
    "J20_contact_duplicates",
    """WITH known AS (SELECT c_custkey AS person, concat('src', c_custkey % 300) AS source, concat(lower(c_mktsegment), c_custkey % 500, '@x') AS email, concat('+', c_custkey % 700) AS phone, lower(c_name) AS name FROM customer WHERE c_custkey % 2 = 0),
    inc AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 3 = 0 THEN concat('src', c_custkey) END AS source, concat(lower(c_mktsegment), c_custkey, '@x') AS email, concat('+', c_custkey) AS phone, lower(c_name) AS name FROM customer WHERE c_custkey % 3 < 2),
    hit AS (SELECT row, person, 0 AS k, 'source' AS reason FROM inc JOIN known USING (source) UNION ALL SELECT row, person, 1, 'email' FROM inc JOIN known USING (email) UNION ALL SELECT row, person, 2, 'phone' FROM inc JOIN known USING (phone) UNION ALL SELECT row, person, 3, 'name' FROM inc JOIN known USING (name)),
    best AS (SELECT row, person, reason FROM hit QUALIFY row_number() OVER (PARTITION BY row ORDER BY k, person) = 1) SELECT inc.row, person, reason FROM inc LEFT JOIN best USING (row)""",
)
def contact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")

    def side(rows, key, source, n, m):
        return rows.select(k.alias(key), source.alias("source"), F.concat(F.lower("c_mktsegment"), n.cast("string"), F.lit("@x")).alias("email"), F.concat(F.lit("+"), m.cast("string")).alias("phone"), F.lower("c_name").alias("name"))

    known = side(d.where(k % 2 == 0), "person", F.concat(F.lit("src"), (k % 300).cast("string")), k % 500, k % 700)
    inc = side(d.where(k % 3 < 2), "row", F.when(k % 3 == 0, F.concat(F.lit("src"), k.cast("string"))), k, k)
    return C.import_plan(inc, known)


@query(
    "D38_contact_import",
    "WITH known AS (SELECT lower(c_name) AS name, min(c_custkey) AS person FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) SELECT c_custkey AS row, person, CASE WHEN person IS NULL THEN 'create' ELSE 'merge' END AS action FROM customer LEFT JOIN known ON known.name = lower(c_name)",
)
def contact_import(spark, sf_dir):
    d = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    known = d.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("person"), none.alias("source"), none.alias("email"), none.alias("phone"), F.lower("c_name").alias("name"))
    inc = d.select(F.col("c_custkey").alias("row"), none.alias("source"), none.alias("email"), none.alias("phone"), F.lower("c_name").alias("name"))
    return C.import_plan(inc, known).select("row", "person", F.when(F.col("person").isNull(), "create").otherwise("merge").alias("action"))


@query("U3_contact_timeline", "SELECT ts, kind, id FROM (SELECT o_orderdate AS ts, 'interaction' AS kind, o_orderkey AS id, o_custkey AS p FROM orders UNION ALL SELECT o_orderdate + INTERVAL 30 DAY, 'follow_up', o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0) WHERE p = 11 ORDER BY ts DESC, kind, id LIMIT 20")
def contact_timeline(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"))
    return C.contact_timeline(o, o.where("id % 2 = 0").withColumn("ts", F.expr("ts + INTERVAL 30 DAY")), 11, 20)


for _state, _where in [("open", "NOT done"), ("overdue", "NOT done AND due < DATE '1998-01-01'"), ("upcoming", "NOT done AND due >= DATE '1998-01-01'"), ("all", "TRUE")]:

    def _due(spark, sf_dir, state=_state):
        o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("due"), (F.col("o_orderstatus") == "F").alias("done"))
        return C.due(o, state, F.expr("DATE'1998-01-01'")).select("id")

    query(f"D37_follow_ups_{_state}", f"SELECT id FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS due, o_orderstatus = 'F' AS done FROM orders) WHERE {_where}")(_due)


@query("O8_name_page", "SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 51 OFFSET 50")
def contacts_page(spark, sf_dir):
    return C.page(table(spark, sf_dir, "customer"), "c_name", "c_custkey", 50, 50).select("c_custkey", "c_name")


@query("W3_last_interaction", "SELECT o_custkey AS person, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_interaction(spark, sf_dir):
    return C.last_interaction(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"))).select("person", "id")


@query("D47_next_number", "WITH u AS (SELECT DISTINCT o_orderkey AS n FROM orders WHERE o_orderkey > 0 AND o_orderkey % 97 <> 0) SELECT min(n) AS next FROM (SELECT n + 1 AS n FROM u UNION ALL SELECT 1) WHERE n NOT IN (SELECT n FROM u)")
def next_number(spark, sf_dir):
    return C.next_number(table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0"), "o_orderkey")


@query(
    "D30_prune_versions",
    """WITH v AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS version, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, version DESC) AS k FROM v)
    SELECT path, version FROM r WHERE k > 1 AND (k > 5 OR ts < TIMESTAMP '2024-01-10')""",
)
@query(
    "W5_newest_n",
    """WITH v AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS version, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, version DESC) AS k FROM v)
    SELECT path, version FROM r WHERE k > 1 AND (k > 5 OR ts < TIMESTAMP '2024-01-10')""",
)
def prune(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("version"), "ts")
    return DOC.pruned_versions(v, 5, dt.datetime(2024, 1, 10)).select("path", "version")
