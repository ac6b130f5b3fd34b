"""Queries over state that follows from logs, over imports, over the search index, and over near copies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .functions import text as TX
from .operators import copies as C
from .operators import documents as DOC
from .operators import index as IX
from .operators import retrieval as R
from .operators import search as S
from .queries_docs import _bm25_sql
from .queries_files import workspace
from .registry import base, query, table

NOW = dt.datetime(2025, 6, 1)

# --- near copies by SimHash ---------------------------------------------------------------------------------------------

_FNV64 = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::HUGEINT)), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616)"
_FNV32 = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::HUGEINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296)"
_SIM = rf"""toks AS (SELECT doc_id, unnest(regexp_split_to_array(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), ' ')) AS w FROM documents),
    fnv AS (SELECT w, {_FNV64} AS h FROM (SELECT DISTINCT w FROM toks WHERE w <> '')),
    bits AS (SELECT doc_id, i, count(*) AS n, sum((h // (1::HUGEINT << i)) % 2) AS s FROM toks JOIN fnv USING (w), unnest(range(0, 64)) AS t(i) GROUP BY doc_id, i),
    sums AS (SELECT doc_id, sum(CASE WHEN 2 * s > n THEN 1::HUGEINT << i::INT ELSE 0 END)::HUGEINT AS u FROM bits GROUP BY doc_id),
    sim AS (SELECT d.doc_id, CAST(CASE WHEN coalesce(u, 0) >= 9223372036854775808 THEN u - 18446744073709551616 ELSE coalesce(u, 0) END AS BIGINT) AS h,
        length(trim(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))) AS n FROM documents d LEFT JOIN sums USING (doc_id))"""
_PERCENT = "(64 - CAST(bit_count(xor(a.h, b.h)) AS INT)) * 100 // 64"


@query("X21_fnv", f"SELECT p_partkey, CAST(({_FNV64.replace('(w)', '(p_name)')}) // 4294967296 AS BIGINT) AS high, CAST({_FNV32.replace('(w)', '(p_name)')} AS BIGINT) AS h32 FROM part")
def fnv(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.shiftrightunsigned(TX.fnv64("p_name"), 32).alias("high"), TX.fnv32("p_name").alias("h32"))


@query("X22_simhash", f"WITH {_SIM} SELECT doc_id, h AS simhash FROM sim")
def simhashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", TX.simhash("text").alias("simhash"))


@query("D5_similar_docs", f"WITH {_SIM} SELECT b.doc_id AS id, CAST({_PERCENT} AS INT) AS similarity FROM sim a JOIN sim b ON a.doc_id = 7 AND a.h <> b.h WHERE {_PERCENT} >= 70")
def similar_docs(spark, sf_dir):
    prints = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), TX.simhash("text").alias("simhash"))
    return C.similar_to(prints, prints.where("id = 7").first()["simhash"], 70).select("id", "similarity")


_LINKS = f"""{_SIM}, links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sim a JOIN sim b ON a.doc_id <> b.doc_id WHERE {_PERCENT} >= 85),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    class AS (SELECT a AS id, min(b) AS class FROM reach GROUP BY a)"""


@query("J13_simhash_links", f"WITH RECURSIVE {_LINKS} SELECT id, class, coalesce(n_links, 0) AS n_links FROM class LEFT JOIN (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a) USING (id)")
def simhash_links(spark, sf_dir):
    return C.links(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), TX.simhash("text").alias("simhash")), 85)


_LONG = _LINKS.replace("FROM sim a JOIN sim b ON a.doc_id <> b.doc_id", "FROM sim a JOIN sim b ON a.doc_id <> b.doc_id AND a.n >= 64 AND b.n >= 64")


@query(
    "D6_similar_all",
    f"WITH RECURSIVE {_LONG} SELECT class AS representative, id, CAST({_PERCENT} AS INT) AS similarity FROM class JOIN sim a ON a.doc_id = class JOIN sim b ON b.doc_id = id WHERE id <> class",
)
def similar_all(spark, sf_dir):
    return C.clusters(C.prints(table(spark, sf_dir, "documents"), "doc_id", "text"), 85)


@query("A15_near_copy_groups", f"WITH RECURSIVE {_LONG} SELECT class AS representative, count(*) AS members FROM class WHERE id <> class GROUP BY class")
def near_groups(spark, sf_dir):
    return C.clusters(C.prints(table(spark, sf_dir, "documents"), "doc_id", "text"), 85).groupBy("representative").agg(F.count("*").alias("members"))


# --- sections, chunks, local vectors ------------------------------------------------------------------------------------

_MD = "concat('# Top', chr(10), replace(text, '#', ''), chr(10), '## Sub ', chr(10), 'end  ')"
_TRIM = r"regexp_replace(replace(text, '#', ''), '\s+$', '', 'g')"


@query(
    "D12_sections",
    f"""SELECT doc_id AS id, 0 AS section, 'Top' AS heading, CAST(0 AS BIGINT) AS start, strlen(concat('# Top', CASE WHEN t <> '' THEN concat(chr(10), t) ELSE '' END)) AS size FROM (SELECT doc_id, {_TRIM} AS t FROM documents WHERE text IS NOT NULL)
    UNION ALL SELECT doc_id, 1, 'Top > Sub', strlen(replace(text, '#', '')) + 7, 11 FROM documents WHERE text IS NOT NULL""",
)
def sections(spark, sf_dir):
    md = F.concat(F.lit("# Top\n"), F.replace("text", F.lit("#"), F.lit("")), F.lit("\n## Sub \nend  "))
    return R.sections(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", md.alias("t")), "doc_id", "t")


@query("W6_heading_paths", "SELECT n_nationkey AS id, path FROM nation, (VALUES ('A'), ('A > B'), ('A > B > C'), ('A > D'), ('E')) AS p(path)")
def heading_paths(spark, sf_dir):
    md = F.concat(F.lit("before\n# A\n## B\n### C\n"), "n_name", F.lit("\n## D\n# E\n#no heading\n####### none"))
    return R.sections(table(spark, sf_dir, "nation").select("n_nationkey", md.alias("t")), "n_nationkey", "t").where("heading <> ''").select("id", F.col("heading").alias("path"))


_LETTERS = "SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM documents"
_WINDOWS = f"""SELECT doc_id, k, substr(t, 1 + 800 * k, 1000) AS c FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 1000 THEN 1 ELSE CAST(ceil((length(t) - 200) / 800.0) AS BIGINT) END)) AS k FROM ({_LETTERS}) WHERE t <> '')"""
_UUID = "sha1(unhex('2340d12a656a5d01971a40586ee613a6') || encode(CAST(doc_id AS VARCHAR)) || '\\x00'::BLOB || encode(sha256(c)) || '\\x00'::BLOB || encode(CAST(800 * k AS VARCHAR)))"


def _letters(spark, sf_dir):
    return R.chunks(table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("t")), "doc_id", "t")


@query("D13_chunk_windows", f"SELECT doc_id AS id, CAST(k AS INT) AS chunk_index, c AS content, 800 * k AS start, 800 * k + length(c) AS \"end\", concat('offset:', 800 * k) AS heading FROM ({_WINDOWS})")
def chunk_windows(spark, sf_dir):
    return _letters(spark, sf_dir).select("id", "chunk_index", "content", "start", "end", "heading")


@query(
    "X32_chunk_uuids",
    f"""SELECT id, chunk_index, concat(substr(s, 1, 8), '-', substr(s, 9, 4), '-5', substr(s, 14, 3), '-', substr('89ab', 1 + CAST(concat('0x', substr(s, 17, 1)) AS INT) % 4, 1), substr(s, 18, 3), '-', substr(s, 21, 12)) AS chunk_id
    FROM (SELECT doc_id AS id, CAST(k AS INT) AS chunk_index, {_UUID} AS s FROM ({_WINDOWS}))""",
)
def chunk_uuids(spark, sf_dir):
    return _letters(spark, sf_dir).select("id", "chunk_index", "chunk_id")


@query("X32_chunk_ids")
def chunk_ids(spark, sf_dir):
    return R.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("chunk_id", "start")


_STOP = ", ".join(f"'{w}'" for w in sorted(R.LOCAL_STOP_WORDS))


@query(
    "X26_local_embedding",
    rf"""WITH toks AS (SELECT DISTINCT p_partkey, unnest(string_split(trim(regexp_replace(lower(concat(p_name, ' the und ', p_type)), '[.,!?;:\-_()\[\]{{}}\s]+', ' ', 'g')), ' ')) AS w FROM part)
    SELECT p_partkey, count(DISTINCT {_FNV32} % 768) AS used, CAST(sum(DISTINCT {_FNV32} % 768) AS BIGINT) AS places FROM toks WHERE w NOT IN ({_STOP}) GROUP BY p_partkey""",
)
def local_embedding(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", R.embed_locally(F.concat("p_name", F.lit(" the und "), "p_type")).alias("v"))
    at = F.filter(F.transform("v", lambda x, i: F.when(x != 0, i)), lambda x: x.isNotNull())
    return v.select("p_partkey", at.alias("at")).select("p_partkey", F.size("at").cast("long").alias("used"), F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x).alias("places"))


@query("D22_embedding_fallback", "SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'local-hash' ELSE 'model' END AS model, vec_id IS NULL AS pending FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def embedding_fallback(spark, sf_dir):
    given = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(given, "doc_id", "left")
    return IX.embedded(d, "text", F.col("embedding")).select("doc_id", "model", "pending")


@query("D55_pending_reembedding", "SELECT doc_id, false AS pending FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def reembedding(spark, sf_dir):
    pending = embedding_fallback(spark, sf_dir).where("pending").select("doc_id")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(pending, "doc_id", "left_semi")
    return IX.embedded(texts, "text", R.embed_locally("text")).select("doc_id", "pending")


# --- search -------------------------------------------------------------------------------------------------------------

_ALL = """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS id,
    list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))) AS score FROM q, embeddings e)
    SELECT query, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10"""


@query("D16_vector_search_all", _ALL)
def vector_search_all(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return R.vector_search_all(e, e.where("vec_id % 50 = 0"), 10).withColumn("score", F.round("score", 6))


_BM = _bm25_sql("files_d", "path", "concat_ws(chr(10), title, body)", ["moron"], "")


@query("T18_indexed_search", f"SELECT id, score FROM ({_BM}) ORDER BY score DESC, id LIMIT 20", ("files_d",))
def indexed_search(spark, sf_dir):
    return _index(spark, sf_dir).search("Moron", 20).withColumn("score", F.round("score", 6))


@query("T18_indexed_again", f"SELECT id, score FROM ({_bm25_sql('files_d', 'path', 'concat_ws(chr(10), title, body)', ['idiot'], '')}) ORDER BY score DESC, id LIMIT 20", ("files_d",))
def indexed_again(spark, sf_dir):
    """A further search of the same index."""
    return _index(spark, sf_dir).search("idiot", 20).withColumn("score", F.round("score", 6))


_indexes: dict[tuple[str, str], IX.SearchIndex] = {}


def _index(spark, sf_dir) -> IX.SearchIndex:
    """The index of a session's files, built when first asked for."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        _indexes[key] = IX.SearchIndex.build(base(spark, sf_dir, "files_d"), "path", F.concat_ws("\n", "title", "body"), workspace(spark))
    return _indexes[key]


@query("W1_rank", f"SELECT id AS path, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_BM}) ORDER BY rank LIMIT 30", ("files_d",))
def rank(spark, sf_dir):
    hits = S.bm25(base(spark, sf_dir, "files_d"), "path", F.concat_ws("\n", "title", "body"), ["moron"]).withColumn("score", F.round("score", 6))
    return R.top_ranked(hits, "id", 30).select(F.col("id").alias("path"), F.col("rank").cast("long").alias("rank"))


@query("O7_fused_order", "SELECT id, round(coalesce(1.0 / (60 + a), 0) + coalesce(1.0 / (60 + b), 0), 9) AS score FROM (SELECT o_orderkey AS id, o_orderkey AS a FROM orders WHERE o_orderkey < 200) FULL JOIN (SELECT o_orderkey AS id, 300 - o_orderkey AS b FROM orders WHERE o_orderkey BETWEEN 100 AND 299) USING (id) ORDER BY 2 DESC, 1 LIMIT 25")
def fused_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    a, b = o.where("id < 200").withColumn("rank", F.col("id")), o.where("id between 100 and 299").withColumn("rank", 300 - F.col("id"))
    return R.fuse(a, b, 25).select("id", F.round("score", 9).alias("score"))


_PARSED = [("plain words", 0, 2, 0, 0, ""), ('-draft "a \\"b\\""', 0, 2, 0, 1, ""), ("/ab+c/ -/x/", 0, 0, 2, 0, ""), ("tag:a,b path:notes -status:open w", 3, 1, 0, 0, ""), ("nope:x", 0, 0, 0, 0, 'unknown search operator "nope:"'), ('"open', 0, 0, 0, 0, "unterminated quoted phrase at offset 0"), ("- x", 0, 0, 0, 0, "negation must be followed by a term"), ("tag:", 0, 0, 0, 0, 'operator "tag:" requires a value'), ("created:last week", 1, 0, 0, 0, "")]


def _quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


@query("T1_parse", f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in _PARSED)}) AS t(query, filters, terms, regexes, negated, error)")
def parsed(spark, sf_dir):
    rows = []
    for q, *_ in _PARSED:
        try:
            p, error = S.parse(q), ""
        except S.SearchError as e:
            p, error = S.Plan(), str(e)
        rows.append((q, len(p.filters), len(p.terms), len(p.regexes), sum(t.negated for t in p.terms), error))
    return spark.createDataFrame(rows, "query string, filters int, terms int, regexes int, negated int, error string")


@query("D20_route", "SELECT * FROM (VALUES ('plain words', 'fused'), ('', 'lexical'), ('-draft x', 'lexical'), ('\"a b\"', 'lexical'), ('tag:a x', 'lexical'), ('/a/', 'lexical'), ('nope:x', 'lexical')) AS t(query, route)")
def routes(spark, sf_dir):
    return spark.createDataFrame([(q, IX.route(q)) for q in ("plain words", "", "-draft x", '"a b"', "tag:a x", "/a/", "nope:x")], "query string, route string")


_VEC = "list_transform(range(len(embedding)), lambda i: ((i * 37) % 19 - 9) / 10.0)"
_VCOS = f"list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_VEC} AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST({_VEC} AS DOUBLE[]), CAST({_VEC} AS DOUBLE[]))))"


@query(
    "D20_hybrid_search",
    f"""WITH lex AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT id, score AS s FROM ({_BM})) ORDER BY r LIMIT 20),
    v AS (SELECT path, {_VCOS} AS s FROM embeddings JOIN files_d ON doc_id = vec_id), sem AS (SELECT path AS id, row_number() OVER (ORDER BY s DESC, path) AS r FROM v ORDER BY r LIMIT 20)
    SELECT id AS path, round(coalesce(1.0 / (60 + lex.r), 0) + coalesce(1.0 / (60 + sem.r), 0), 6) AS score FROM lex FULL JOIN sem USING (id) ORDER BY coalesce(1.0 / (60 + lex.r), 0) + coalesce(1.0 / (60 + sem.r), 0) DESC, id LIMIT 20""",
    ("files_d",),
)
def hybrid_search(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    v = table(spark, sf_dir, "embeddings").join(f.select(F.col("doc_id").alias("vec_id"), "path"), "vec_id").select("path", "embedding")
    n = len(v.select("embedding").first()[0])
    found = IX.hybrid(f, v, "moron", [((i * 37) % 19 - 9) / 10.0 for i in range(n)], reference=NOW, id="path")
    return found.withColumn("score", F.round("score", 6))


@query("D57_grounding", "SELECT path, 'lexical' AS route FROM files_d WHERE list_contains(tags, 'de') AND regexp_matches(body, '[0-9]{4}') ORDER BY path LIMIT 20", ("files_d",))
def grounding(spark, sf_dir):
    found = IX.hybrid(base(spark, sf_dir, "files_d"), spark.createDataFrame([], "vec_id string, embedding array<float>"), "tag:de /[0-9]{4}/", [1.0], reference=NOW)
    return found.select("path", F.lit(IX.route("tag:de /[0-9]{4}/")).alias("route"))


@query("D21_expanded_query", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s FROM embeddings WHERE vec_id = 3")
def expanded_query(spark, sf_dir):
    v = [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 3").first()["embedding"]]
    mean = IX.expanded([2 * x for x in v], [[0.0] * len(v), [1.0]])
    return spark.createDataFrame([(3, round(sum(mean), 4))], "vec_id long, s double")


_BOOK = r"""WITH n AS (SELECT path, concat_ws(chr(10), title, body) AS t, body FROM files_d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), h AS (SELECT *, regexp_matches(lower(t), '(^|[^a-z0-9])idiot($|[^a-z0-9])') AS hit FROM n)
    SELECT path, CASE WHEN hit THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN NOT hit THEN strlen(body) END AS bytes FROM h WHERE strlen(body) <= 1500 OR hit
    UNION ALL SELECT path, 0.0, 1500 FROM h WHERE strlen(body) > 1500 AND NOT hit"""


@query("T20_notebook_search", _BOOK, ("files_d",))
def notebook(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    sources = f.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("path")
    found = IX.notebook_search(f, sources, "Idiot")
    # a character cut in two decodes to one of three bytes
    return found.select("path", "score", F.when(F.col("snippet").isNotNull(), F.least(F.octet_length("snippet"), F.lit(1500))).cast("long").alias("bytes"))


@query("D56_index_build", f"SELECT doc_id AS id, count(*) AS chunks, true AS pending FROM ({_WINDOWS}) GROUP BY doc_id")
def index_build(spark, sf_dir):
    """Chunks of every text, each with its local vector, to be embedded again when a model is at hand."""
    found = IX.embedded(_letters(spark, sf_dir).select("id", "content"), "content")
    return found.where((F.col("model") == "local-hash") & (F.size("vector") == 768)).groupBy("id").agg(F.count("*").alias("chunks"), F.bool_and("pending").alias("pending"))


@query("T2_all_terms", "SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9àáâãäåçèéêëìíîïñòóôõöùúûüýÿ])the($|[^a-z0-9àáâãäåçèéêëìíîïñòóôõöùúûüýÿ])') AND regexp_matches(lower(text), '(^|[^a-z0-9àáâãäåçèéêëìíîïñòóôõöùúûüýÿ])was($|[^a-z0-9àáâãäåçèéêëìíîïñòóôõöùúûüýÿ])')")
def all_terms(spark, sf_dir):
    return S.bm25(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), ["the", "was"]).select("id")


@query("T19_centred_snippet", "SELECT doc_id, substring(text, greatest(1, least(coalesce(nullif(strpos(t, 'idiot'), 0), 1000000000), coalesce(nullif(strpos(t, 'moron'), 0), 1000000000)) - 40), 80) AS s FROM (SELECT doc_id, text, lower(text) AS t FROM documents WHERE lang = 'en') WHERE contains(t, 'idiot') OR contains(t, 'moron')")
def centred_snippet(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    return d.where(F.lower("text").rlike("idiot|moron")).select("doc_id", S.snippet(F.col("text"), ["idiot", "moron"], 80).alias("s"))


_SIGNS = "list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END)"


@query("O5_top_k", f"SELECT vec_id, round(list_dot_product({_SIGNS}::DOUBLE[], {_VEC}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY round(list_dot_product({_SIGNS}::DOUBLE[], {_VEC}::DOUBLE[]), 6) DESC, vec_id LIMIT 40")
def top_k(spark, sf_dir):
    """Many equal scores: ties go to the smaller id."""
    e = table(spark, sf_dir, "embeddings")
    n = len(e.select("embedding").first()[0])
    q = [((i * 37) % 19 - 9) / 10.0 for i in range(n)]
    signs = e.select("vec_id", F.transform("embedding", lambda x: F.when(x >= 0, 1.0).otherwise(-1.0)).alias("embedding"))
    length = (n * sum(x * x for x in q)) ** 0.5
    best = R.vector_search(signs, q, 2 * e.count())
    return best.select("vec_id", F.round(F.col("score") * length, 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(40)


@query("X24_cosine", f"SELECT vec_id, round({_VCOS}, 6) AS score FROM embeddings UNION ALL SELECT -1, 0.0")
def cosines(spark, sf_dir):
    """Of every vector, and 0 of one without length."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = len(e.select("embedding").first()[0])
    zero = spark.createDataFrame([(-1, [0.0] * n)], e.schema)
    q = R._literal([((i * 37) % 19 - 9) / 10.0 for i in range(n)])
    return e.unionByName(zero).select("vec_id", F.round(R.cosine(F.col("embedding"), q), 6).alias("score"))


_ABS = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x) + 0.1)"
_ABS_COS = f"list_dot_product({_ABS}, {_VEC}::DOUBLE[]) / (sqrt(list_dot_product({_ABS}, {_ABS})) * sqrt(list_dot_product({_VEC}::DOUBLE[], {_VEC}::DOUBLE[])))"


@query("O6_shortlist_skipped", f"SELECT vec_id, round({_ABS_COS}, 6) AS score FROM embeddings ORDER BY {_ABS_COS} DESC, vec_id LIMIT 12")
def shortlist_skipped(spark, sf_dir):
    """All signatures are equally far, so no shortlist is taken."""
    e = table(spark, sf_dir, "embeddings")
    n = len(e.select("embedding").first()[0])
    v = e.select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.1).alias("embedding"))
    return R.shortlist_search(v, [((i * 37) % 19 - 9) / 10.0 for i in range(n)], 12).select("vec_id", F.round("score", 6).alias("score"))


@query("J21_rank_merge", "SELECT id, CAST(ra AS BIGINT) AS ra, CAST(rb AS BIGINT) AS rb FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ra FROM orders ORDER BY ra LIMIT 60) FULL JOIN (SELECT o_orderkey AS id, row_number() OVER (ORDER BY -o_custkey DESC, o_orderkey) AS rb FROM orders ORDER BY rb LIMIT 60) USING (id)")
def rank_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = R.top_ranked(o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), "id", 60)
    b = R.top_ranked(o.select(F.col("o_orderkey").alias("id"), (-F.col("o_custkey")).alias("score")), "id", 60)
    return R.fuse(a, b, 1000).select("id", F.col("ra").cast("long").alias("ra"), F.col("rb").cast("long").alias("rb"))


@query("U2_timeline_union", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT ts, kind, action, path FROM (SELECT created AS ts, 'document' AS kind, 'created' AS action, path FROM files_d UNION ALL SELECT o_orderdate, 'contact', o_orderstatus, CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT ts, 'journal', event_type, CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT document_date, 'dated', coalesce(type, ''), path FROM files_d UNION ALL SELECT l_shipdate, 'meeting', l_linestatus, CAST(l_suppkey AS VARCHAR) FROM lineitem) WHERE ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2024-06-01') GROUP BY kind", ("files_d",))
def timeline_union(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    part = lambda d, ts, action, path: d.select(F.col(ts).cast("timestamp_ntz").alias("ts"), action.alias("action"), F.col(path).cast("string").alias("path"))
    parts = {
        "document": part(f, "created", F.lit("created"), "path"), "contact": part(table(spark, sf_dir, "orders"), "o_orderdate", F.col("o_orderstatus"), "o_custkey"), "journal": part(table(spark, sf_dir, "events"), "ts", F.col("event_type"), "user_id"),
        "dated": part(f, "document_date", F.coalesce("type", F.lit("")), "path"), "meeting": part(table(spark, sf_dir, "lineitem"), "l_shipdate", F.col("l_linestatus"), "l_suppkey"),
    }
    return DOC.timeline(parts, dt.datetime(1995, 1, 1), dt.datetime(2024, 6, 1), 2**31 - 1).groupBy("kind").agg(F.count("*").alias("n"))


@query("O12_timeline_order", "SELECT ts, action, path FROM (SELECT DISTINCT ts, event_type AS action, CAST(user_id AS VARCHAR) AS path FROM events) ORDER BY ts, action, path LIMIT 25")
def timeline_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("path"))
    return DOC.timeline({"journal": e}, dt.datetime(1990, 1, 1), dt.datetime(2100, 1, 1), 25).select("ts", "action", "path")


@query("J15_rollup_join", "SELECT o_custkey AS src, count(*) AS n, string_agg(CAST(o_shippriority AS VARCHAR), ', ' ORDER BY CAST(o_shippriority AS VARCHAR)) AS v FROM (SELECT o_custkey, o_orderkey % 10 AS o_shippriority FROM orders) GROUP BY o_custkey")
def rollup_list(spark, sf_dir):
    from .operators import graph as G

    o = table(spark, sf_dir, "orders")
    return G.rollup(o.select("o_orderkey", (F.col("o_orderkey") % 10).alias("v")), o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), "o_orderkey", "v").select("src", "n", F.col("values").alias("v"))


@query("O10_total_order", "SELECT id, row_number() OVER (ORDER BY lamport, ts, author, seq, id) AS place FROM log_d ORDER BY place LIMIT 150", ("log_d",))
def total_order(spark, sf_dir):
    from .operators import journal as J

    ordered = J.merged(base(spark, sf_dir, "log_d").orderBy(F.xxhash64("body")), 150)
    place = F.struct(*J.ORDER)
    rows = ordered.agg(F.sort_array(F.collect_list(F.struct(place.alias("o"), "id"))).alias("xs"))
    return rows.select(F.posexplode("xs").alias("i", "x")).select("x.id", (F.col("i") + 1).cast("long").alias("place"))


@query("W4_hash_chain", "SELECT conv_id AS author, turn AS line_no FROM conversations WHERE conv_id % 6 = 2 AND turn >= 1")
def hash_chain(spark, sf_dir):
    """Every line but the first of some authors names another hash than that of the line before."""
    from .operators import journal as J

    c = table(spark, sf_dir, "conversations")
    own = F.md5(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    before = F.when(F.col("turn") > 0, F.md5(F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))).otherwise("")
    lines = c.select(F.col("conv_id").alias("author"), F.col("turn").alias("line_no"), (F.col("turn") + 1).alias("seq"), own.alias("hash"), F.when((F.col("conv_id") % 6 == 2) & (F.col("turn") > 0), "x").otherwise(before).alias("prev"))
    return J.verify(lines).where("finding = 'chain_broken'").select("author", "line_no")


@query("D54_artifacts", "SELECT concat('f', user_id) AS artifact FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_id % 4 <> 0")
def artifacts(spark, sf_dir):
    """Artifacts that are linked after all events; an unlink takes one out."""
    from .operators import journal as J

    e = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("artifact"), F.col("event_id").alias("lamport"), "ts", F.col("event_type").alias("author"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 4 == 0, "artifact.unlinked").otherwise("artifact.linked").alias("kind"))
    return J.last_state(e, "artifact").where("kind = 'artifact.linked'").select("artifact")


@query("D36_contact_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') ORDER BY lower(c_name), c_custkey LIMIT 51")
def contact_search(spark, sf_dir):
    from .operators import contacts as CT

    return CT.page(table(spark, sf_dir, "customer").where(F.lower("c_name").contains("00001")), "c_name", "c_custkey", 50, 0).select("c_custkey", "c_name")
