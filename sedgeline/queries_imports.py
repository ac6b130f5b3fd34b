"""Queries over imported files and over logs: each calls the named operator on data of its shape, derived from the tables."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F

from .functions import text as TX
from .operators import documents as DOC
from .operators import health as H
from .operators import retrieval as R
from .operators import state as ST
from .plans import views as V
from .plans.spec import SpecError
from .queries_files import workspace
from .registry import base, query, table
from .shipping import ship
from .sources import files as SRC
from .sources import imports as I
from .sources import sinks as K
from .streaming import changes as CH

# --- files --------------------------------------------------------------------------------------------------------------


@query("S1_walk", "SELECT n_name AS line, 'notes' AS folder FROM nation WHERE n_regionkey < 3")
def walked(spark, sf_dir):
    folder = workspace(spark)
    n = table(spark, sf_dir, "nation")
    for name, rows in (("notes", n.where("n_regionkey < 3")), ("build", n), ("notes/vendor", n)):
        rows.select("n_name").coalesce(2).write.mode("append").text(f"{folder}/{name}")
    found = SRC.walk(spark, folder, "*.txt").select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"), F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder"))
    return found.where("line <> ''")


@query("S2_markdown", "SELECT concat('n', doc_id, '.md') AS path, concat('T: ', doc_id) AS title, array_to_string([lang, source], ',') AS tags, 'x' AS nested, CAST(length(text) AS BIGINT) AS size, '' AS error FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT concat('n', doc_id, '.md'), concat('n', doc_id), '', NULL, CAST(length(text) AS BIGINT), 'duplicate key title' FROM documents WHERE doc_id % 10 = 3")
def markdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    again = F.when(F.col("doc_id") % 10 == 3, "title: again\n").otherwise("")
    head = F.concat(F.lit('---\ntitle: "T: '), n, F.lit('"\n'), again, F.lit("tags:\n  - "), "lang", F.lit("\n  - "), "source", F.lit("\nmore:\n  deep: x\n---\n"))
    files = d.select(F.concat(F.lit("n"), n, F.lit(".md")).alias("path"), F.concat(head, "text").cast("binary").alias("content"))
    nested = F.get_json_object(F.col("frontmatter")["more"], "$.deep")
    return SRC.markdown(files).select("path", "title", F.array_join("tags", ",").alias("tags"), nested.alias("nested"), F.length("body").cast("long").alias("size"), "error")


@query("S4_lazy_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, o_orderkey % 5 = 0 AS malformed FROM orders")
def lazy_csv(spark, sf_dir):
    folder = workspace(spark)
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "more"))
    spark.range(1).select(F.lit("key,status").alias("l")).unionByName(o.select(line.alias("l"))).coalesce(1).write.text(folder)
    return SRC.read_csv(spark, folder, strict=False).select("key", "status", F.col("_malformed").isNotNull().alias("malformed"))


@query("S7_producer_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS identity, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 9 <> 0")
def producer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("id", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey").cast("string")).otherwise(""))
    line = lambda place, status: F.struct(F.lit(place).alias("place"), F.to_json(F.struct(F.col("id").alias("identity"), F.struct(status.alias("status")).alias("values"))).alias("value"))
    lines = o.select(F.explode(F.array(line(1, F.col("o_orderstatus")), line(2, F.when(F.col("o_orderkey") % 4 == 0, "new").otherwise(F.col("o_orderstatus"))))).alias("x")).select("x.*")
    folder = workspace(spark)
    I.producer_rows(lines, ["status"]).write.option("header", True).csv(folder)
    return SRC.read_csv(spark, folder)


@query("S11_source_registry", "SELECT concat('src/', user_id) AS path FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_id % 3 <> 0")
def source_registry(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("seq"), F.concat(F.lit("src/"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add").alias("action"))
    return I.registry(log).select("path")


@query("S11_source_scan", "SELECT page_id FROM pages WHERE page_id % 4 = 0 OR (page_id % 4 < 3 AND strlen(html) * 1000 <= 10485760)")
def source_scan(spark, sf_dir):
    ext = F.element_at(F.array(F.lit(".md"), F.lit(".py"), F.lit(".HTML"), F.lit(".png")), (F.col("page_id") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a/"), F.col("page_id").cast("string"), ext).alias("path"), (F.octet_length("html") * 1000).alias("length"))
    return I.source_files(files).select("page_id")


@query("S14_rtf_text", "SELECT n_name, concat(n_name, chr(10), 'ä', chr(9), 'é') AS text FROM nation")
def rtf(spark, sf_dir):
    rtf_ = F.concat(F.lit("{\\rtf1{\\fonttbl{\\f0 X;}}\\b "), "n_name", F.lit("\\b0\\par \\u228?\\tab \\'e9}"))
    files = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".rtf")).alias("path"), F.encode(rtf_, "ISO-8859-1").alias("content"))
    return SRC.extract(files).where("error = ''").select(F.regexp_replace("path", r"\.rtf$", "").alias("n_name"), "text")


@query("S12_extraction", "SELECT n_name, k AS kind, CASE k WHEN 'html' THEN concat('Über ', n_name, chr(10), chr(10), 'zwei') WHEN 'txt' THEN concat(' ', n_name) WHEN 'rtf' THEN n_name END AS text, CASE WHEN k = 'xyz' THEN 'unsupported format xyz' ELSE '' END AS error FROM nation, (VALUES ('html'), ('txt'), ('rtf'), ('xyz')) AS t(k)")
def extraction(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    html = F.concat(F.lit("<head><title>no</title></head><p>&Uuml;ber "), "n_name", F.lit("</p><script>no</script><div> zwei</div>"))
    texts = {"html": html, "txt": F.concat(F.lit(" "), "n_name"), "rtf": F.concat(F.lit("{\\rtf1 "), "n_name", F.lit("}")), "xyz": F.col("n_name")}
    files = n.select(F.explode(F.array(*(F.struct(F.concat("n_name", F.lit(f".{k}")).alias("path"), F.encode(t, "UTF-8").alias("content")) for k, t in texts.items()))).alias("f")).select("f.*")
    return SRC.extract(files).select(F.regexp_replace("path", r"\.[a-z]+$", "").alias("n_name"), "kind", "text", "error")


@query("S15_archive_text", "SELECT n_name, concat(n_name, chr(10), 'second') AS text FROM nation")
def archives(spark, sf_dir):
    ship(spark)

    @F.pandas_udf("binary")
    def docx(names: pd.Series) -> pd.Series:
        out = []
        for n in names:
            with zipfile.ZipFile(raw := io.BytesIO(), "w") as z:
                z.writestr("word/document.xml", f'<w:d xmlns:w="w"><w:p><w:t>{n}</w:t></w:p><w:p><w:t>second</w:t></w:p></w:d>')
                z.writestr("word/styles.xml", "<x>no text</x>")
            out.append(raw.getvalue())
        return pd.Series(out)

    files = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".docx")).alias("path"), docx("n_name").alias("content"))
    return SRC.extract(files).where("error = ''").select(F.regexp_replace("path", r"\.docx$", "").alias("n_name"), "text")


@query("S16_pdf_pages", "SELECT n_name, page, concat('page:', page) AS anchor, CASE page WHEN 1 THEN concat('Land (', n_name, ')', chr(10), 'zweite Zeile ä') ELSE concat('€', n_nationkey) END AS text FROM nation, (VALUES (1), (2)) AS p(page)")
def pdf(spark, sf_dir):
    from .sources.pdf import pages

    ship(spark)

    @F.pandas_udf("binary")
    def made(names: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for name, key in zip(names, keys, strict=True):
            first = zlib.compress(f"BT /F1 12 Tf 72 700 Td (Land \\({name}\\)) Tj 0 -14 Td [(zwei) 20 (te) -400 (Zeile \\344)] TJ ET".encode("cp1252"))
            second = f"BT /F2 9 Tf <0001{''.join(f'{ord(c):04x}' for c in str(key))}> Tj ET".encode()
            cmap = b"2 beginbfchar <0001> <20AC> endbfchar 1 beginbfrange <0030> <0039> <0030> endbfrange"
            parts = [
                b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 >>", b"<< /Type /Page /Contents 6 0 R /Resources << /Font << /F2 7 0 R >> >> >>", b"<< /Type /Page /Contents [5 0 R] >>",
                b"<< /Filter /FlateDecode >>\nstream\n" + first + b"\nendstream", b"<< >>\nstream\n" + second + b"\nendstream", b"<< /Type /Font /ToUnicode 8 0 R >>", b"<< >>\nstream\n" + cmap + b"\nendstream",
            ]
            out.append(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>\nstartxref\n0\n%%EOF")
        return pd.Series(out)

    n = table(spark, sf_dir, "nation")
    found = pages(n.select(F.col("n_name").alias("path"), made("n_name", "n_nationkey").alias("content")))
    return found.where("error = ''").select(F.col("path").alias("n_name"), "page", "anchor", "text")


@query("S17_ingest_extraction", "SELECT conv_id, turn, substr(concat('Turn ', turn, chr(10), trim(role)), 1, 12) AS text, length(concat('Turn ', turn, chr(10), trim(role))) > 12 AS cut FROM conversations")
def ingest_extraction(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    mail = F.concat(F.lit("From: a@b.cc\r\nSubject: Turn "), F.col("turn").cast("string"), F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), "role", F.lit("\r\n"))
    files = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.lit("message/rfc822").alias("mime"), mail.cast("binary").alias("content"))
    got = I.ingest_text(files, 12)
    return got.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("conv_id"), F.split_part("path", F.lit("/"), F.lit(2)).cast("long").alias("turn"), "text", "cut")


@query(
    "S21_mail_poll",
    """WITH m AS (SELECT user_id % 5 AS account, event_id AS uid, CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('m', event_id % 700) END AS message_id FROM events),
    f AS (SELECT * FROM m WHERE account > 2 OR uid > 300) SELECT account, uid FROM f WHERE message_id = '' UNION ALL SELECT account, uid FROM f WHERE message_id <> '' QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY account, uid) = 1""",
)
def mail_poll(spark, sf_dir):
    account = (F.col("user_id") % 5).cast("long")
    m = table(spark, sf_dir, "events").select(account.alias("account"), F.lit(7).alias("uid_validity"), F.col("event_id").alias("uid"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("m"), (F.col("event_id") % 700).cast("string"))).alias("message_id"))
    cursors = spark.createDataFrame([(0, 7, 300), (1, 7, 300), (2, 7, 300), (3, 6, 300)], "account long, uid_validity int, last_uid long")
    return I.poll_mail(m, cursors)[0].select("account", "uid")


@query("S22_note_import", "SELECT page_id, concat('Top/Page ', page_id, '.md') AS path, concat('Page ', page_id) AS title, concat('see [x](Page%20', page_id + 1, '.md)') AS text FROM pages")
def note_import(spark, sf_dir):
    n, more = F.col("page_id").cast("string"), (F.col("page_id") + 1).cast("string")
    files = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("Top "), F.md5(F.lit("top")), F.lit("/Page "), n, F.lit(" "), F.md5("url"), F.lit(".md")).alias("path"), F.concat(F.lit("see [x](Page%20"), more, F.lit("%20"), F.md5(F.lit("y")), F.lit(".md)")).alias("text")
    )
    return I.import_notes(files).select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long").alias("page_id"), "path", "title", "text")


@query(
    "S23_manifest_import",
    "SELECT p_partkey AS pk, p_name AS title, n_name AS correspondent, CASE WHEN p_size % 2 = 0 THEN 'even' END AS document_type, CASE WHEN p_size % 3 = 0 THEN 'a,b' ELSE '' END AS tags FROM part LEFT JOIN nation ON n_nationkey = p_size WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 = 0)",
)
def manifest_import(spark, sf_dir):
    entry = lambda model, pk, fields: [F.lit(f"documents.{model}").alias("model"), pk.cast("long").alias("pk"), F.to_json(fields).alias("fields")]
    p = table(spark, sf_dir, "part")
    tags = F.when(F.col("p_size") % 3 == 0, F.array(F.lit(2), F.lit(1), F.lit(1))).otherwise(F.array().cast("array<int>"))
    docs = p.select(*entry("document", F.col("p_partkey"), F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("correspondent"), F.when(F.col("p_size") % 2 == 0, 1).alias("document_type"), tags.alias("tags"))))
    people = table(spark, sf_dir, "nation").select(*entry("correspondent", F.col("n_nationkey"), F.struct(F.col("n_name").alias("name"))))
    rest = spark.createDataFrame([("documents.documenttype", 1, '{"name":"even"}'), ("documents.tag", 1, '{"name":"a"}'), ("documents.tag", 2, '{"name":"b"}')], "model string, pk long, fields string")
    found = I.manifest(docs.unionByName(people).unionByName(rest), p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("pk")))
    return found.withColumn("tags", F.array_join("tags", ","))


@query("S25_activity_range", "SELECT concat('e', event_id) AS path, event_type AS event FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'")
def activity(spark, sf_dir):
    folder = workspace(spark)
    e = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("event"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), F.lit("t").alias("title"))
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"):
        e.where(F.col("day") == day).drop("day").write.json(f"{folder}/{day}.ndjson")
    return SRC.activity(spark, folder, "2024-01-02", "2024-01-03").select("path", "event")


_MEETING = "SELECT conv_id % 20 AS f, conv_id, turn, role FROM conversations"


def _meeting_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    row = F.struct(F.col("conv_id").alias("meeting"), F.lit("segment").alias("kind"), F.col("turn").cast("string").alias("id"), F.col("role").alias("speaker"), (F.col("turn") * 1000).alias("start"), (F.col("turn") * 1000 + 900).alias("end"), F.lit("x").alias("text"))
    turn = F.struct(F.col("conv_id").alias("meeting"), F.lit("turn").alias("kind"), F.col("role").alias("speaker"))
    broken = F.when(F.col("turn") == 1, F.lit('{"meeting": "none'))
    return c.select((F.col("conv_id") % 20).cast("string").alias("file"), F.explode(F.array(F.to_json(row), F.to_json(turn), broken, F.lit(" "))).alias("value")).where("value is not null")


@query("S27_meeting_store", f"SELECT CAST(f AS VARCHAR) AS file, kind, count(*) AS n FROM ({_MEETING}), (VALUES ('segment'), ('turn')) AS k(kind) GROUP BY ALL")
def meeting_store(spark, sf_dir):
    return I.meeting_lines(_meeting_lines(spark, sf_dir))[0].groupBy("file", "kind").agg(F.count("*").alias("n"))


@query(
    "D49_meetings",
    f"""WITH m AS ({_MEETING}), bad AS (SELECT f, count(*) AS failures FROM m WHERE turn = 1 GROUP BY f), s AS (SELECT f, conv_id AS meeting, count(*) AS segments, count(DISTINCT role) AS speakers, max(turn) * 1000 + 900 - min(turn) * 1000 AS duration FROM m GROUP BY ALL)
    SELECT CAST(f AS VARCHAR) AS file, meeting, segments, speakers, duration, coalesce(failures, 0) AS failures FROM s FULL JOIN bad USING (f)""",
)
def meetings(spark, sf_dir):
    return I.meeting_summaries(*I.meeting_lines(_meeting_lines(spark, sf_dir)))


@query("X39_header_aliases", "SELECT c_name AS name, c_mktsegment AS organization, CAST(c_custkey AS VARCHAR) AS phone, 'x' AS Other FROM customer")
def header_aliases(spark, sf_dir):
    folder = workspace(spark)
    c = table(spark, sf_dir, "customer")
    c.select(F.col("c_name").alias("Display Name"), F.col("c_mktsegment").alias("ORGANISATION"), F.col("c_custkey").alias("Phone 1 - Value"), F.lit("x").alias("Other")).write.option("header", True).csv(folder)
    return SRC.map_headers(SRC.read_csv(spark, folder))


# --- tables that change -------------------------------------------------------------------------------------------------


@query("S28_prefix_scan", "SELECT p_name AS key, CAST(p_partkey AS VARCHAR) AS value FROM part WHERE starts_with(p_name, 's')")
def prefix_scan(spark, sf_dir):
    return ST.kv_scan(table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").cast("string").alias("value")), "s")


@query("K14_set_remove", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 = 1 THEN 'second' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 3 <> 2")
def set_remove(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"), (F.col("o_orderkey") % 3).alias("k"))
    first = o.where("k > 0").select("key", F.lit("first").alias("value"), F.lit(1).alias("seq"))
    second = o.where("k > 0").select("key", F.when(F.col("k") == 1, "second").alias("value"), F.lit(2).alias("seq"))
    return ST.kv_applied(o.select("key", "value"), first.unionByName(second))


@query("K2_purge_resumed", "SELECT 'rows' AS name, count(*) AS n FROM orders UNION ALL SELECT 'snapshots', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'skipped', 1 UNION ALL SELECT 'purged', 3")
def purge(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("slug"), "o_orderkey")
    left, journal = ST.purge({"rows": rows, "snapshots": rows}, "P", spark.createDataFrame([("rows",)], "step string"))
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(journal.groupBy(F.col("state").alias("name")).agg(F.count("*").alias("n")))


@query("K3_index_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'later' ELSE source END AS title FROM documents")
def index_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"))
    some = d.where("doc_id % 3 = 0").select("doc_id")
    return ST.upsert_latest(d, some.select("doc_id", F.lit("first").alias("title"), F.lit(1).alias("at")).unionByName(some.select("doc_id", F.lit("later").alias("title"), F.lit(2).alias("at"))), "doc_id", "at")


@query(
    "K5_chunk_replace",
    f"""WITH w AS (SELECT doc_id AS id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(range(0, CASE WHEN length(t) <= 1000 THEN 1 ELSE CAST(ceil((length(t) - 200) / 800.0) AS BIGINT) END)) FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM documents) WHERE t <> '') GROUP BY doc_id)
    SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE n END AS n, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS generation FROM w""",
)
def chunk_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("t")).where("t <> ''")
    old = R.chunks(d, "doc_id", "t").select("id", "chunk_index", "content").withColumn("generation", F.lit(1))
    new = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit(0).alias("chunk_index"), F.lit("new").alias("content"))
    return ST.replace_chunks(old, new, "id").groupBy("id").agg(F.count("*").alias("n"), F.max("generation").alias("generation"))


@query("K5_chunk_replace_texts")
def chunk_replace_texts(spark, sf_dir):
    old = R.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "chunk_index", "content")
    fresh = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("chunk_index"), F.lit("new").alias("content"))
    return K.upsert(old, fresh, "doc_id")


@query(
    "K6_extraction_import",
    "SELECT doc_id AS doc, 0 AS start, n_chars AS \"end\", 'old' AS label FROM documents WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id, doc_id % 10, doc_id % 10 + 5, 'new' FROM documents WHERE doc_id % 4 = 1",
)
def extraction_import(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"), F.lit("old").alias("label"))
    at = F.col("doc_id") % 10
    good = F.to_json(F.struct(F.col("doc_id").alias("doc"), at.alias("start"), (at + 5).alias("end"), F.lit("new").alias("label")))
    lines = d.select(F.when(F.col("doc_id") % 4 == 1, good).when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{"doc": '), F.col("doc_id").cast("string"), F.lit(', "start": 9, "end": 1}'))).otherwise("no line").alias("value"))
    return I.extractions(lines, old)[0]


@query("K10_contact_export", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, concat_ws(', ', n_name, 'a \"b\"') AS place FROM customer JOIN nation ON n_nationkey = c_nationkey")
def contact_export(spark, sf_dir):
    folder = workspace(spark)
    n = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat_ws(", ", "n_name", F.lit('a "b"')).alias("place"))
    K.write_csv(rows, folder, ["id", "name", "place"])
    return SRC.read_csv(spark, folder)


@query(
    "K13_journal_append",
    """WITH x AS (SELECT CAST(conv_id AS VARCHAR) AS author, list(role ORDER BY turn) AS b FROM conversations GROUP BY conv_id), h AS (SELECT author, b, unnest(range(1, len(b) + 1)) AS i, CASE WHEN CAST(author AS BIGINT) % 2 = 0 THEN 'head' ELSE '' END AS h0, CASE WHEN CAST(author AS BIGINT) % 2 = 0 THEN 10 ELSE 0 END AS s0 FROM x)
    SELECT author, s0 + i AS seq, b[i] AS body, list_reduce(list_prepend(h0, b[1 : i]), lambda a, v: sha256(concat(a, chr(10), v))) AS hash FROM h""",
)
def journal_append(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("author"), F.col("turn").alias("ts"), F.col("turn").alias("id"), F.col("role").alias("body"))
    heads = c.select("author").distinct().where("author % 2 = 0").select("author", F.lit(10).alias("seq"), F.lit("head").alias("hash"))
    return ST.appended(heads, c).select("author", "seq", "body", "hash")


@query("K15_backup_relocate", "SELECT doc_id, concat('/new/', path) AS path FROM files_d", ("files_d",))
def backup(spark, sf_dir):
    folder = workspace(spark)
    rows = base(spark, sf_dir, "files_d").select("doc_id", F.concat(F.lit("/old/"), "path").alias("path"))
    K.backup(rows, folder)
    return ST.relocated(K.restore(spark, folder), "path", "/old", "/new/")


@query("R6_recovered_leases", "SELECT event_id AS job_id, CASE WHEN user_id % 2 = 0 AND ts + INTERVAL 15 MINUTE < TIMESTAMP '2024-01-05' THEN 'pending' WHEN user_id % 2 = 0 THEN 'processing' ELSE 'done' END AS status, CASE WHEN user_id % 2 = 0 AND ts + INTERVAL 15 MINUTE < TIMESTAMP '2024-01-05' THEN 2 ELSE 1 END AS attempts FROM events")
def recovered_leases(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("user_id") % 2 == 0, "processing").otherwise("done").alias("status"), F.lit(1).alias("attempts"), F.expr("ts + INTERVAL 15 MINUTE").alias("lease_until"))
    return ST.recovered(jobs, F.expr("TIMESTAMP_NTZ'2024-01-05'")).select("job_id", "status", "attempts")


@query("O9_job_page", "SELECT event_id AS job_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 50")
def job_page(spark, sf_dir):
    return ST.job_page(table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at")), 100, 50).select("job_id")


@query("R9_duplicate_content", "SELECT doc_id AS id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars, doc_id) = 1")
def duplicate_content(spark, sf_dir):
    return CH.first_seen(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("ts"), F.sha2("text", 256).alias("h")), "h").select("id")


_SEEN = "SELECT doc_id FROM documents WHERE doc_id % 9 = 4"


@query(
    "D26_ingest",
    f"""SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN doc_id % 5 <> 0 AND contains(lower(text), 'license') THEN 'legal' END AS category FROM documents
    WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id IN ({_SEEN})) QUALIFY row_number() OVER (PARTITION BY text ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0')) = 1""",
)
def ingest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.when(F.col("doc_id") % 5 == 0, "image/png").otherwise("text/plain").alias("mime"), F.col("text").cast("binary").alias("content"))
    docs, _ = I.ingest(files, d.where("doc_id % 9 = 4").select(F.sha2("text", 256).alias("sha256")), [("LICENSE", "category", "legal")], {})
    return docs.select(F.col("path").cast("long").alias("doc_id"), "sha256", "status", "category")


@query("R3_retrieval_refresh", "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 2 THEN 2 ELSE 1 END AS generation FROM documents WHERE doc_id % 7 <> 0 AND text <> ''")
def index_refresh(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text <> ''")
    listing = lambda t: t.select(F.col("doc_id").alias("path"), F.octet_length("text").alias("size"), F.lit(1).alias("mtime"), F.sha2("text", 256).alias("sha256"))
    now = d.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    what = CH.changed(listing(now), listing(d)).withColumnRenamed("path", "id")
    old = R.chunks(d, "doc_id", "text").select("id", "chunk_index", "content").withColumn("generation", F.lit(1))
    left = K.delete(old, what.where("change = 'removed'"), "id")
    again = now.join(what.where("change in ('added', 'modified')").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    fresh = R.chunks(again, "doc_id", "text").select("id", "chunk_index", "content")
    return ST.replace_chunks(left, fresh, "id").select("id", "generation").distinct()


# --- logs ---------------------------------------------------------------------------------------------------------------

_RUNS = """SELECT concat('r', user_id % 60) AS run_id, ts, event_id, event_type, CASE event_id % 7 WHEN 0 THEN 'run.requested' WHEN 1 THEN 'run.approved' WHEN 2 THEN 'run.started' WHEN 3 THEN 'run.finished' WHEN 4 THEN 'run.failed' WHEN 5 THEN 'run.cancelled' ELSE 'note' END AS kind FROM events"""
_KINDS = ("run.requested", "run.approved", "run.started", "run.finished", "run.failed", "run.cancelled", "note")


def _run_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 7 + 1).cast("int"))
    say = lambda v, *kinds: F.when(kind.isin(*kinds), v)
    # every tenth finish lacks its summary and is not well-formed
    summary = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("s"), F.col("event_id").cast("string")))
    t = F.col("event_id").cast("string")
    body = F.to_json(F.struct(F.concat(F.lit("r"), (F.col("user_id") % 60).cast("string")).alias("run_id"), say(t, "run.requested").alias("title"), say(F.lit("p"), "run.requested").alias("plan_file"), say(F.lit("a"), "run.requested").alias("adapter"), say(t, "run.approved").alias("approval_id"), say(F.lit("x"), "run.approved").alias("scope"), say(F.lit("z"), "run.approved").alias("expires_at"), say(summary, "run.finished").alias("summary"), say(F.lit("e"), "run.failed").alias("error"), say(F.lit("c"), "run.cancelled").alias("reason")))
    return e.select(F.col("event_id").alias("lamport"), "ts", F.col("event_type").alias("author"), F.col("event_id").alias("seq"), t.alias("id"), kind.alias("kind"), body.alias("body"))


@query(
    "D33_runs",
    f"""WITH e AS (SELECT * FROM ({_RUNS}) WHERE kind <> 'note' AND NOT (kind = 'run.finished' AND event_id % 10 = 0) AND NOT (kind = 'run.approved' AND event_type <> (SELECT min(event_type) FROM events))),
    n AS (SELECT *, sum(CASE WHEN kind = 'run.requested' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY event_id) AS k FROM e), l AS (SELECT *, max(k) OVER (PARTITION BY run_id) AS top FROM n)
    SELECT run_id, split_part(arg_max(kind, event_id), '.', 2) AS state, CAST(min(event_id) AS VARCHAR) AS title, CAST(max(CASE WHEN kind = 'run.approved' THEN event_id END) AS VARCHAR) AS approval_id, 's' || max(CASE WHEN kind = 'run.finished' THEN event_id END) AS summary FROM l WHERE k = top AND k > 0 GROUP BY run_id""",
)
def runs(spark, sf_dir):
    first = table(spark, sf_dir, "events").agg(F.min("event_type").alias("author"))
    return ST.runs(_run_events(spark, sf_dir), first).select("run_id", "state", "title", "approval_id", "summary")


@query("R10_run_state", f"SELECT run_id FROM (SELECT run_id, arg_max(kind, event_id) AS kind FROM ({_RUNS}) WHERE kind IN ('run.requested', 'run.approved', 'run.cancelled') GROUP BY run_id HAVING count(CASE WHEN kind = 'run.requested' THEN 1 END) > 0 AND arg_max(kind, event_id) <> 'run.cancelled' AND max(CASE WHEN kind = 'run.requested' THEN event_id END) IS NOT NULL)")
def waiting_runs(spark, sf_dir):
    events = _run_events(spark, sf_dir).where(F.col("kind").isin("run.requested", "run.approved", "run.cancelled"))
    return ST.pending_runs(ST.runs(events)).select("run_id")


@query(
    "D33_checkpoints",
    """WITH e AS (SELECT concat('c', user_id % 40) AS checkpoint_id, event_id, event_id % 2 = 0 AS opens FROM events), n AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY checkpoint_id ORDER BY event_id) AS k FROM e), l AS (SELECT *, max(k) OVER (PARTITION BY checkpoint_id) AS top FROM n)
    SELECT checkpoint_id, CASE WHEN max(event_id) > min(event_id) THEN 'resolved' ELSE 'requested' END AS state, CAST(min(event_id) AS VARCHAR) AS question, CAST(max(CASE WHEN NOT opens THEN event_id END) AS VARCHAR) AS answer FROM l WHERE k = top AND k > 0 GROUP BY checkpoint_id""",
)
def checkpoints(spark, sf_dir):
    t = F.col("event_id").cast("string")
    opens = F.col("event_id") % 2 == 0
    body = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("checkpoint_id"), F.when(opens, "r").alias("run_id"), F.when(opens, t).alias("question"), F.when(~opens, t).alias("answer")))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("lamport"), "ts", F.col("event_type").alias("author"), F.col("event_id").alias("seq"), t.alias("id"), F.when(opens, "checkpoint.requested").otherwise("checkpoint.resolved").alias("kind"), body.alias("body"))
    return ST.checkpoints(events).select("checkpoint_id", "state", "question", "answer")


@query(
    "D28_retention_state",
    """WITH due AS (SELECT doc_id FROM files_d WHERE type = 'invoice' AND document_date + INTERVAL 100 DAY <= TIMESTAMP '2025-06-01'), h AS (SELECT doc_id, arg_max(quality, toxic) AS q, count(*) AS n FROM labels GROUP BY doc_id)
    SELECT doc_id, CASE WHEN q = 1 THEN 'accepted' WHEN q = 0 THEN 'rejected' ELSE 'proposed' END AS state FROM due LEFT JOIN h USING (doc_id)""",
    ("files_d",),
)
def retention_state(spark, sf_dir):
    due = DOC.retention(base(spark, sf_dir, "files_d"), kind="invoice", tags=[], period_days=100, now=dt.datetime(2025, 6, 1))
    action = F.when(F.col("quality") == 1, "accept").otherwise("reject")
    history = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("action_id"), action.alias("action"), F.col("toxic").alias("ts"))
    # the same action written again, later and changed, is not a new one
    again = history.withColumn("action", F.lit("accept")).withColumn("ts", F.col("ts") + 10)
    return ST.retention_state(due.select("doc_id"), history.unionByName(again))


_VERSIONS = "SELECT user_id, ts, event_id, sha256(concat(event_type, '')) AS blob FROM events"


@query(
    "D30_version_history",
    f"""WITH v AS (SELECT * FROM ({_VERSIONS}) QUALIFY coalesce(lag(blob) OVER (PARTITION BY user_id ORDER BY ts, blob), '') <> blob), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, blob) AS k FROM v)
    SELECT CAST(user_id AS VARCHAR) AS path, arg_max(blob, k) AS latest, (SELECT any_value(b.blob) FROM n b WHERE b.user_id = n.user_id AND b.k = greatest(1, max(n.k) - 1)) AS undone, max(k) AS versions FROM n GROUP BY user_id""",
)
def version_history(spark, sf_dir):
    v = ST.versions(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_type").alias("content")))
    latest = ST.restored(v, F.expr("TIMESTAMP_NTZ'2100-01-01'")).withColumnRenamed("blob", "latest")
    n = v.groupBy("path").agg(F.max("version").cast("long").alias("versions"))
    return latest.join(ST.undone(v).withColumnRenamed("blob", "undone"), "path").join(n, "path")


@query("D30_blob_collection", "SELECT DISTINCT sha256(event_type) AS blob FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id % 50 = 1)")
def blob_collection(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.sha2("event_type", 256).alias("blob"))
    return ST.unreferenced(e, e.where("event_id % 50 = 1"))


@query("D35_projection", "SELECT conv_id, turn, role AS speaker, text AS note FROM conversations WHERE role = 'user'")
def projection(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    events = c.select("conv_id", "turn", F.concat(F.lit("note."), "role").alias("kind"), F.to_json(F.struct(F.col("role").alias("speaker"), F.col("text").alias("note"))).alias("body"))
    from .operators.journal import projected

    return projected(events, "note.user", "speaker string, note string", ["conv_id", "turn"])


@query("D39_memberships", "SELECT c_custkey AS person, n_name AS organization, o_orderdate AS since FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name = (SELECT min(n_name) FROM nation) AND o_orderdate <= TIMESTAMP '1996-01-01' AND (o_orderkey % 2 = 0 OR o_orderdate + INTERVAL 400 DAY > TIMESTAMP '1996-01-01')")
def memberships(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("person"), F.col("n_name").alias("organization"), F.lit("member").alias("role"), F.col("o_orderdate").alias("since"), F.when(F.col("o_orderkey") % 2 == 1, F.expr("o_orderdate + INTERVAL 400 DAY")).alias("until"))
    first = n.agg(F.min("n_name")).first()[0]
    return ST.memberships(rows, organization=first, at=F.expr("TIMESTAMP_NTZ'1996-01-01'")).select("person", "organization", "since")


@query("R11_stale_generations", "SELECT CAST(label AS VARCHAR) AS name, max(vec_id) AS generation FROM embeddings GROUP BY label HAVING max(vec_id) <> (SELECT max(vec_id) FROM embeddings)")
def stale_indexes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    indexes = e.groupBy(F.col("label").cast("string").alias("name")).agg(F.max("vec_id").alias("generation"))
    return ST.stale(indexes, e.select(F.col("vec_id").alias("generation"))).select("name", "generation")


# --- functions, views, health -------------------------------------------------------------------------------------------


@query("X17_markdown_links", "SELECT doc_id, concat('a/', doc_id, '.md;c.md') AS links FROM documents")
def markdown_links(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    own = F.regexp_replace("text", r"[\[\]`]", "")
    md = F.concat(F.lit("[x](a/"), n, F.lit(".md#h) ![i](i.png) [y](http://h/z) [z](c.md \"t\") `[q](no.md)` [x2](a/"), n, F.lit(".md)\n"), own)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(TX.markdown_links(md), ";").alias("links"))


@query("X28_metadata_format", "SELECT doc_id, concat_ws(chr(10), 'person: ' || person, 'status: ' || status, 'tags: ' || array_to_string(tags, ', ')) AS formatted, coalesce(lower(status) = 'open', false) AS matches FROM files_d", ("files_d",))
def metadata_format(spark, sf_dir):
    f = base(spark, sf_dir, "files_d")
    fields = {"person": F.col("person"), "status": F.col("status"), "tags": F.array_join("tags", ", ")}
    return f.select("doc_id", TX.format_metadata(fields).alias("formatted"), TX.match_metadata(fields, "status:OPEN").alias("matches"))


@query("X28_metadata_strip", "SELECT doc_id, 'words left' AS query FROM documents")
def metadata_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", TX.strip_metadata(F.concat(F.lit("words person:"), "source", F.lit(" left status:open")), ["person", "status"]).alias("query"))


@query("X34_policy", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'public' WHEN doc_id % 5 = 1 THEN 'internal' ELSE 'restricted' END AS policy FROM documents")
def policy(spark, sf_dir):
    raw = F.element_at(F.array(F.lit(" Public "), F.lit("INTERNAL"), F.lit(""), F.lit("odd"), F.lit(None).cast("string")), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", ST.normalized_policy(raw).alias("policy"))


_GUARD = [("dataset:pay", "", "export denied: dataset pay is restricted, at most internal"), ("dataset:pay", "restricted", ""), ("all", "", ""), ("dataset:open", "public", ""), ("dataset:", "", "dataset export requires a dataset slug"), ("dataset:Not Safe", "", 'dataset slug "Not Safe" is not filesystem-safe'), ("dataset:open", "odd", 'invalid dataset sensitivity "odd"'), ("dataset:gone", "", 'dataset "gone" not found')]


@query("D42_export_guard", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{m}', '{e}')" for s, m, e in _GUARD) + ") AS t(source, maximum, error)")
def export_guard(spark, sf_dir):
    out = []
    for source, maximum, _ in _GUARD:
        try:
            V.check_export(V.View("v", source), {"pay": "restricted", "open": "public"}, maximum)
            out.append((source, maximum, ""))
        except SpecError as e:
            out.append((source, maximum, str(e)))
    return spark.createDataFrame(out, "source string, maximum string, error string")


@query("D43_dataset_list", "SELECT 'events' AS slug, count(*) AS rows, CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date FROM events UNION ALL SELECT 'orders', count(*), CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders UNION ALL SELECT 'part', count(*), NULL, NULL FROM part")
def dataset_list(spark, sf_dir):
    return V.described({"orders": (table(spark, sf_dir, "orders"), "o_orderdate"), "events": (table(spark, sf_dir, "events"), "ts"), "part": (table(spark, sf_dir, "part"), None)})


@query("D41_dataset_view", "SELECT o_orderkey AS key, concat(o_orderpriority, '/', coalesce(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END, '')) AS label, '' AS linked FROM orders WHERE o_totalprice > 150000 ORDER BY key LIMIT 1000")
def dataset_view(spark, sf_dir):
    rows = base(spark, sf_dir, "orders_d").where("big or total is null").join(table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_orderkey").alias("key")), "key", "left_semi")
    return V.dataset_rows(rows, "key", {"label": "{priority}/{status}"}, ["linked"]).select("key", "label", "linked")


_TAGS = "SELECT doc_id, list_distinct(list_filter(list_transform(tags, lambda t: CASE WHEN lower(t) IN ('de', 'fr') THEN 'romance' ELSE t END), lambda t: lower(t) <> 'src1')) AS n, tags AS o FROM files_d"


@query("D48_tag_merge_delete", f"SELECT doc_id, array_to_string(list_sort(n), ',') AS tags, CASE WHEN list_sort(n) = list_sort(list_distinct(o)) THEN 'unchanged' ELSE 'changed' END AS status FROM ({_TAGS})", ("files_d",))
def tag_merge(spark, sf_dir):
    f = base(spark, sf_dir, "files_d").select("doc_id", "tags")
    merged = DOC.rewrite_tags(f, {"DE": "romance", "fr": "romance"}, ["SRC1"])
    return merged.select("doc_id", F.array_join(F.array_sort("tags"), ",").alias("tags"), "status")


@query("D50_orphan_stores", "SELECT DISTINCT doc_id // 10 AS store, 'orphan' AS state FROM documents WHERE doc_id // 10 NOT IN (SELECT doc_id // 10 FROM labels) UNION SELECT DISTINCT doc_id // 10, 'in use' FROM documents WHERE doc_id // 10 IN (SELECT doc_id // 10 FROM labels)")
def orphan_stores(spark, sf_dir):
    store = F.expr("doc_id div 10").alias("store")
    return H.stores(table(spark, sf_dir, "documents").select(store), table(spark, sf_dir, "labels").select(store))


@query("D53_entities", "SELECT DISTINCT b.n_name AS name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_nationkey = 3")
def entities(spark, sf_dir):
    from .operators.graph import candidates, neighbours

    n = table(spark, sf_dir, "nation")
    named = n.select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("x "), "n_name")).alias("aliases"))
    wanted = n.where("n_nationkey = 3").first()["n_name"].upper()
    edges = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))
    found = neighbours(candidates(named, f"X {wanted}"), edges)
    return named.join(found, "entity", "left_semi").select("name")


@query("D24_rule_dry_run", "SELECT doc_id, 'legal' AS value FROM documents WHERE contains(lower(text), 'license')")
def dry_run(spark, sf_dir):
    return DOC.dry_run(table(spark, sf_dir, "documents").select("doc_id", "text"), ("LICENSE", "category", "legal"), F.col("text")).select("doc_id", "value")


_H = """x AS (SELECT doc_id, concat('n', doc_id, '.md') AS path, doc_id % 6 AS k FROM documents)"""


_FINDINGS = f"""WITH {_H} SELECT path, 'missing_frontmatter' AS category, '' AS detail FROM x WHERE k = 0 UNION ALL SELECT path, 'parse_error', 'duplicate key a' FROM x WHERE k = 1 UNION ALL SELECT path, 'broken_wikilink', 'nowhere' FROM x WHERE k = 2
    UNION ALL SELECT path, 'broken_markdown_link', 'gone.md' FROM x WHERE k = 3 UNION ALL SELECT path, 'orphaned_derived', 'lost.md' FROM x WHERE k = 4 UNION ALL SELECT path, 'stale_derived', concat('n', doc_id - 5, '.md') FROM x WHERE k = 5 UNION ALL SELECT path, 'near_duplicate', 'n0.md' FROM x WHERE k = 2"""
_COUNTS = f"WITH {_H} SELECT CASE k WHEN 0 THEN 'missing_frontmatter' WHEN 1 THEN 'parse_error' WHEN 2 THEN 'broken_wikilink' WHEN 3 THEN 'broken_markdown_link' WHEN 4 THEN 'orphaned_derived' ELSE 'stale_derived' END AS category, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT 'near_duplicate', count(*) FROM x WHERE k = 2"


def _health(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), (F.col("doc_id") % 6).alias("k"), "doc_id")
    text = F.when(F.col("k") == 0, "no front").when(F.col("k") == 1, "---\na: 1\na: 2\n---\n").when(F.col("k") == 2, "---\na: 1\n---\n[[nowhere]] [[n1]]").when(F.col("k") == 3, "---\na: 1\n---\n[x](gone.md) [y](n1.md)").otherwise("---\na: 1\n---\n")
    files = SRC.markdown(d.select("path", text.cast("binary").alias("content")))
    derived = d.where("k >= 4").select("path", F.when(F.col("k") == 4, "lost.md").otherwise(F.concat(F.lit("n"), (F.col("doc_id") - 5).cast("string"), F.lit(".md"))).alias("source"), F.lit(1).alias("source_mtime"))
    times = d.select("path", F.when(F.col("k") == 0, 2).otherwise(1).alias("mtime"))
    copies = d.where("k = 2").select(F.lit("n0.md").alias("representative"), F.col("path").alias("id"))
    return H.findings(files, derived, times, copies)


@query("D11_vault_health", _FINDINGS)
def vault_health(spark, sf_dir):
    return _health(spark, sf_dir)


@query("A19_health_counts", _COUNTS)
def health_counts(spark, sf_dir):
    return _health(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "A17_centroids",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v), c AS (SELECT vec_id AS cell, e FROM u WHERE vec_id < 4),
    own AS (SELECT u.vec_id, u.e, arg_max(cell, (list_dot_product(u.e, c.e), -cell)) AS cell FROM u, c GROUP BY u.vec_id, u.e)
    SELECT cell, CAST(i - 1 AS INT) AS i, round(avg(e[i]), 6) AS x, count(*) AS n FROM own, unnest(range(1, len(e) + 1)) AS t(i) GROUP BY cell, i""",
)
def centroids(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    first = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in v.where("vec_id < 4").collect()}
    c = R.lloyd(v, first, "embedding")
    return c.select("cell", "n", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("D45_citation_warnings", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '4' WHEN doc_id % 3 = 1 THEN '' ELSE '0,9' END AS unknown FROM documents")
def citation_warnings(spark, sf_dir):
    answer = F.when(F.col("doc_id") % 3 == 0, "so [1] and [4], [4]").when(F.col("doc_id") % 3 == 1, "so [2] `[7]`").otherwise("[9] [0] [3]")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(TX.unknown_citations(answer, F.lit(3)), ",").alias("unknown"))
