"""Foreign data: mail, note exports, document manifests, producer rows, meeting stores, source registries, extraction files."""

from __future__ import annotations

import email
import email.policy
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .files import MAX_BYTES, html_text

#: File types that a registered source is searched for besides Markdown.
CODE = ("c", "cc", "cpp", "cs", "css", "go", "h", "hpp", "html", "java", "js", "json", "kt", "lua", "php", "pl", "py", "rb", "rs", "scala", "sh", "sql", "swift", "toml", "ts", "txt", "xml", "yaml", "yml")


def poll_mail(messages: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New messages and new cursors.

    ``messages``: account, uid_validity, uid, message_id; ``cursors``: account, uid_validity, last_uid. A mailbox whose validity
    has changed is read from its beginning. A message id counts once, from the least account and uid; messages without one are kept.
    """
    c = cursors.select("account", F.col("uid_validity").alias("_sl_v"), F.col("last_uid").alias("_sl_u"))
    seen = F.col("uid_validity").eqNullSafe(F.col("_sl_v")) & (F.col("uid") <= F.col("_sl_u"))
    fresh = messages.join(c, "account", "left").where(~F.coalesce(seen, F.lit(False))).drop("_sl_v", "_sl_u")
    named = fresh.where(F.coalesce("message_id", F.lit("")) != "")
    first = named.groupBy("message_id").agg(F.min(F.struct("account", "uid")).alias("_sl_f"))
    kept = named.join(first, "message_id").where((F.col("account") == F.col("_sl_f.account")) & (F.col("uid") == F.col("_sl_f.uid"))).drop("_sl_f")
    new = messages.groupBy("account").agg(F.max(F.struct("uid_validity", "uid")).alias("m")).select("account", "m.uid_validity", F.col("m.uid").alias("last_uid"))
    return kept.unionByName(fresh.where(F.coalesce("message_id", F.lit("")) == "")), new


_EXPORT_ID = " [0-9a-f]{32}"


def clean_export_name(path: Column) -> Column:
    """A path of a note export without the identifiers that follow each name."""
    return F.regexp_replace(path, _EXPORT_ID + r"(?=/|\.[A-Za-z0-9]+$|$)", "")


def import_notes(files: DataFrame) -> DataFrame:
    """(path, title, text) of a note export's pages (path, text): clean names, links between pages rewritten to them."""
    path = clean_export_name(F.col("path"))
    # in links blanks are written as %20
    text = F.regexp_replace("text", r"(?:%20| )[0-9a-f]{32}(?=\.(?:md|csv)\))", "")
    return files.where(F.lower("path").endswith(".md")).select(path.alias("path"), F.regexp_extract(path, r"([^/]*)\.md$", 1).alias("title"), text.alias("text"))


def manifest(entries: DataFrame, imported: DataFrame) -> DataFrame:
    """(pk, title, correspondent, document_type, tags) of the documents of a manifest that are not imported yet.

    ``entries``: model, pk, fields (JSON). Names are looked up among the manifest's own entries; ``imported``: pk.
    """
    name = F.get_json_object("fields", "$.name")

    def named(model: str, column: str) -> DataFrame:
        return entries.where(F.col("model") == f"documents.{model}").select(F.col("pk").alias(f"_sl_{column}"), name.alias(column))

    docs = entries.where("model = 'documents.document'").join(imported.select("pk"), "pk", "left_anti")
    docs = docs.select("pk", F.get_json_object("fields", "$.title").alias("title"), *(F.get_json_object("fields", f"$.{c}").cast("long").alias(f"_sl_{c}") for c in ("correspondent", "document_type")), F.from_json(F.get_json_object("fields", "$.tags"), "array<long>").alias("_sl_ts"))
    tags = docs.select("pk", F.explode("_sl_ts").alias("_sl_tag")).join(named("tag", "tag"), "_sl_tag").groupBy("pk").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    for c in ("correspondent", "document_type"):
        docs = docs.join(named(c.replace("document_type", "documenttype"), c), f"_sl_{c}", "left")
    return docs.join(tags, "pk", "left").select("pk", "title", "correspondent", "document_type", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def producer_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """(identity, columns) of a producer's JSON lines (value); rows without identity are left out, of one identity the last line counts.

    ``place`` orders the lines.
    """
    schema = "identity string, values map<string,string>"
    rows = lines.select("place", F.from_json("value", schema).alias("r")).where("coalesce(r.identity, '') <> ''")
    last = rows.groupBy(F.col("r.identity").alias("identity")).agg(F.max_by("r.values", "place").alias("v"))
    return last.select("identity", *(F.col("v")[c].alias(c) for c in columns))


def registry(log: DataFrame) -> DataFrame:
    """(path, added) of the sources that are registered after a log (ts, path, action: add or remove), in path order."""
    last = log.groupBy("path").agg(F.max_by("action", F.struct("ts", "seq")).alias("action"), F.max("ts").alias("added"))
    return last.where("action = 'add'").select("path", "added").orderBy("path")


def source_files(files: DataFrame) -> DataFrame:
    """Files (path, length) of a source that are indexed: Markdown of any size, code and text up to ``MAX_BYTES``."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where((ext == "md") | (ext.isin(*CODE) & (F.col("length") <= MAX_BYTES)))


def extractions(lines: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, failures): extraction lines (value, JSON with doc, start, end, label) replace a document's rows in ``old``; lines that are none are failures."""
    schema = "doc long, start long, end long, label string"
    read = lines.select("value", F.from_json("value", schema).alias("e"))
    good = (F.col("e.doc").isNotNull()) & (F.col("e.start") <= F.col("e.end")) & F.col("e.label").isNotNull()
    fresh = read.where(good).select("e.*")
    return old.join(fresh.select("doc").distinct(), "doc", "left_anti").unionByName(fresh), read.where(~F.coalesce(good, F.lit(False))).select("value")


_SEGMENT = "meeting long, kind string, id string, speaker string, start long, end long, text string"


def meeting_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of a meeting store's JSON lines (file, value): segments, turns and alignments by ``kind``; failures per file."""
    read = lines.where("trim(value) <> ''").select("file", "value", F.from_json("value", _SEGMENT).alias("e"))
    ok = F.col("e.meeting").isNotNull() & F.col("e.kind").isin("segment", "turn", "alignment")
    return read.where(ok).select("file", "e.*"), read.where(~F.coalesce(ok, F.lit(False))).groupBy("file").agg(F.count("*").alias("failures"))


def meeting_summaries(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """(file, meeting, segments, speakers, duration, failures) of each meeting file; a file without a good line has nulls."""
    s = rows.where("kind = 'segment'").groupBy("file", "meeting").agg(F.count("*").alias("segments"), F.countDistinct("speaker").alias("speakers"), (F.max("end") - F.min("start")).alias("duration"))
    return s.join(failures, "file", "full_outer").select("file", "meeting", "segments", "speakers", "duration", F.coalesce("failures", F.lit(0)).alias("failures"))


def mail_text(raw: bytes) -> str:
    """Subject and visible text of a message: its plain part, else its HTML part."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = "" if body is None else body.get_content()
    if body is not None and body.get_content_type() == "text/html":
        text = html_text(text)
    return "\n".join(x for x in (str(m["subject"] or "").strip(), re.sub(r"\r\n?", "\n", text).strip()) if x)


def ingest_text(files: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """(path, mime, text, cut, error) of (path, mime, content): text of at most ``limit`` characters, and whether it was cut.

    Mail, HTML and all kinds of text; another type is an error of its row.
    """
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for path, mime, content in zip(b["path"], b["mime"], b["content"], strict=True):
                text, error = None, ""
                try:
                    data = bytes(content or b"")
                    if len(data) > MAX_BYTES:
                        raise ValueError("too large")
                    if mime == "message/rfc822":
                        text = mail_text(data)
                    elif mime == "text/html":
                        text = html_text(data.decode("utf-8", "replace"))
                    elif (mime or "").startswith("text/") or mime in ("application/json", "application/xml"):
                        text = data.decode("utf-8", "replace")
                    else:
                        raise ValueError(f"unsupported type {mime}")
                except Exception as e:  # noqa: BLE001  one bad file is a row with its error
                    error = str(e)[:200] or type(e).__name__
                rows.append((path, mime, None if text is None else text[:limit], text is not None and len(text) > limit, error))
            yield pd.DataFrame(rows, columns=["path", "mime", "text", "cut", "error"])

    return files.select("path", "mime", "content").mapInPandas(run, "path string, mime string, text string, cut boolean, error string")


def ingest(files: DataFrame, seen: DataFrame, rules: list[tuple[str, str, str]], patterns: dict[str, str], limit: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(documents, annotations): files (path, mime, content) through hash, duplicate suppression, job, extraction, classification and annotation.

    Of equal contents the least path counts, and none that ``seen`` (sha256) holds. A job is done, or failed with its error.
    """
    from ..operators.documents import annotate, classify

    hashed = files.withColumn("sha256", F.sha2("content", 256)).join(seen.select("sha256"), "sha256", "left_anti")
    first = hashed.groupBy("sha256").agg(F.min("path").alias("path"))
    texts = ingest_text(hashed.join(first, ["sha256", "path"]), limit).join(first, "path")
    jobs = texts.withColumn("status", F.when(F.col("error") == "", "done").otherwise("failed"))
    docs = classify(jobs, rules, F.coalesce("text", F.lit("")))
    return docs, annotate(docs.where("status = 'done'"), "path", "text", patterns)
