"""Files as tables: Markdown with front matter, strict and lenient CSV, HTML, RTF and archives, journals, contacts."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

try:
    import yaml
except ModuleNotFoundError:  # the flat reader serves then
    yaml = None

#: Directories a walk leaves out.
SKIPPED = ("node_modules", "vendor", "dist", "build", "venv", ".venv", "__pycache__")
MAX_BYTES = 10 << 20


def walk(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of all files below ``root``, without skipped directories; Spark lists and reads.

    Contents are not sorted: ``listing`` has the paths in order.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return rows.where(~F.col("path").rlike("/(?:" + "|".join(re.escape(s) for s in SKIPPED) + ")/"))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length) in path order; no file is opened."""
    return walk(spark, root, pattern).select("path", "modificationTime", "length").orderBy("path")


def conflict_files(files: DataFrame) -> DataFrame:
    """(conflict, original) of the files (path) that a sync left beside the original: ``name (conflict 3).ext``."""
    mark = r" \(conflict [0-9]+\)(?=\.[^./]+$)"
    return files.where(F.col("path").rlike(mark)).select(F.col("path").alias("conflict"), F.regexp_replace("path", mark, "").alias("original"))


class _DuplicateKey(ValueError):
    pass


def _yaml_fields(raw: str) -> dict[str, str] | None:
    """Fields of a YAML mapping as texts: lists as ``[a, b]``, mappings as JSON; None where no YAML reader is installed.

    A key that occurs twice is an error, as is text that is no mapping.
    """
    if yaml is None:
        return None

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            if key in out:
                raise _DuplicateKey(f"duplicate key {key}")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    for tag in ("timestamp", "bool", "int", "float"):
        Loader.add_constructor(f"tag:yaml.org,2002:{tag}", lambda loader, node: node.value)
    found = yaml.load(raw, Loader)  # noqa: S506  a safe loader
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError("front matter is no mapping")
    show = lambda v: "" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else f"[{', '.join(map(show, v))}]" if isinstance(v, list) else str(v)
    return {str(k): show(v) for k, v in found.items()}


def front_matter(text: str) -> tuple[dict[str, str], str, str]:
    """(fields, body, error) of a Markdown text: YAML between two ``---`` lines.

    Without a YAML reader: ``key: value`` lines; a list is ``[a, b]`` or ``- a`` lines.
    """
    if not re.match(r"---\r?\n", text):
        return {}, text, ""
    m = re.match(r"---\r?\n(.*?\r?\n)?---(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, text, "unterminated front matter"
    try:
        if (whole := _yaml_fields(m[1] or "")) is not None:
            return whole, text[m.end() :], ""
    except _DuplicateKey as e:
        return {}, text[m.end() :], str(e)
    except Exception as e:  # noqa: BLE001  a bad file is a row with its error
        return {}, text[m.end() :], f"front matter: {str(e).splitlines()[0][:150]}"
    fields: dict[str, str] = {}
    key = ""
    for line in (m[1] or "").splitlines():
        if item := re.match(r"\s*-\s+(.*)$", line):
            if key:
                inner = fields[key].strip("[]")
                fields[key] = f"[{inner}{', ' if inner else ''}{item[1].strip()}]"
            continue
        if pair := re.match(r"([^\s:#][^:]*):\s*(.*)$", line):
            key = pair[1].strip()
            if key in fields:
                return fields, text[m.end() :], f"duplicate key {key}"
            fields[key] = pair[2].strip().strip("\"'")
    return fields, text[m.end() :], ""


def markdown(files: DataFrame) -> DataFrame:
    """(path, title, tags, frontmatter, body, sha256, error) of (path, content)."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                fields, body, error = front_matter(bytes(content).decode("utf-8", "replace"))
                title = fields.get("title") or re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
                tags = [t.strip().strip("\"'") for t in fields.get("tags", "").strip("[]").split(",") if t.strip()]
                rows.append((path, title, tags, fields, body, error))
            yield pd.DataFrame(rows, columns=["path", "title", "tags", "frontmatter", "body", "error"])

    parsed = files.select("path", "content").mapInPandas(run, "path string, title string, tags array<string>, frontmatter map<string,string>, body string, error string")
    return parsed


class CsvError(ValueError):
    pass


def strict_csv(text: str) -> tuple[list[str], list[list[str]]]:
    """(headers, rows): headers trimmed, none empty or twice (case apart), every row of their number."""
    rows = list(csv.reader(io.StringIO(text, newline=""), strict=True))
    if not rows:
        raise CsvError("empty file")
    headers = [h.strip() for h in rows[0]]
    if any(not h for h in headers):
        raise CsvError("empty header")
    if len({h.lower() for h in headers}) < len(headers):
        raise CsvError("duplicate header")
    for n, r in enumerate(rows[1:], 2):
        if len(r) != len(headers):
            raise CsvError(f"row {n} has {len(r)} fields, expected {len(headers)}")
    return headers, rows[1:]


def read_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A CSV file or folder as columns of text; strict fails on a malformed row, otherwise it is kept in ``_malformed``."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    if strict:
        return reader.option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    names = reader.csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in [*names, "_malformed"])
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed").csv(path)


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All snapshots of a dataset with the file and place of each row."""
    rows = read_csv(spark, f"{folder}/*.csv")
    return rows.withColumns({"source_path": F.col("_metadata.file_path"), "row_number": F.monotonically_increasing_id()})


def csv_text(names: list[str]) -> Column:
    """A record as retrieval text: its fields joined by tabs."""
    return F.concat_ws("\t", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names))


class _Text(HTMLParser):
    BLOCKS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden.append(tag)
        elif tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    """The visible text of a page, blocks apart by an empty line."""
    p = _Text()
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(p.out))).strip()


def rtf_text(rtf: str) -> str:
    """The text of an RTF document: groups of tables and pictures out, escapes resolved."""
    rtf = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|pict|\*)(?:[^{}]|\{[^{}]*\})*\}", "", rtf)
    rtf = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), rtf)
    rtf = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), rtf)
    rtf = re.sub(r"\\(?:par|line)\b ?", "\n", re.sub(r"\\tab\b ?", "\t", rtf))
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", rtf)).strip()


def archive_text(data: bytes) -> str:
    """The text of an office or e-book archive: its XML parts in name order, within a budget of bytes."""
    out, budget = [], 100 << 20
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if not re.search(r"(word/document|content|slides/slide\d+|sharedStrings)\.xml$|\.x?html$", info.filename):
                continue
            budget -= info.file_size
            if info.file_size > MAX_BYTES or budget < 0:
                continue
            raw = z.read(info).decode("utf-8", "replace")
            if info.filename.endswith("html"):
                out.append(html_text(raw))
                continue
            parts = []
            for e in ElementTree.fromstring(raw.encode()).iter():
                if e.tag.rsplit("}", 1)[-1] in ("p", "si") and parts and parts[-1] != "\n":
                    parts.append("\n")
                if e.text and e.text.strip():
                    parts.append(e.text)
            out.append("".join(parts).strip())
    return "\n\n".join(x for x in out if x)


def kind_of(content: Column, path: Column) -> Column:
    """File type by its first bytes, else by its extension."""
    head = F.hex(F.substring(content, 1, 8))
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304"), F.when(ext.isin("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub"), ext).otherwise("zip"))
        .when(head.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(head.startswith("7B5C727466"), "rtf")
        .when(head.startswith("89504E47"), "png")
        .when(head.startswith("FFD8FF"), "jpg")
        .when(ext == "htm", "html")
        .otherwise(ext)
    )


def extract(files: DataFrame) -> DataFrame:
    """(path, kind, text, error) of (path, content); files over ``MAX_BYTES`` and unknown kinds give an error, not a failure."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for path, kind, content in zip(b["path"], b["kind"], b["content"], strict=True):
                data, text, error = bytes(content), None, ""
                try:
                    if len(data) > MAX_BYTES:
                        raise ValueError("too large")
                    if kind == "html":
                        text = html_text(data.decode("utf-8", "replace"))
                    elif kind == "rtf":
                        text = rtf_text(data.decode("latin-1"))
                    elif kind == "pdf":
                        from .pdf import pdf_pages

                        text = "\n\n".join(pdf_pages(data))
                    elif kind in ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub"):
                        text = archive_text(data)
                    elif kind in ("md", "txt", "csv", "json", "eml", ""):
                        text = data.decode("utf-8", "replace")
                    else:
                        raise ValueError(f"unsupported format {kind}")
                except Exception as e:  # noqa: BLE001  one bad file is a row with its error
                    error = str(e)[:200] or type(e).__name__
                rows.append((path, kind, text, error))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "error"])

    return files.select("path", kind_of(F.col("content"), F.col("path")).alias("kind"), "content").mapInPandas(run, "path string, kind string, text string, error string")


@F.pandas_udf(T.StringType())
def _html_text(html: pd.Series) -> pd.Series:
    return html.fillna("").map(html_text)


def page_text(html: Column | str) -> Column:
    ship(SparkSession.active())
    return _html_text(html)


EVENT = "id string, room string, author string, seq long, lamport long, ts string, kind string, body string, prev string"


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all authors' segments; a line that is no event fails the read."""
    lines = spark.read.text(f"{folder}/*.jsonl").where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("segment"))
    return lines.select("segment", F.from_json("value", EVENT, {"mode": "FAILFAST"}).alias("e"), F.sha2("value", 256).alias("hash")).select("segment", "e.*", "hash")


def activity(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """Activity events of a range of days; only the days' files are read."""
    import datetime as dt

    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    days = ",".join(str(a + dt.timedelta(days=i)) for i in range((b - a).days + 1))
    return spark.read.schema("ts string, event string, path string, title string").json(f"{folder}/{{{days}}}.ndjson")


#: Header names that contacts come with.
CONTACT_HEADERS = {
    "name": ("name", "full name", "display name", "fn"),
    "email": ("email", "e-mail", "e-mail 1 - value", "mail"),
    "phone": ("phone", "tel", "telephone", "mobile", "phone 1 - value"),
    "organization": ("organization", "organisation", "company", "org"),
}


def map_headers(df: DataFrame, aliases: dict[str, tuple[str, ...]] = CONTACT_HEADERS) -> DataFrame:
    """Columns renamed to what they mean, case apart; unknown ones are kept."""
    by = {a: k for k, names in aliases.items() for a in names}
    return df.withColumnsRenamed({c: by[c.strip().lower()] for c in df.columns if c.strip().lower() in by})


def vcards(text: str) -> list[dict[str, str]]:
    """The cards of a vCard file: folded lines joined, first value of each property."""
    out: list[dict[str, str]] = []
    card: dict[str, str] | None = None
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        name, _, value = line.partition(":")
        key = name.split(";")[0].upper().rsplit(".", 1)[-1]
        if key == "BEGIN":
            card = {}
        elif key == "END" and card is not None:
            out.append(card)
            card = None
        elif card is not None and value:
            card.setdefault({"FN": "name", "EMAIL": "email", "TEL": "phone", "ORG": "organization", "UID": "source"}.get(key, key.lower()), value.replace("\\,", ",").replace("\\n", "\n").strip())
    return out
