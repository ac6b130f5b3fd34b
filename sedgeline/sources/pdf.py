"""Text of PDF files page by page: objects and object streams, deflated contents, fonts with a map to Unicode.

Encrypted files, and contents in other filters, are errors; text that is only drawn (scans) is none.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship
from .files import MAX_BYTES

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|[\[\]]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)


def _literal(raw: bytes) -> bytes:
    """The bytes of a string token."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m: re.Match) -> bytes:
        e = m[1]
        if e[:1].isdigit() and e[:1] < b"8":
            return bytes([int(e, 8) & 255])
        return b"" if e in (b"\n", b"\r\n") else _ESCAPES.get(e, e)

    return _ESCAPED.sub(one, raw[1:-1])


def _objects(data: bytes) -> dict[int, bytes]:
    """Number -> source of every object, those inside object streams too; of several versions the last counts."""
    out = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
    for source in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm", source):
            inner = _content(source)
            n, first = (int(re.search(rb"/%s\s+(\d+)" % k, source)[1]) for k in (b"N", b"First"))
            head = [int(x) for x in inner[:first].split()[: 2 * n]]
            ends = [*head[3::2], len(inner) - first]
            for number, at, end in zip(head[::2], head[1::2], ends, strict=True):
                out.setdefault(number, inner[first + at : first + end])
    return out


def _content(source: bytes) -> bytes:
    """The decoded stream of an object."""
    m = _STREAM.search(source)
    if not m:
        return b""
    named = re.search(rb"/Filter\s*(\[[^\]]*\]|/\w+)", source[: m.start()])
    filters = re.findall(rb"/(\w+)", named[1]) if named else []
    data = m[1]
    for f in filters:
        if f not in (b"FlateDecode", b"Fl"):
            raise ValueError(f"unsupported filter {f.decode()}")
        data = zlib.decompressobj().decompress(data)
    return data


def _refs(source: bytes, key: bytes) -> list[int]:
    """The objects that an entry refers to, in order."""
    m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, source)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _pages(objects: dict[int, bytes], data: bytes) -> list[int]:
    """Page objects in reading order."""
    roots = [r for s in [*objects.values(), *re.findall(rb"trailer(.*?)startxref", data, re.S)] for r in _refs(s, b"Root")]
    catalog = next((objects[r] for r in roots if r in objects), b"")
    out, todo, seen = [], _refs(catalog, b"Pages"), set()
    while todo:
        n = todo.pop(0)
        source = objects.get(n, b"")
        if n in seen or not source:
            continue
        seen.add(n)
        if re.search(rb"/Type\s*/Page(?![A-Za-z])", source):
            out.append(n)
        else:
            todo = _refs(source, b"Kids") + todo
    return out or sorted(n for n, s in objects.items() if re.search(rb"/Type\s*/Page(?![A-Za-z])", s))


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    """Code -> text of a map to Unicode."""
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            start = text(c)
            for i in range(min(65536, int(b, 16) - int(a, 16) + 1)):
                out[(int(a, 16) + i).to_bytes(len(a) // 2, "big")] = start[:-1] + chr(ord(start[-1]) + i)
    return out


def _fonts(page: bytes, objects: dict[int, bytes]) -> dict[bytes, dict[bytes, str]]:
    """Font name -> its map to Unicode, for the fonts of a page that have one."""
    resources = b" ".join([page, *(objects.get(n, b"") for n in _refs(page, b"Resources"))])
    resources = b" ".join([resources, *(objects.get(n, b"") for n in _refs(resources, b"Font"))])
    out = {}
    for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", resources):
        for u in _refs(objects.get(int(n), b""), b"ToUnicode"):
            out[name] = _unicode_map(_content(objects.get(u, b"")))
    return out


def _shown(raw: bytes, codes: dict[bytes, str] | None) -> str:
    if not codes:
        return raw.decode("cp1252", "replace")
    width = max(map(len, codes))
    return "".join(codes.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def _text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """What the text operators of a page show: a move to another line is a newline, a wide gap a blank."""
    out: list[str] = []
    args: list[bytes] = []
    codes = None
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/+-.0123456789":
            args.append(token)
            continue
        strings = [a for a in args if a[:1] in b"(<"]
        if token == b"Tf":
            codes = next((fonts.get(a[1:]) for a in args if a[:1] == b"/"), None)
        elif token in (b"Tj", b"'", b'"') and strings:
            out += ["\n"] * (token != b"Tj") + [_shown(_literal(strings[-1]), codes)]
        elif token == b"TJ":
            for a in args:
                if a[:1] in b"(<":
                    out.append(_shown(_literal(a), codes))
                elif a[:1] not in b"[]/" and float(a) < -200:
                    out.append(" ")
        elif token in (b"T*", b"ET") or token in (b"Td", b"TD") and args and float(args[-1]) != 0 or token == b"Tm":
            out.append("\n")
        args = []
    return re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out))).strip()


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("encrypted")
    objects = _objects(data)
    out = []
    for n in _pages(objects, data):
        page = objects[n]
        content = b"\n".join(_content(objects.get(c, b"")) for c in _refs(page, b"Contents"))
        out.append(_text(content, _fonts(page, objects)))
    return out


def pages(files: DataFrame) -> DataFrame:
    """(path, page, anchor, text, error) of (path, content): one row per page; a file that cannot be read is one row with its error."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    data = bytes(content or b"")
                    if len(data) > MAX_BYTES:
                        raise ValueError("too large")
                    rows += [(path, i, f"page:{i}", t, "") for i, t in enumerate(pdf_pages(data), 1)]
                except Exception as e:  # noqa: BLE001  one bad file is a row with its error
                    rows.append((path, None, None, None, str(e)[:200] or type(e).__name__))
            out = pd.DataFrame(rows, columns=["path", "page", "anchor", "text", "error"])
            out["page"] = out["page"].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(run, "path string, page int, anchor string, text string, error string")
