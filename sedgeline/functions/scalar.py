"""Scalar functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters with marks and what they fold to.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"

#: Timestamp layouts a dataset accepts.
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss.SSSSSS")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def fold(c: Column) -> Column:
    """Lower-case, without marks; texts without marked letters are not translated character by character."""
    low = F.lower(c)
    return F.when(low.rlike(f"[{MARKED}]"), F.translate(low, MARKED, PLAIN)).otherwise(low)


def parse_date(c: Column) -> Column:
    """A timestamp without zone from any accepted layout, else null."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in DATE_LAYOUTS))


def is_number(c: Column) -> Column:
    """Digits with single underscores between them, sign, fraction, exponent, inf or nan."""
    return c.rlike(r"^[+-]?((\d+(_\d+)*)(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))$")


def parse_number(c: Column) -> Column:
    return F.when(is_number(c), F.regexp_replace(c, "_", "").try_cast("double"))


def render_number(c: Column) -> Column:
    """Integral values without a fraction."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def parse_bool(c: Column) -> Column:
    return F.when(F.lower(c).isin("true", "t", "1"), True).when(F.lower(c).isin("false", "f", "0"), False)


def slugify(c: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def property_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_-]+", "_"), "^_+|_+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normalize_text(c: Column) -> Column:
    """One kind of space and newline, no runs of blanks, at most one empty line in a row."""
    c = F.regexp_replace(c, " ", " ")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


#: Words that follow a hyphen at a line end without belonging to it.
_COORDINATORS = ("und", "oder", "bzw", "sowie", "and", "or")


def dehyphenate(c: Column) -> Column:
    """Joins words broken at line ends: letter, hyphen, newline, small letter; not before a coordinator."""
    ahead = "|".join(_COORDINATORS)
    return F.regexp_replace(c, rf"(?<=\p{{L}})-\n(?=\p{{Ll}})(?!(?:{ahead})\b)", "")


#: Signal words of the two languages that are told apart.
GERMAN = ("der", "die", "das", "und", "ist", "nicht", "mit", "für", "von", "den", "wird", "werden", "auf", "ein", "eine", "zu", "wir", "sie", "im")
ENGLISH = ("the", "and", "is", "of", "to", "in", "for", "with", "that", "this", "are", "not", "was", "be", "will", "we", "you", "from")


def language(c: Column) -> Column:
    """``deu``, ``eng`` or empty, by signal words of a text of 20 words or more; marked German letters count three."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]+"), F.lit(0))
    deu = F.size(F.filter(words, lambda w: w.isin(*GERMAN))) + F.when(c.rlike("[äöüßÄÖÜ]"), 3).otherwise(0)
    eng = F.size(F.filter(words, lambda w: w.isin(*ENGLISH)))
    return F.when(F.size(words) < 20, "").when(deu >= eng * 1.5, F.when(deu >= 3, "deu").otherwise("")).when(eng >= deu * 1.5, F.when(eng >= 3, "eng").otherwise("")).otherwise("")


def contact_value(kind: Column, value: Column) -> Column:
    """The comparable form of a contact point."""
    v = F.trim(value)
    phone = F.concat(F.when(v.startswith("+"), "+").otherwise(""), F.regexp_replace(v, "[^0-9]", ""))
    url = F.regexp_replace(F.regexp_replace(F.lower(v), "^https?://(www\\.)?", ""), "/+$", "")
    return (
        F.when(kind == "phone", phone)
        .when(kind == "url", url)
        .when(kind == "handle", F.regexp_replace(F.lower(v), "^@", ""))
        .when(kind == "address", F.regexp_replace(F.lower(v), "\\s+", " "))
        .otherwise(F.lower(v))
    )


def clock(ms: Column, fraction: str = ".") -> Column:
    """hh:mm:ss.mmm of milliseconds."""
    return F.format_string(f"%02d:%02d:%02d{fraction}%03d", (ms / 3_600_000).cast("long"), (ms / 60_000 % 60).cast("long"), (ms / 1000 % 60).cast("long"), (ms % 1000).cast("long"))


def row_hash(names: list[str]) -> Column:
    """SHA-256 over the sorted ``len:name=len:value`` records of a row; lengths in bytes, nulls as empty."""
    parts = []
    for n in sorted(names):
        v = F.coalesce(F.col(n).cast("string"), F.lit(""))
        parts += [F.lit(f"{len(n.encode())}:{n}="), F.octet_length(v).cast("string"), F.lit(":"), v, F.lit("\n")]
    return F.sha2(F.concat(*parts), 256)


def row_key(identity: Column, names: list[str]) -> Column:
    return F.when(F.coalesce(identity.cast("string"), F.lit("")) != "", F.concat(F.lit("identity:"), identity.cast("string"))).otherwise(F.concat(F.lit("hash:"), row_hash(names)))


def sensitivity_rank(c: Column) -> Column:
    return F.when(c == "public", 0).when(c == "internal", 1).when(c == "confidential", 2).otherwise(3)


def redact(c: Column) -> Column:
    """Addresses and long digit runs masked."""
    return F.regexp_replace(F.regexp_replace(c, r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+", "[email]"), r"\+?[0-9][0-9 ()/-]{6,}[0-9]", "[number]")


def template(pattern: str, columns: dict[str, Column]) -> Column:
    """``{key}`` replaced by the column's text; an unknown or null one is empty."""
    parts = []
    for literal, key in re.findall(r"([^{]*)(?:\{([^{}]*)\})?", pattern):
        if literal:
            parts.append(F.lit(literal))
        if key:
            parts.append(F.coalesce(columns[key].cast("string"), F.lit("")) if key in columns else F.lit(""))
    return F.concat(*parts) if parts else F.lit("")


def path_template(pattern: str, columns: dict[str, Column], date: Column | None = None) -> Column:
    """A storage path: ``{field}`` and ``{date:%Y}``; an empty field is ``unknown``, and separators within fields become hyphens."""
    strftime = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm"}
    parts = []
    for literal, key in re.findall(r"([^{]*)(?:\{([^{}]*)\})?", pattern):
        if literal:
            parts.append(F.lit(literal))
        if not key:
            continue
        if key.startswith("date:"):
            form = re.sub("%.", lambda m: strftime.get(m[0], m[0]), key[5:])
            v = F.date_format(date, form) if date is not None else F.lit(None)
        else:
            v = columns[key].cast("string") if key in columns else F.lit(None)
            v = F.regexp_replace(F.trim(v), r"[\\/:*?\"<>|]+", "-")
        parts.append(F.when(F.coalesce(v, F.lit("")) == "", "unknown").otherwise(v))
    return F.concat(*parts)
