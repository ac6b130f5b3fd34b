"""Text analysis: the German token pipeline, words for ranking, SimHash, links, tags and headings."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .scalar import MARKED, PLAIN, fold

# Stop words of the German analyzer.
STOP_WORDS = (
    "aber", "alle", "allem", "allen", "aller", "alles", "als", "also", "am", "an", "auch", "auf", "aus", "bei", "bin", "bis", "bist", "da", "dabei", "dadurch", "dafür", "daher", "damit",
    "danach", "dann", "das", "dass", "davon", "dazu", "dem", "den", "denn", "der", "des", "die", "dies", "diese", "diesem", "diesen", "dieser", "dieses", "doch", "dort", "du", "durch", "ein",
    "eine", "einem", "einen", "einer", "eines", "einige", "er", "es", "für", "gegen", "hat", "haben", "hier", "ich", "im", "in", "ist", "ja", "jede", "jedem", "jeden", "jeder", "jedes", "kein",
    "keine", "mit", "nach", "nicht", "noch", "nur", "oder", "ohne", "sehr", "sie", "sind", "so", "über", "um", "und", "uns", "unter", "vom", "von", "vor", "war", "waren", "was", "weil",
    "weiter", "welche", "wenn", "wer", "wie", "wieder", "will", "wir", "wird", "wo", "zu", "zum", "zur",
)
# Suffixes the stemmer cuts, the first that fits, where four characters remain.
SUFFIXES = ("lichkeit", "igkeit", "heit", "keit", "isch", "lich", "ung", "end", "ern", "em", "er", "en", "es", "e", "s")


def _stemmed(folded: Column) -> Column:
    out = folded
    for s in reversed(SUFFIXES):
        out = F.when(folded.endswith(s) & (F.length(folded) - len(s) >= 4), F.substring(folded, F.lit(1), F.length(folded) - len(s))).otherwise(out)
    return out


def german_tokens(text: Column) -> Column:
    """Distinct stems of a text in order: lower-cased, trimmed to letters and digits, stop words out."""
    raw = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    kept = F.filter(raw, lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    # folded in a step of its own: the stemmer reads each word many times
    folded = F.transform(kept, lambda w: F.replace(F.translate(w, "äöü", "aou"), F.lit("ß"), F.lit("ss")))
    return F.array_distinct(F.filter(F.transform(folded, _stemmed), lambda w: w != ""))


def may_hold_stem(text: Column, stem: str) -> Column:
    """Whether a text can have a token that begins with a stem: a cheap test before the token pipeline."""
    return F.replace(F.translate(F.lower(text), "äöü", "aou"), F.lit("ß"), F.lit("ss")).contains(stem)


def words(text: Column) -> Column:
    """Words as the ranking index sees them: runs of letters and digits, case and marks folded."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


@lru_cache(maxsize=1 << 17)
def fnv1a64(word: str) -> int:
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a32(word: str) -> int:
    h = 0x811C9DC5
    for b in word.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


_WORD_CHARS = f"a-z0-9{MARKED}"


def word_pattern(word: str, prefix: bool = False) -> str:
    """A pattern that finds a folded word (or what begins with it) in a lower-cased text: what folding would do is in its classes."""
    letters = "".join(f"[{c}{''.join(m for m, p in zip(MARKED, PLAIN, strict=True) if p == c)}]" for c in word)
    return rf"(?<![{_WORD_CHARS}]){letters}" + ("" if prefix else rf"(?![{_WORD_CHARS}])")


def n_words(low: Column) -> Column:
    """How many ``words`` a lower-cased text has, without making them."""
    return F.regexp_count(low, F.lit(f"[{_WORD_CHARS}]+"))


def fnv64(text: Column | str) -> Column:
    """FNV-1a of a text's UTF-8 bytes, 64 bits as a signed number; null for null."""
    ship(SparkSession.active())

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else (fnv1a64(t) + 2**63) % 2**64 - 2**63).astype("Int64")

    return run(text)


def fnv32(text: Column | str) -> Column:
    """FNV-1a of a text's UTF-8 bytes, 32 bits without sign; null for null."""
    ship(SparkSession.active())

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fnv1a32(t)).astype("Int64")

    return run(text)


#: Words of at most so many bytes are hashed together, byte by byte; texts of about so many characters at a time.
_SHORT_WORD, _BLOCK = 64, 1 << 20


def _hashed(words: list[str]) -> np.ndarray:
    """``fnv1a64`` of every word."""
    data = " ".join(words).encode()
    raw = np.frombuffer(data + b" ", np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    down = -size[order]
    h = np.full(len(words), 0xCBF29CE484222325, np.uint64)
    at, prime = starts[order], np.uint64(0x100000001B3)
    for k in range(min(_SHORT_WORD, int(size.max(initial=0)))):
        n = int(np.searchsorted(down, -k, "left"))
        h[:n] = (h[:n] ^ raw[at[:n] + k]) * prime
    out = np.empty(len(words), np.uint64)
    out[order] = h
    for i in order[: int(np.searchsorted(down, -_SHORT_WORD, "left"))]:
        out[i] = fnv1a64(words[i])
    return out


def _simhashes(texts: list[str]) -> np.ndarray:
    """Signed 64-bit SimHashes of the texts' lower-cased words."""
    out, lo = np.zeros(len(texts), np.int64), 0
    while lo < len(texts):
        tokens, count, size, hi = [], [], 0, lo
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _BLOCK):
            own = texts[hi].lower().split()
            tokens += own
            count.append(len(own))
            size += len(texts[hi])
            hi += 1
        n = np.array(count)
        some = n > 0
        if some.any():
            bits = np.unpackbits(_hashed(tokens).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = (np.cumsum(n) - n)[some]
            votes = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            out[lo:hi][some] = np.packbits(2 * votes > n[some][:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
        lo = hi
    return out


def simhash_of(text: str) -> int:
    """Signed 64-bit SimHash of a text's lower-cased words."""
    return int(_simhashes([text])[0])


@F.pandas_udf(T.LongType())
def _simhash(texts: pd.Series) -> pd.Series:
    return pd.Series(_simhashes(texts.fillna("").tolist()))


def simhash(text: Column | str) -> Column:
    """SimHash of a text column; there is no built-in for its word hash, so it runs in Arrow batches."""
    ship(SparkSession.active())
    return _simhash(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column, short: Column | None = None) -> Column:
    """Percent of equal bits; at most 50 where ``short`` says that a text is too short to tell."""
    score = F.floor((64 - hamming(a, b)) * 100 / 64).cast("int")
    return score if short is None else F.when(short, F.least(score, F.lit(50))).otherwise(score)


def strip_code(md: Column) -> Column:
    """Markdown without fenced blocks and code spans."""
    return F.regexp_replace(F.regexp_replace(md, r"(?ms)^```.*?^```[ \t]*$", ""), r"`[^`\n]*`", "")


def wikilinks(md: Column) -> Column:
    """Distinct ``[[target]]``s in order, without alias and heading."""
    raw = F.regexp_extract_all(strip_code(md), F.lit(r"\[\[([^\]\[|#\n]+)[^\]\[\n]*\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda t: F.trim(t)), lambda t: t != ""))


def markdown_links(md: Column) -> Column:
    """Distinct local ``[text](target)`` targets, without fragment; images and addresses with a scheme are left out."""
    raw = F.regexp_extract_all(strip_code(md), F.lit(r"(?<!!)\[[^\]\n]*\]\(([^)\s#]+)[^)\n]*\)"), F.lit(1))
    return F.array_distinct(F.filter(raw, lambda t: ~t.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")))


def inline_tags(md: Column) -> Column:
    """Distinct ``#tag``s, case apart, outside code, addresses and headings, not all digits."""
    plain = F.regexp_replace(strip_code(md), r"[a-zA-Z][a-zA-Z0-9+.-]*://\S+", "")
    raw = F.regexp_extract_all(plain, F.lit(r"(?<![\p{L}\p{N}_/#&])#([\p{L}\p{N}_/-]*[\p{L}_][\p{L}\p{N}_/-]*)"), F.lit(1))
    return F.array_distinct(F.transform(raw, F.lower))


def format_metadata(fields: dict[str, Column]) -> Column:
    """``name: value`` lines of the fields that have a value."""
    return F.concat_ws("\n", *(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}: "), c)) for n, c in fields.items()))


def match_metadata(fields: dict[str, Column], wanted: str) -> Column:
    """Whether ``name:value`` holds of the fields, case apart; an unknown name holds of nothing."""
    name, _, value = wanted.partition(":")
    c = fields.get(name.strip().lower())
    return F.lit(False) if c is None else F.coalesce(F.lower(c) == value.strip().lower(), F.lit(False))


def strip_metadata(query: Column, names: list[str]) -> Column:
    """A query without its ``name:value`` words."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, rf"(?i)(?<!\S)(?:{'|'.join(names)}):\S*", " "), r"\s+", " "))


def unknown_citations(answer: Column, sources: Column) -> Column:
    """Distinct ``[n]`` of an answer, outside code, that name none of its ``sources`` (numbered from 1), ascending."""
    raw = F.transform(F.regexp_extract_all(strip_code(answer), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("long"))
    return F.array_sort(F.array_distinct(F.filter(raw, lambda n: (n < 1) | (n > sources))))


def alias_list(raw: Column) -> Column:
    """Aliases from ``[a, b]``, ``a, b`` or one value."""
    inner = F.regexp_replace(F.trim(raw), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")
