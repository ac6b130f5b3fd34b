"""Full-text search: an inverted index of words, BM25, and the legs and filters around it."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ascii_lower, base_name, extension, fold
from ..functions.text import german_tokens, may_hold_stem, n_words, word_pattern, words

K1, B = 1.2, 0.75
FIELDS = {"tag": "tag", "path": "path", "status": "status", "type": "type", "index": "index", "index_status": "index", "filename": "filename", "filetype": "filetype", "created": "created", "modified": "modified"}
_LAST = {"day": 1, "week": 7, "month": 30, "year": 365}


class SearchError(ValueError):
    pass


@dataclass
class Term:
    value: str
    phrase: bool = False
    negated: bool = False


@dataclass
class Plan:
    filters: list[tuple[str, str, bool]] = field(default_factory=list)
    terms: list[Term] = field(default_factory=list)
    regexes: list[tuple[str, bool]] = field(default_factory=list)

    @property
    def structured(self) -> bool:
        """Whether the plan needs more than ranked plain words."""
        return bool(self.filters or self.regexes or any(t.phrase or t.negated for t in self.terms))


def parse(query: str) -> Plan:
    """Words, "phrases" with backslash escapes, /expressions/, -negation and field:value."""
    plan, i, n = Plan(), 0, len(query)
    while i < n:
        if query[i].isspace():
            i += 1
            continue
        negated = query[i] == "-"
        if negated:
            i += 1
            if i == n or query[i].isspace():
                raise SearchError("negation must be followed by a term")
        if query[i] in '"/':
            quote, start, got = query[i], i, []
            kind = "quoted phrase" if quote == '"' else "regular expression"
            i += 1
            while i < n and query[i] != quote:
                if query[i] == "\\" and i + 1 < n:
                    got.append(query[i + 1] if quote == '"' else query[i : i + 2])
                    i += 2
                else:
                    got.append(query[i])
                    i += 1
            if i == n:
                raise SearchError(f"unterminated {kind} at offset {start}")
            i += 1
            value = "".join(got)
            if not value.strip():
                raise SearchError(f"empty {kind} at offset {start}")
            if quote == "/":
                try:
                    re.compile(value)
                except re.error as e:
                    raise SearchError(f"invalid regular expression: {e}") from e
                plan.regexes.append((value, negated))
            else:
                plan.terms.append(Term(value, True, negated))
            continue
        m = re.match(r"\S+", query[i:])
        word = m[0]
        name, colon, value = word.partition(":")
        if colon and re.fullmatch(r"\w+", name):
            if name not in FIELDS:
                raise SearchError(f'unknown search operator "{name}:"')
            if not value:
                raise SearchError(f'operator "{name}:" requires a value')
            if value == "last" and (more := re.match(r"\S+ +(day|week|month|year)\b", query[i:])):
                value, word = f"last {more[1]}", more[0]
            if FIELDS[name] in ("created", "modified"):
                for part in value.split(","):
                    date_range(part, dt.datetime(2000, 1, 1))
            plan.filters.append((FIELDS[name], value, negated))
        else:
            plan.terms.append(Term(word, False, negated))
        i += len(word)
    return plan


def date_range(value: str, reference: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """First and last instant of a day, ``a..b``, an instant, or the ``last`` day, week, month or year before ``reference``."""
    if m := re.fullmatch(r"last (day|week|month|year)", value):
        return reference - dt.timedelta(days=_LAST[m[1]]), reference
    first, dots, last = value.partition("..")
    try:
        if not dots and "T" in value:
            at = dt.datetime.fromisoformat(re.sub(r"(\.\d{6})\d*", r"\1", value).replace("Z", "+00:00")).astimezone(dt.UTC).replace(tzinfo=None)
            return at, at
        a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last if dots else first)
    except ValueError:
        raise SearchError(f'invalid date "{value}" (use YYYY-MM-DD or YYYY-MM-DD..YYYY-MM-DD)') from None
    return dt.datetime.combine(a, dt.time.min), dt.datetime.combine(b, dt.time.max)


def postings(docs: DataFrame, id: str, text: Column) -> DataFrame:
    """(term, id, tf, dl): the inverted index; written bucketed by term it serves any number of searches."""
    tokens = docs.select(F.col(id).alias("id"), words(text).alias("ws"))
    return tokens.select("id", F.size("ws").alias("dl"), F.explode("ws").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id: str, text: Column, terms: list[str]) -> DataFrame:
    """(id, score) of the documents that hold every term; larger is better.

    Words are counted by patterns on the lower-cased text, so no text is split or translated; only what holds
    every term is counted in full. Without terms every document has a score of 0.
    """
    wanted = list(dict.fromkeys(terms))
    low = docs.select(F.col(id).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    held = [F.col("low").rlike(word_pattern(t)) for t in wanted]
    stats = low.agg(F.count("*").alias("n"), F.avg(n_words(F.col("low"))).alias("avgdl"), *(F.sum(h.cast("long")).alias(f"df{i}") for i, h in enumerate(held)))
    tf = [F.regexp_count("low", F.lit(word_pattern(t))).alias(f"tf{i}") for i, t in enumerate(wanted)]
    hits = low.where(reduce(and_, held, F.lit(True))).select("id", n_words(F.col("low")).alias("dl"), *tf).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf_, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        score = score + idf * tf_ * (K1 + 1) / (tf_ + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.select("id", score.alias("score"))


def three_legs(docs: DataFrame, id: str, text: Column, query: str) -> DataFrame:
    """(id, score): raw words by BM25, stems by prefix, and substrings of three letters or more; best score of each document, nulls last."""
    terms = [w for w in re.split(r"[^a-z0-9]+", query.lower()) if w]
    raw = bm25(docs, id, text, terms)
    spark = docs.sparkSession
    stems = spark.range(1).select(german_tokens(F.lit(query)).alias("s")).first()["s"]
    held = docs.where(reduce(and_, [may_hold_stem(text, s) for s in stems], F.lit(bool(stems))))
    by_stem = held.select(F.col(id).alias("id"), german_tokens(text).alias("ts")).where(reduce(and_, [F.exists("ts", _starts(s)) for s in stems], F.lit(bool(stems))))
    grams = [w for w in query.lower().split() if len(w) >= 3 and w.isalnum()]
    by_part = docs.select(F.col(id).alias("id"), fold(text).alias("t")).where(reduce(and_, [F.col("t").contains(g) for g in grams], F.lit(bool(grams))))
    none = F.lit(None).cast("double").alias("score")
    every = raw.unionByName(by_stem.select("id", none)).unionByName(by_part.select("id", none))
    return every.groupBy("id").agg(F.max("score").alias("score"))


def _starts(s: str):
    return lambda t: t.startswith(s)


def _any(value: str, one) -> Column:
    return reduce(or_, [one(v.strip()) for v in value.split(",")])


def filter_column(name: str, value: str, reference: dt.datetime) -> Column:
    """A field filter over columns path, status, type, index_status, tags, created, modified; a comma list is any of them."""
    if name == "path":
        return _any(value, lambda v: F.lower("path").contains(v.lower()))
    if name == "filename":
        return _any(value, lambda v: F.lower(base_name(F.col("path"))).contains(v.lower()))
    if name == "filetype":
        return _any(value, lambda v: extension(F.col("path")) == v.lower().removeprefix("."))
    if name == "tag":
        return _any(value, lambda v: F.array_contains(F.transform("tags", F.lower), v.lower()))
    if name == "index":
        return _any(value, lambda v: ascii_lower(F.coalesce("index_status", F.lit("indexed"))) == v.lower())
    if name in ("status", "type"):
        return _any(value, lambda v: ascii_lower(F.col(name)) == v.lower())

    def within(v: str) -> Column:
        a, b = date_range(v, reference)
        return F.col(name).between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))

    return _any(value, within)


def search(docs: DataFrame, query: str, reference: dt.datetime, *, scope: list[str] | None = None, limit: int = 20) -> DataFrame:
    """(path, title, score) of the best matches.

    A query that cannot be parsed is searched as plain words. Plain words rank by BM25 over title and
    body; phrases, negations, expressions and field filters restrict. ``scope``: path prefixes.
    """
    try:
        plan = parse(query)
    except SearchError:
        plan = Plan(terms=[Term(w) for w in re.findall(r"\w+", query)])
    text = F.concat_ws("\n", "title", "body")
    rows = docs
    for name, value, negated in plan.filters:
        c = F.coalesce(filter_column(name, value, reference), F.lit(False))
        rows = rows.where(~c if negated else c)
    if scope is not None:
        rows = rows.where(reduce(or_, [F.col("path").startswith(p) for p in scope], F.lit(False)))
    for pattern, negated in plan.regexes:
        c = text.rlike(pattern)
        rows = rows.where(~c if negated else c)
    for t in plan.terms:
        ws = [w for w in re.split(r"[^a-z0-9]+", t.value.lower()) if w]
        if t.phrase or t.negated:
            held = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" ")).contains(f" {' '.join(ws)} ")
            rows = rows.where(~held if t.negated else held)
    plain = [w for t in plan.terms if not t.phrase and not t.negated for w in re.split(r"[^a-z0-9]+", t.value.lower()) if w]
    if not plain:
        return rows.select("path", "title", F.lit(None).cast("double").alias("score")).orderBy("path").limit(limit)
    # statistics are those of all documents, so a filter does not change a document's score
    scored = bm25(docs, "path", text, plain).withColumnRenamed("id", "path")
    return rows.select("path", "title").join(scored, "path").orderBy(F.col("score").desc(), "path").limit(limit)


def snippet(text: Column, terms: list[str], width: int = 300) -> Column:
    """``width`` characters around the earliest term, else the beginning."""
    places = [F.when(F.locate(t, fold(text)) > 0, F.locate(t, fold(text))) for t in terms]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1))
    return F.substring(text, F.greatest(F.lit(1), first - width // 2), F.lit(width))


def weighted_search(docs: DataFrame, fields: dict[str, float], query: str, id: str, now: dt.datetime, changed: str) -> DataFrame:
    """Field-weighted prefix search: exact words count 1, longer ones that begin with the query word 0.6; recency adds up to 1.5."""
    wanted = [w for w in re.split(r"[^a-z0-9]+", query.lower()) if w]
    score, every = F.lit(0.0), []
    for w in wanted:
        best = F.lit(0.0)
        for name, weight in fields.items():
            low = F.lower(F.coalesce(name, F.lit("")))
            begins = low.rlike(word_pattern(w, prefix=True))
            best = best + weight * F.when(~begins, 0.0).when(low.rlike(word_pattern(w)), 1.0).otherwise(0.6)
        every.append(best > 0)
        score = score + best
    factor = 1.5 if len(wanted) > 1 else 1.0
    age = F.timestamp_diff("SECOND", F.col(changed), F.lit(now).cast("timestamp_ntz")) / 86400.0
    rows = docs.where(reduce(and_, every, F.lit(bool(wanted))))
    return rows.select(id, (score * factor + 1.5 * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / 30)).alias("score"))


def facets(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, count): distinct values, case apart, spelled as the least."""
    flat = [docs.select(F.lit(c).alias("facet"), F.col(c).alias("value")).where(F.coalesce(c, F.lit("")) != "") for c in columns]
    return reduce(DataFrame.unionByName, flat).groupBy("facet", F.lower("value").alias("_sl")).agg(F.min("value").alias("value"), F.count("*").alias("count")).drop("_sl")
