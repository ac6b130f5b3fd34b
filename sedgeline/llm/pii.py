"""Personal data: patterns find protected values, corpus co-occurrence finds terms that give them away.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers, leftmost
and non-overlapping per kind; a match that fails its check (parts, digits, Luhn) is dropped.

The method adds terms. Each distinct protected value c is an entity; its information is
IC(c) = ln(N / n(c)) over the N documents. A term t discloses
PMI(t; c) = ln(N * n(t, c) / (n(t) * n(c))) of it, where n counts the documents that hold t, c
or both, anywhere in their texts. If PMI(t; c) reaches ``DISCLOSURE`` of IC(c) and the two are not
together by chance, reading t nearly tells c: every occurrence of t becomes a span of kind
``term``. By chance n(t, c) documents or more hold both with a probability of at most
exp(-n(t) * KL(n(t, c) / n(t), n(c) / N)), or the same with t and c exchanged; the smaller of the two must
be ``CHANCE`` at most after multiplication with the number of terms that stand in a document with a value.
``sanitized`` generalises base spans to their kind and removes such terms.

Spans of kind ``secret`` are runs of ``SECRET`` letters and digits or more that hold both: even of 16 possible
characters each, such a run carries 128 bits, more than any word or number that is not a key.

Words inside e-mail addresses are no terms of their document. Native throughout: DataFrame and SQL expressions only. The patterns use possessive
quantifiers and start only where a run starts, so they are linear on hostile texts.

Defined cases: a null text counts as empty, its sanitized text is null. Rows that repeat an id are
one document for the counts and each get their own spans. Overlapping spans of different kinds are
all reported; the sanitized text replaces the one that starts first. Result columns replace columns of those names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small

KINDS = ("email", "ip", "card", "phone")
SECRET = 32
_BLOCK = 64
CHANCE, DISCLOSURE = 0.05, 0.8
RESULT = ("spans", "terms", "sanitized")

_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    # a local part starts where its run starts, or where the match before ended
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_SECRET = rf"(?<![A-Za-z0-9])(?=[0-9]*+[A-Za-z])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{{{SECRET},}}+"
_TERM = r"\p{L}[\p{L}\p{N}]{2,}"
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, where a lambda would compute it again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: Column) -> Column:
    """Spans (code points, end exclusive) of all matches: what lies between them is what ``split`` returns."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.array().cast(_SPAN)
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))

    # in blocks, so that growing arrays are short however many matches a text has
    def blocked(ps: Column) -> Column:
        parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(ps) - 1) / _BLOCK).cast("int")))
        return F.transform(parts, lambda i: F.slice(ps, i * _BLOCK + 1, F.lit(_BLOCK)))

    def grown(acc: Column, block: Column) -> Column:
        width = F.aggregate(block, F.lit(0).cast("long"), lambda n, p: n + F.length(p["gap"]) + F.length(p["value"]))
        return F.concat(acc, F.array(F.element_at(acc, -1) + width))

    def spans(block: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), none.alias("spans"))

        def step(acc: Column, pair: Column) -> Column:
            first = acc["at"] + F.length(pair["gap"])
            end = first + F.length(pair["value"])
            span = F.array(F.struct(first.alias("start"), end.alias("end"), pair["value"].alias("value")))
            return F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans"))

        return F.aggregate(block, start, step, lambda a: a["spans"])

    def every(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(F.lit(0).cast("long")), grown)
        return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), spans))

    return _let(_let(pairs, blocked), every)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, 2 * d).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = F.transform(F.split(value, "[.]"), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when((F.length(digits) >= 16) & (F.length(digits) <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        n = F.length(F.regexp_replace(value, "[^0-9]", ""))
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _holds(kind: str):
    return lambda s: _valid(kind, s["value"])


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind an array of (start, end, value); texts that cannot hold a kind are not searched for it."""
    text = F.coalesce(text, F.lit(""))
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][ -]?[0-9]"), "phone": text.contains("+")}
    out = {}
    for kind in KINDS:
        got = F.filter(_matches(text, F.lit(_PATTERNS[kind])), _holds(kind))
        out[kind] = F.when(may[kind], got).otherwise(F.array().cast(_SPAN))
    return out


def _terms(text: Column) -> Column:
    """Distinct lower-cased terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TERM), F.lit(0)), F.lower))


def _surprise(draws: Column, hits: Column, share: Column) -> Column:
    """-ln of the bound on the chance that ``hits`` or more of ``draws`` fall on a ``share`` below hits / draws of all documents."""
    a = hits / draws
    rest = F.when(a < 1, (1 - a) * F.ln((1 - a) / (1 - share))).otherwise(0.0)
    return F.when(a > share, draws * (a * F.ln(a / share) + rest)).otherwise(0.0)


def disclosing_terms(spans: DataFrame, docs: DataFrame, id: str, text: str, scratch: Scratch) -> DataFrame | None:
    """(term) that gives a protected value away, or None if no value stands in enough documents.

    ``spans``: (id, value) of every base span.
    """
    ids = docs.select(F.struct(F.col(id).alias("id")).alias("id"))
    n = float(ids.distinct().count())
    repeats = ids.count() > n
    held = scratch.put(spans.select(F.struct("id").alias("id"), "value").distinct())
    if not held.head(1):
        return None
    # only e-mail addresses hold letters
    outside = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _PATTERNS["email"], " ")
    holders = docs.select(F.struct(F.col(id).alias("id")).alias("id"), outside.alias("text")).join(small(held.select("id").distinct()), "id", "left_semi")
    stand = scratch.put(holders.select("id", F.explode(_terms(F.col("text"))).alias("term")).distinct())
    tests = max(1, stand.select("term").distinct().count())
    least = math.log(tests / CHANCE)
    # the surprise of a pair is at most that of two that are always together
    n_c = held.groupBy("value").agg(F.count("*").alias("n_c")).where(F.col("n_c") * F.ln(n / F.col("n_c")) >= least * (1 - 1e-9))
    # t is in as many documents at most, if it is in all of c's
    most = F.col("n_c") * F.pow(n / F.col("n_c"), 1 - DISCLOSURE) * (1 + 1e-12)
    values = scratch.put(held.join(n_c.withColumn("most", most), "value"))
    if not values.head(1):
        return None
    tops = values.groupBy("id").agg(F.max("most").alias("top"))
    stand = scratch.put(stand.join(small(tops), "id"))
    words = docs.select(F.struct(F.col(id).alias("id")).alias("id"), F.explode(_terms(F.col(text))).alias("term"))
    words = words.join(small(stand.select("term").distinct()), "term", "left_semi")
    n_t = (words.distinct() if repeats else words).groupBy("term").agg(F.count("*").alias("n_t"))
    n_t = scratch.put(n_t.where(F.col("n_t") * F.ln(n / F.col("n_t")) >= least * (1 - 1e-9)))
    rare = stand.join(small(n_t), "term").where("n_t <= top").select("id", "term", "n_t")
    pairs = rare.join(values, "id").where("n_t <= most").groupBy("value", "term").agg(F.count("*").alias("n_tc"), F.first("n_t").alias("n_t"), F.first("n_c").alias("n_c"))
    told = F.col("n_t") <= F.col("n_tc") * F.pow(n / F.col("n_c"), 1 - DISCLOSURE) * (1 + 1e-12)
    surprise = F.greatest(_surprise(F.col("n_t"), F.col("n_tc"), F.col("n_c") / n), _surprise(F.col("n_c"), F.col("n_tc"), F.col("n_t") / n))
    return scratch.put(pairs.where(told & (surprise >= least)).select("term").distinct())


def _of_kind(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def find_personal_data(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (map from kind to its spans: the base ones and ``secret``), ``terms`` (spans of disclosing terms) and ``sanitized``."""
    scratch = Scratch(docs.sparkSession, "pii")
    names = [c for c in docs.columns if c not in RESULT]
    rows = docs.select(*names)
    kinds = base_spans(F.col(text))
    every = F.concat(*(F.transform(kinds[k], _of_kind(k)) for k in KINDS))
    beside = rows.select(F.col(id).alias("id"), F.explode(every).alias("s"))
    value = F.concat_ws(":", "s.kind", F.lower("s.value"))
    beside = scratch.put(beside.select("id", value.alias("value")))
    terms = disclosing_terms(beside, rows, id, text, scratch)
    none = F.array().cast(_SPAN)
    if terms is None or not terms.head(1):
        found = rows.withColumn("terms", none)
    else:
        words = rows.select(F.col(id).alias("_sl_id"), F.explode(_terms(F.col(text))).alias("term"))
        held = words.join(small(terms), "term", "left_semi").groupBy("_sl_id").agg(F.array_sort(F.collect_set("term")).alias("_sl_terms"))
        held = scratch.put(held)
        scratch.keep(held)
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("_sl_terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
        joined = rows.join(small(held, 100_000), F.col(id).eqNullSafe(F.col("_sl_id")), "left")
        spans = F.when(F.col("_sl_terms").isNotNull(), _matches(F.coalesce(text, F.lit("")), pattern)).otherwise(none)
        found = joined.withColumn("terms", spans).drop("_sl_id", "_sl_terms")
    whole = F.coalesce(text, F.lit(""))
    secrets = F.when(whole.rlike(_SECRET), _matches(whole, F.lit(_SECRET))).otherwise(none)
    found = found.withColumn("spans", F.create_map(*(x for k in KINDS for x in (F.lit(k), kinds[k])), F.lit("secret"), secrets))
    return found.withColumn("sanitized", _sanitized(F.col(text))).select(*names, *RESULT)


def _replaced(by: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(by).alias("by"))


def _sanitized(text: Column) -> Column:
    """The text with its spans generalised to their kind, and its terms removed."""
    marked = F.concat(
        *(F.transform(F.col("spans")[k], _replaced(f"<{k.upper()}>")) for k in (*KINDS, "secret")),
        F.transform("terms", _replaced("")),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, s["by"]))).otherwise(acc["out"]).alias("out"))

    # pieces are gathered and joined once
    done = F.aggregate(F.array_sort(marked), start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(marked) > 0, done).otherwise(text)


def listed(kind: str, spans: Column) -> Column:
    """The spans as ``kind:start:end`` texts."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
