"""Document metadata: listing, review, timelines, retention, rules, annotation, near copies by SimHash."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def docs_list(files: DataFrame, *, kind: str | None = None, status: str | None = None, person: str | None = None, year: int | None = None, due_before: str | None = None, confidence: tuple[int, int] | None = None) -> DataFrame:
    """Documents by metadata; what is not given does not restrict."""
    c: list[Column] = []
    if kind is not None:
        c.append(F.col("type") == kind)
    if status is not None:
        c.append(F.col("status") == status)
    if person is not None:
        c.append(F.col("person") == person)
    if year is not None:
        c.append(F.col("document_date").cast("string").startswith(str(year)))
    if due_before is not None:
        c.append(F.col("due_date") < F.lit(due_before).cast("date"))
    if confidence is not None:
        c.append(F.col("confidence").between(*confidence))
    return files.where(reduce(lambda a, b: a & b, c, F.lit(True)))


def review(files: DataFrame, threshold: int = 70) -> DataFrame:
    """Documents to look at, with the reasons: little confidence, no type, no date; ignored ones are left out."""
    checks = {"low_confidence": F.col("confidence") < threshold, "missing_type": F.col("type").isNull(), "missing_date": F.col("document_date").isNull()}
    reasons = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda r: r.isNotNull())
    return files.withColumn("reasons", reasons).where((F.size("reasons") > 0) & ~F.coalesce("review_ignored", F.lit(False)))


def timeline(parts: dict[str, DataFrame], first: dt.datetime, last: dt.datetime, limit: int) -> DataFrame:
    """(ts, kind, action, path) of all sources in a range, each event once, in time order."""
    every = reduce(DataFrame.unionByName, [d.select("ts", F.lit(k).alias("kind"), "action", "path") for k, d in parts.items()])
    inside = every.where(F.col("ts").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    return inside.dropDuplicates(["ts", "kind", "action", "path"]).orderBy("ts", "kind", "action", "path").limit(limit)


def retention(files: DataFrame, *, kind: str | None, tags: list[str], period_days: int, now: dt.datetime) -> DataFrame:
    """Documents that match all selectors and whose period has passed."""
    c = F.lit(True)
    if kind is not None:
        c = c & (F.col("type") == kind)
    if tags:
        c = c & (F.size(F.array_except(F.array(*(F.lit(t) for t in tags)), "tags")) == 0)
    expiry = F.col("document_date") + F.make_dt_interval(F.lit(period_days))
    return files.where(c).withColumn("expires", expiry).where(F.col("expires") <= F.lit(now).cast("timestamp_ntz"))


def classify(docs: DataFrame, rules: list[tuple[str, str, str]], text: Column) -> DataFrame:
    """Rules (pattern, kind, value) in order: of scalar kinds the first that fits wins, tags are gathered; patterns are substrings, case folded."""
    low = F.lower(text)
    out = docs
    for kind in dict.fromkeys(k for _, k, _ in rules):
        mine = [F.when(low.contains(p.lower()), F.lit(v)) for p, k, v in rules if k == kind]
        out = out.withColumn(kind, F.array_distinct(F.filter(F.array(*mine), lambda v: v.isNotNull())) if kind == "tags" else F.coalesce(*mine))
    return out


def dry_run(docs: DataFrame, rule: tuple[str, str, str], text: Column) -> DataFrame:
    """The documents that a rule would set, with the ``value`` it sets; nothing is written."""
    pattern, _, value = rule
    return docs.where(F.lower(text).contains(pattern.lower())).withColumn("value", F.lit(value))


def rewrite_tags(docs: DataFrame, renamed: dict[str, str], deleted: list[str] = []) -> DataFrame:  # noqa: B006
    """``docs`` with its ``tags`` renamed (several to one name merges them) and deleted, case apart, and the ``status`` of each row."""
    by = {k.lower(): v for k, v in renamed.items()}
    names = F.create_map(*(F.lit(x) for kv in by.items() for x in kv)) if by else F.create_map().cast("map<string,string>")
    gone = F.array(*(F.lit(t.lower()) for t in deleted)).cast("array<string>")
    new = F.array_distinct(F.transform(F.filter("tags", lambda t: ~F.array_contains(gone, F.lower(t))), lambda t: F.coalesce(F.try_element_at(names, F.lower(t)), t)))
    same = F.array_sort(new) == F.array_sort(F.array_distinct("tags"))
    return docs.withColumn("_sl_new", new).withColumn("status", F.when(same, "unchanged").otherwise("changed")).drop("tags").withColumnRenamed("_sl_new", "tags")


def annotate(docs: DataFrame, id: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(id, field, value): distinct matches of each field's pattern."""
    if not patterns:
        return docs.select(id, F.lit("").alias("field"), F.lit("").alias("value")).limit(0)
    found = [docs.select(id, F.lit(f).alias("field"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))).alias("value")) for f, p in patterns.items()]
    return reduce(DataFrame.unionByName, found)


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) of the nodes of (a, b): the least node that can be reached."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "least").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = step.join(far, "next").select("node", "label", F.least("next", "far").alias("next")).checkpoint()
        labels = moved.select("node", F.col("next").alias("label"))
        if not moved.where("label <> next").head(1):
            break
    return labels


def pruned_versions(versions: DataFrame, keep: int, cutoff: dt.datetime) -> DataFrame:
    """Versions to delete: beyond the newest ``keep`` of a path or before ``cutoff``; the newest always stays."""
    w = Window.partitionBy("path").orderBy(F.col("ts").desc(), F.col("version").desc())
    ranked = versions.withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("rank") > 1) & ((F.col("rank") > keep) | (F.col("ts") < F.lit(cutoff).cast("timestamp_ntz"))))
