"""Links between documents: extraction, resolution, backlinks, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import base_name
from ..functions.text import markdown_links, wikilinks


def _bare(c):
    return F.regexp_replace(c, r"(?i)\.md$", "")


def links(docs: DataFrame, path: str, body: str) -> DataFrame:
    """(src, target, kind): distinct links as written."""
    b = F.coalesce(body, F.lit(""))
    wiki = docs.select(F.col(path).alias("src"), F.explode(wikilinks(b)).alias("target"), F.lit("wikilink").alias("kind"))
    plain = docs.select(F.col(path).alias("src"), F.explode(markdown_links(b)).alias("target"), F.lit("markdown").alias("kind"))
    return wiki.unionByName(plain).distinct()


def forms(nodes: DataFrame) -> DataFrame:
    """(form, level, path): what a node (path, title, aliases) may be called, best level first: path, base name, title, alias."""
    p = F.lower("path")
    names = F.array(
        F.struct(p.alias("form"), F.lit(0).alias("level")),
        F.struct(_bare(p).alias("form"), F.lit(1).alias("level")),
        F.struct(base_name(p).alias("form"), F.lit(2).alias("level")),
        F.struct(_bare(base_name(p)).alias("form"), F.lit(3).alias("level")),
        F.struct(F.lower("title").alias("form"), F.lit(4).alias("level")),
    )
    also = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lower(a).alias("form"), F.lit(5).alias("level")))
    return nodes.select("path", F.explode(F.concat(names, also)).alias("x")).select("x.form", "x.level", "path").where("form <> ''")


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, target, dst): the document each link means, the best level and then the least path; null if none.

    One answer a form is kept before the join, so a name that many documents share costs one row.
    """
    best = forms(nodes).groupBy("form").agg(F.min(F.struct("level", "path")).alias("m")).select("form", F.col("m.path").alias("dst"))
    wanted = edges.withColumn("form", F.lower(F.regexp_replace(F.trim("target"), r"^\./|^/", "")))
    return wanted.join(best, "form", "left").select("src", "target", "dst")


def graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct resolved edges (source, target) without self-links."""
    return resolve(edges, nodes).where("dst is not null and src <> dst").select(F.col("src").alias("source"), F.col("dst").alias("target")).distinct()


def backlinks(edges: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """Documents with a link that may mean ``path`` by any of its names."""
    names = forms(nodes.where(F.col("path") == path)).select("form").distinct()
    return edges.withColumn("form", F.lower("target")).join(F.broadcast(names), "form", "left_semi").select("src").distinct()


def broken(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links that mean no document."""
    return resolve(edges, nodes).where("dst is null").select("src", "target")


def inverse_relations(properties: DataFrame, target: str) -> DataFrame:
    """(path, key) of properties (path, key, value) that are ``target`` or hold ``[[target]]``."""
    v = F.lower("value")
    return properties.where((v == target.lower()) | v.contains(f"[[{target.lower()}]]")).select("path", "key").distinct()


def candidates(entities: DataFrame, text: str) -> DataFrame:
    """(entity) of (entity, name, aliases) whose name or alias is the text, case apart."""
    named = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower)
    return entities.where(F.array_contains(named, text.strip().lower())).select("entity")


def neighbours(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity) one edge (a, b) away from those found, in either direction, without them."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(found.select(F.col("entity").alias("a")), "a", "left_semi").select(F.col("b").alias("entity")).distinct()
    return near.join(found, "entity", "left_anti")


def mentions(docs: DataFrame, entities: DataFrame, text: Column) -> DataFrame:
    """(path, entity) of the entities (entity, name) whose name stands in a text, case apart.

    Joined by the name's first three characters, of which a text holds a bounded number; then the whole name is looked for.
    Shorter names are looked up by what they have. Empty names stand nowhere.
    """
    low = entities.select("entity", F.lower("name").alias("name")).where("name <> ''")
    low = low.withColumn("key", F.left("name", F.lit(3)))
    t = docs.select("path", F.lower(text).alias("t"))
    sizes = [r[0] for r in low.select(F.length("key")).distinct().collect()]
    # all overlapping pieces in one pass over the text
    pieces = [F.regexp_extract_all("t", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    keys = F.concat(*pieces) if pieces else F.array().cast("array<string>")
    # the pieces travel without their texts; only texts that hold a name's beginning are looked at again
    held = t.select("path", F.explode(F.array_distinct(keys)).alias("key")).join(low, "key").select("path", "entity", "name")
    return held.join(t, "path").where(F.col("t").contains(F.col("name"))).select("path", "entity").distinct()


def related(docs: DataFrame, entities: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(path, shared): other documents that mention an entity of ``path`` or one of its neighbours.

    ``entities`` (entity, name): names to look for; ``edges`` (a, b) between entities.
    """
    held = mentions(docs, entities, F.concat_ws("\n", "title", "body"))
    mine = mentions(docs.where(F.col("path") == path), entities, F.concat_ws("\n", "title", "body")).select("entity")
    near = mine.union(neighbours(mine, edges)).distinct()
    return held.where(F.col("path") != path).join(near, "entity", "left_semi").groupBy("path").agg(F.count("*").alias("shared"))


def rollup(rows: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """Per source the number, sum and list of the linked rows' values."""
    linked = edges.join(rows.select(F.col(key).alias("dst"), F.col(value).alias("v")), "dst")
    return linked.groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.concat_ws(", ", F.array_sort(F.collect_list(F.col("v").cast("string")))).alias("values"))
