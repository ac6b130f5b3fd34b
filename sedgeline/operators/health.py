"""The health of a collection: findings about files, links, derived files and near copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_links, wikilinks
from .graph import broken


def findings(files: DataFrame, derived: DataFrame, times: DataFrame, copies: DataFrame) -> DataFrame:
    """(path, category, detail), by path and category.

    ``files``: path, title, frontmatter, body, error as ``sources.files.markdown`` gives them; ``derived``: path, source,
    source_mtime as of when it was made; ``times``: path, mtime now; ``copies``: representative, id.
    """
    nodes = files.select("path", "title", F.array().cast("array<string>").alias("aliases"))
    good = files.where("error = ''")

    def dead(links, category: str) -> DataFrame:
        edges = good.select(F.col("path").alias("src"), F.explode(links).alias("target"))
        return broken(edges, nodes).select(F.col("src").alias("path"), F.lit(category).alias("category"), F.col("target").alias("detail"))

    source = derived.join(times.select(F.col("path").alias("source"), "mtime"), "source", "left")
    parts = [
        files.where("error <> ''").select("path", F.lit("parse_error").alias("category"), F.col("error").alias("detail")),
        good.where(F.size("frontmatter") == 0).select("path", F.lit("missing_frontmatter").alias("category"), F.lit("").alias("detail")),
        dead(wikilinks(F.col("body")), "broken_wikilink"),
        dead(markdown_links(F.col("body")), "broken_markdown_link"),
        source.where("mtime is null").select("path", F.lit("orphaned_derived").alias("category"), F.col("source").alias("detail")),
        source.where("mtime > source_mtime").select("path", F.lit("stale_derived").alias("category"), F.col("source").alias("detail")),
        copies.select(F.col("id").alias("path"), F.lit("near_duplicate").alias("category"), F.col("representative").alias("detail")),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("path", "category", "detail")


def stores(catalog: DataFrame, used: DataFrame) -> DataFrame:
    """(store, state) of the side stores in ``catalog``: in use, or an orphan that may be pruned."""
    mine = used.select("store").distinct().withColumn("_sl_u", F.lit(True))
    return catalog.select("store").distinct().join(mine, "store", "left").select("store", F.when(F.col("_sl_u"), "in use").otherwise("orphan").alias("state"))
