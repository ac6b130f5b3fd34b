"""Saved views: a source, filters, formulas and rollups, columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import template
from .predicates import compile_group, view_filter
from .spec import MAX_ROWS, Filter, Group, SpecError


@dataclass
class View:
    """``source``: ``all``, ``tag:x``, ``notebook:a,b`` or the beginning of a path. ``rollups``: name -> (function, property) over linked rows.

    Without a ``limit`` a view has all its rows; one that is asked for is at most ``MAX_ROWS``.
    """

    id: str
    source: str = "all"
    filters: tuple[Filter, ...] = ()
    group: Group | None = None
    formulas: dict[str, str] = field(default_factory=dict)
    rollups: dict[str, tuple[str, str]] = field(default_factory=dict)
    columns: tuple[str, ...] = ()
    limit: int | None = None


def source_rows(docs: DataFrame, source: str) -> DataFrame:
    if source == "all":
        return docs
    if source.startswith("tag:"):
        return docs.where(F.array_contains(F.transform("tags", F.lower), source[4:].lower()))
    if source.startswith("notebook:"):
        return docs.where(F.col("path").isin(source[9:].split(",")))
    return docs.where(F.col("path").startswith(source))


def run(docs: DataFrame, view: View, links: DataFrame | None = None) -> DataFrame:
    """The rows of a view in path order, computed columns from the stored ones; ``links`` (src, dst) serve the rollups."""
    rows = source_rows(docs, view.source)
    for name, (fn, key) in view.rollups.items():
        if links is None:
            raise SpecError("rollups need links")
        linked = links.join(docs.select(F.col("path").alias("dst"), F.col(key).alias("v") if key else F.lit(1).alias("v")), "dst")
        agg = {"count": F.count("*"), "sum": F.round(F.sum("v"), 2), "list": F.concat_ws(", ", F.array_sort(F.collect_list(F.col("v").cast("string"))))}.get(fn)
        if agg is None:
            raise SpecError(f'unsupported rollup "{fn}"')
        rows = rows.join(linked.groupBy(F.col("src").alias("path")).agg(agg.alias(name)), "path", "left")
    columns = {c: F.col(c) for c in rows.columns}
    rows = rows.withColumns({n: template(p, columns) for n, p in view.formulas.items()}) if view.formulas else rows

    def one(f: Filter):
        return view_filter(f, F.col(f.key).cast("string") if f.key in rows.columns else F.lit(None).cast("string"))

    for f in view.filters:
        rows = rows.where(one(f))
    rows = rows.where(compile_group(view.group, one))
    ordered = rows.orderBy("path")
    page = ordered if view.limit is None else ordered.limit(min(view.limit, MAX_ROWS))
    return page.select(*(view.columns or rows.columns))


#: Levels from the least to the most sensitive (fixed values).
LEVELS = ("public", "internal", "confidential", "restricted")


def check_export(view: View, datasets: dict[str, str], maximum: str = "") -> None:
    """Refuses to export a dataset's view (source ``dataset:slug``) above the configured level, ``internal`` by default.

    ``datasets``: slug -> sensitivity; what is unknown there is restricted. Views of other sources are not restricted.
    """
    kind, colon, slug = view.source.strip().partition(":")
    if kind != "dataset" or not colon:
        return
    slug = slug.strip()
    if not slug:
        raise SpecError("dataset export requires a dataset slug")
    if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", slug):
        raise SpecError(f'dataset slug "{slug}" is not filesystem-safe')
    if slug not in datasets:
        raise SpecError(f'dataset "{slug}" not found')
    most = maximum.strip().lower() or "internal"
    if most not in LEVELS:
        raise SpecError(f'invalid dataset sensitivity "{most}"')
    own = datasets[slug] if datasets[slug] in LEVELS else "restricted"
    if LEVELS.index(own) > LEVELS.index(most):
        raise SpecError(f"export denied: dataset {slug} is {own}, at most {most}")


def described(datasets: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(slug, rows, first_date, last_date) of datasets given with their date column, in slug order."""
    found = []
    for slug in sorted(datasets):
        rows, column = datasets[slug]
        day = F.lit(None).cast("date") if column is None else F.col(column).cast("date")
        found.append(rows.agg(F.count("*").alias("rows"), F.min(day).alias("first_date"), F.max(day).alias("last_date")).select(F.lit(slug).alias("slug"), "*"))
    return reduce(DataFrame.unionByName, found)


def dataset_rows(rows: DataFrame, key: str, formulas: dict[str, str], rollups: list[str], limit: int = MAX_ROWS) -> DataFrame:
    """A dataset's rows in key order with computed columns; datasets have no links, so their rollups are empty."""
    columns = {c: F.col(c) for c in rows.columns}
    return rows.withColumns({n: template(p, columns) for n, p in formulas.items()} | {n: F.lit("") for n in rollups}).orderBy(key).limit(min(limit, MAX_ROWS))


def guard(levels: list[str], allowed: str) -> None:
    """Refuses an export that holds more sensitive data than allowed."""
    rank = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}
    top = max((rank.get(x, 3) for x in levels), default=0)
    if top > rank.get(allowed, 0):
        raise SpecError("export is more sensitive than allowed")
