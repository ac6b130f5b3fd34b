"""Structured dataset queries: filter, project or group, sort, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_number, parse_bool, parse_date
from .predicates import compile_all
from .spec import Aggregate, DatasetQuery, Schema, SpecError


def _aggregate(a: Aggregate, schema: Schema) -> Column:
    fn = a.function.strip().lower()
    if fn == "count":
        c = F.count("*") if not a.column else F.count(schema.column(a.column))
    elif fn in ("sum", "average", "avg", "min", "max"):
        col = F.col(schema.column(a.column))
        c = {"sum": F.sum, "average": F.avg, "avg": F.avg, "min": F.min, "max": F.max}[fn](col.cast("double") if fn in ("sum", "average", "avg") else col)
    else:
        raise SpecError(f'unsupported aggregate "{a.function}"')
    return c.alias(a.name)


def filtered(df: DataFrame, schema: Schema, q: DatasetQuery, strict: bool = False) -> DataFrame:
    return df.where(compile_all(q.filters, q.group, schema, strict))


def query(df: DataFrame, schema: Schema, q: DatasetQuery, strict: bool = False) -> DataFrame:
    """The page that ``q`` asks for."""
    rows = filtered(df, schema, q, strict)
    limit, offset = q.page
    if q.group_by or q.aggregates:
        aggregates = [_aggregate(a, schema) for a in q.aggregates or (Aggregate("count"),)]
        if not q.group_by:
            return rows.agg(*aggregates)
        by = schema.column(q.group_by)
        out = rows.groupBy(by).agg(*aggregates).orderBy(F.col(by).asc_nulls_first())
    else:
        order = [F.col(schema.column(s.key)).asc_nulls_last() if s.ascending else F.col(schema.column(s.key)).desc_nulls_last() for s in q.sorts]
        columns = list(dict.fromkeys(schema.column(c) for c in q.columns)) or sorted(schema.types)
        # the order may need columns that the projection drops
        out = rows.orderBy(*order, schema.key).offset(offset).limit(limit).select(*columns)
        return out
    return out.offset(offset).limit(limit)


def total(df: DataFrame, schema: Schema, q: DatasetQuery) -> DataFrame:
    """One row: matching rows, or groups, before the page is cut; what the page holds; whether it was cut."""
    rows = filtered(df, schema, q)
    limit, offset = q.page
    if q.group_by:
        rows = rows.select(schema.column(q.group_by)).distinct()
    n = F.count("*") if q.group_by or not q.aggregates else F.lit(1).cast("long")
    left = F.greatest(F.lit(0).cast("long"), F.least(F.lit(limit).cast("long"), F.col("total_rows") - offset))
    return rows.agg(n.alias("total_rows")).select("total_rows", left.alias("returned_rows"), (F.col("total_rows") > offset + left).alias("capped"))


def group_count(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The groups with their sizes, the number of groups and whether the list is cut."""
    groups = df.groupBy(column).agg(F.count("*").alias("count"))
    n = groups.agg(F.count("*").alias("total_groups"))
    page = groups.orderBy(F.col(column).asc_nulls_first()).limit(limit)
    return page.join(F.broadcast(n)).withColumn("capped", F.col("total_groups") > limit)


def infer_types(df: DataFrame) -> DataFrame:
    """(column, type) of columns of text: checkbox, number, date or text, over their non-empty values.

    Booleans come before numbers, so a column of 0 and 1 is a checkbox.
    """
    names = df.columns
    cells = []
    for n in names:
        v = F.col(n)
        filled = F.coalesce(v, F.lit("")) != ""
        for k, ok in (("b", parse_bool(v).isNotNull()), ("n", is_number(v)), ("d", parse_date(v).isNotNull())):
            cells.append(F.coalesce(F.bool_and(F.when(filled, ok)), F.lit(False)).alias(f"{n}|{k}"))
    one = df.agg(*cells)
    kinds = [F.struct(F.lit(n).alias("column"), F.when(F.col(f"`{n}|b`"), "checkbox").when(F.col(f"`{n}|n`"), "number").when(F.col(f"`{n}|d`"), "date").otherwise("text").alias("type")) for n in names]
    return one.select(F.explode(F.array(*kinds)).alias("x")).select("x.column", "x.type")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: later snapshots win, within one the later row."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_sl_rank", F.row_number().over(w)).where("_sl_rank = 1").drop("_sl_rank")


def coverage(df: DataFrame, dates: list[str]) -> DataFrame:
    """First and last of each row's first date that is there."""
    d = F.coalesce(*(F.col(c) for c in dates))
    return df.agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"))


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, case apart; the least spelling of each, sorted."""
    return df.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("_sl")).agg(F.min(column).alias("option")).select("option")
