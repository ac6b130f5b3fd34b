"""Contacts: import planning, timelines, follow-ups, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASONS = ("source", "email", "phone", "name")


def import_plan(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(row, person, reason) for each incoming row: the known person it repeats, by source, else email, phone, name; no person means create.

    Each reason is an equi-join; the first reason of a row wins, then the least person.
    """
    legs = []
    for k, reason in enumerate(REASONS):
        keyed = known.where(F.coalesce(reason, F.lit("")) != "").groupBy(F.col(reason).alias("k")).agg(F.min("person").alias("person"))
        legs.append(incoming.where(F.coalesce(reason, F.lit("")) != "").join(keyed, F.col(reason) == F.col("k")).select("row", "person", F.lit(k).alias("rank")))
    best = reduce(DataFrame.unionByName, legs).groupBy("row").agg(F.min(F.struct("rank", "person")).alias("m"))
    named = best.select("row", "m.person", F.element_at(F.array(*(F.lit(r) for r in REASONS)), F.col("m.rank") + 1).alias("reason"))
    return incoming.select("row").join(named, "row", "left")


def contact_timeline(interactions: DataFrame, follow_ups: DataFrame, person: int, limit: int) -> DataFrame:
    """Interactions and follow-ups of a person, newest first."""
    a = interactions.where(F.col("person") == person).select("ts", F.lit("interaction").alias("kind"), "id")
    b = follow_ups.where(F.col("person") == person).select("ts", F.lit("follow_up").alias("kind"), "id")
    return a.unionByName(b).orderBy(F.col("ts").desc(), "kind", "id").limit(limit)


def due(follow_ups: DataFrame, state: str, now: Column) -> DataFrame:
    """Follow-ups that are open, overdue, upcoming, or all."""
    c = {"all": F.lit(True), "open": ~F.col("done"), "overdue": ~F.col("done") & (F.col("due") < now), "upcoming": ~F.col("done") & (F.col("due") >= now)}[state]
    return follow_ups.where(c)


def page(rows: DataFrame, name: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page by name, case apart, with one row more if there is more."""
    return rows.orderBy(F.lower(name), key).offset(max(0, offset)).limit(min(max(1, limit), 200) + 1)


def last_interaction(interactions: DataFrame) -> DataFrame:
    w = Window.partitionBy("person").orderBy(F.col("ts").desc(), F.col("id").desc())
    return interactions.withColumn("_sl_r", F.row_number().over(w)).where("_sl_r = 1").drop("_sl_r")


def next_number(used: DataFrame, column: str) -> DataFrame:
    """The least positive integer that is not used: 1, or the first gap; found by a lead over distinct numbers."""
    n = used.where(F.col(column) > 0).select(F.col(column).cast("long").alias("n")).distinct()
    follow = n.select((F.col("n") + 1).alias("n")).union(used.sparkSession.range(1, 2).select(F.col("id").alias("n")))
    return follow.join(n, "n", "left_anti").agg(F.min("n").alias("next"))
