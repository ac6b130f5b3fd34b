"""Event logs of several authors: total order, verification, projections; and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("lamport", "ts", "author", "seq", "id")


def merged(events: DataFrame, limit: int | None = None) -> DataFrame:
    """All authors' events in their total order."""
    out = events.orderBy(*ORDER)
    return out if limit is None else out.limit(limit)


def verify(lines: DataFrame) -> DataFrame:
    """(author, seq, finding): breaks in (author, line_no, seq, hash, prev): seq is not its place, prev is not the hash of the line before, a seq occurs twice."""
    w = Window.partitionBy("author").orderBy("line_no")
    seen = lines.withColumn("place", F.row_number().over(w)).withColumn("before", F.lag("hash").over(w)).withColumn("times", F.count("*").over(Window.partitionBy("author", "seq")))
    checks = {
        "seq_mismatch": F.col("seq") != F.col("place"),
        "chain_broken": ~F.coalesce("prev", F.lit("")).eqNullSafe(F.coalesce("before", F.lit(""))),
        "fork_detected": F.col("times") > 1,
    }
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return seen.select("author", "line_no", "seq", F.explode(found).alias("finding"))


def stats(events: DataFrame) -> DataFrame:
    """Per author: events, last sequence number, largest clock and the hash of the last line."""
    return events.groupBy("author").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"), F.max("lamport").alias("lamport"), F.max_by("hash", "seq").alias("last_hash"))


def last_state(events: DataFrame, key: str) -> DataFrame:
    """The last event of each key in the total order: a fold in which each event replaces the state."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in ORDER))
    return events.withColumn("_sl_r", F.row_number().over(w)).where("_sl_r = 1").drop("_sl_r")


def projected(events: DataFrame, kind: str, schema: str, keys: list[str]) -> DataFrame:
    """The events of a kind as rows: ``keys`` and the fields of their JSON body; bodies that are none are left out."""
    body = F.from_json("body", schema)
    return events.where(F.col("kind") == kind).withColumn("_sl_b", body).where(F.col("_sl_b").isNotNull()).select(*keys, "_sl_b.*")


def members(events: DataFrame) -> DataFrame:
    """(member, role) after all events (kind: member_added, role_changed, member_removed; member; role)."""
    return last_state(events.where(F.col("kind").isin("member_added", "role_changed", "member_removed")), "member").where("kind <> 'member_removed'").select("member", "role")


def query_log(events: DataFrame, invalid: DataFrame, *, kinds: list[str] | None = None, author: str | None = None, since=None, until=None, run: str | None = None, limit: int = 50) -> DataFrame:
    """Valid events by kind, author, time and the run named in their body."""
    rows = events.join(invalid.select("id"), "id", "left_anti")
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    if author:
        rows = rows.where(F.lower("author") == author.lower())
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    if until is not None:
        rows = rows.where(F.col("ts") <= until)
    if run is not None:
        rows = rows.where(F.get_json_object("body", "$.run_id") == run)
    return merged(rows, limit)


def overlap_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Each segment (id, track, start, end) with the turn (speaker, track, start, end) that overlaps it most, all that overlap, and the share covered.

    Both sides are dealt to the time buckets of ``width`` that they touch; a pair counts in the bucket where its overlap begins.
    """

    def buckets(d: DataFrame) -> DataFrame:
        return d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))

    a = buckets(left.where("end > start"))
    b = buckets(right.where("end > start")).select("speaker", F.col("track").alias("bt"), F.col("start").alias("bs"), F.col("end").alias("be"), F.col("bucket").alias("bb"))
    first = F.greatest("start", "bs")
    cond = (F.col("track") == F.col("bt")) & (F.col("bucket") == F.col("bb")) & (F.col("bs") < F.col("end")) & (F.col("start") < F.col("be")) & (F.floor(first / width) == F.col("bucket"))
    both = a.join(b, cond).withColumn("overlap", F.least("end", "be") - F.greatest("start", "bs"))
    per = both.groupBy("id", "start", "end", "speaker").agg(F.sum("overlap").alias("overlap"))
    best = per.groupBy("id", "start", "end").agg(F.min(F.struct((-F.col("overlap")).alias("neg"), "speaker")).alias("m"), F.array_sort(F.collect_set("speaker")).alias("speakers"))
    return best.select("id", F.col("m.speaker").alias("speaker"), (-F.col("m.neg")).alias("overlap"), F.array_join("speakers", ",").alias("speakers"), F.round(-F.col("m.neg") / (F.col("end") - F.col("start")), 6).alias("confidence"))
