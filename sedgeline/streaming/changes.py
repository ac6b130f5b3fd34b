"""Change streams: debounce, quiet periods, incremental refresh, a job queue, duplicate suppression.

Every streaming operator has a batch twin that computes the same result from a finished log, so results
can be checked. Windows by event time at the end are Spark's own; nothing of the kind is expected by callers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Operations as bits, and which of them names the event.
CREATE, WRITE, REMOVE = 1, 2, 4


def debounced(events: DataFrame, millis: int = 500) -> DataFrame:
    """Batch twin of the debounce: (path, ts, op) per burst.

    A burst of (path, ts, op) begins with its first event and takes all of the same path within ``millis`` of
    that first one; its operations are united, create before write before remove, and it has the first time stamp.
    No burst spans a pause of ``millis``, so what lies between pauses is dealt to tasks and folded there in time
    order, batch by batch, whatever one path has of it.
    """
    ship(events.sparkSession)
    w = Window.partitionBy("path").orderBy("ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    marked = events.select("path", "ts", "op", at.alias("at"), F.coalesce(at - F.lag(at).over(w) >= millis * 1000, F.lit(True)).cast("int").alias("new"))
    stretch = marked.withColumn("stretch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    dealt = stretch.repartition("path", "stretch").sortWithinPartitions("path", "stretch", "at")

    def fold(batches):
        import pandas as pd

        held = None  # path, stretch, first time, first time stamp, operations
        for b in batches:
            out = []
            for path, stretch_, t, ts, op in zip(b["path"], b["stretch"], b["at"], b["ts"], b["op"], strict=True):
                if held is not None and held[:2] == (path, stretch_) and t < held[2] + millis * 1000:
                    held = (*held[:4], held[4] | op)
                    continue
                if held is not None:
                    out.append((held[0], held[3], held[4]))
                held = (path, stretch_, t, ts, op)
            yield pd.DataFrame(out, columns=["path", "ts", "op"])
        if held is not None:
            yield pd.DataFrame([(held[0], held[3], held[4])], columns=["path", "ts", "op"])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    bursts = dealt.mapInPandas(fold, f"path {kinds['path']}, ts {kinds['ts']}, op int")
    return bursts.select("path", "ts", op_name(F.col("op")).alias("op"))


def op_name(bits):
    return F.when(bits.bitwiseAND(CREATE) > 0, "create").when(bits.bitwiseAND(WRITE) > 0, "write").otherwise("remove")


def debounce_stream(events: DataFrame, millis: int = 500) -> DataFrame:
    """The debounce over a stream of (path, ts, op): value state and a processing-time timer set by a burst's first event."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Debounce(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("burst", "ts timestamp, op int")

        def handleInputRows(self, key, rows, timerValues):
            ts, op = self.state.get() if self.state.exists() else (None, 0)
            fresh = ts is None
            for pdf in rows:
                for r in pdf.sort_values("ts").itertuples():
                    ts, op = ts if ts is not None else r.ts.to_pydatetime(), op | int(r.op)
            self.state.update((ts, op))
            if fresh:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + millis)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            ts, op = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"path": [key[0]], "ts": [pd.Timestamp(ts)], "op": [op]})

        def close(self):
            pass

    bursts = events.groupBy("path").transformWithStateInPandas(Debounce(), "path string, ts timestamp, op int", "Append", "ProcessingTime")
    return bursts.select("path", "ts", op_name(F.col("op")).alias("op"))


def quiet_periods(events: DataFrame, key: str, millis: int = 500) -> DataFrame:
    """(key, first, last, n): events less than ``millis`` apart are one period."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(w)
    marked = events.withColumn("_sl_new", (F.coalesce(gap, F.lit(1e9)) * 1000 >= millis).cast("int"))
    numbered = marked.withColumn("_sl_p", F.sum("_sl_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_sl_p").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("_sl_p")


def quiet_stream(events: DataFrame, key: str, gap: str = "500 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Quiet periods of a stream with time stamps ``ts``, closed once the watermark passes them."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, size, mtime, sha256): added, modified, touched (same content) or removed; unchanged files are left out."""
    a = now.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1"), F.col("sha256").alias("h1"))
    b = before.select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0"), F.col("sha256").alias("h0"))
    both = a.join(b, "path", "full_outer")
    what = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when((F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1")), None).when(F.col("h0") == F.col("h1"), "touched").otherwise("modified")
    return both.select("path", what.alias("change")).where("change is not null")


def claimable(jobs: DataFrame, now, limit: int = 1, *, attempts: int = 3, back_off: int = 10) -> DataFrame:
    """The oldest jobs to work on: pending, or failed fewer than ``attempts`` times and at least ``back_off`` seconds ago, or leased past their lease."""
    waited = F.col("updated_at") + F.make_dt_interval(secs=F.lit(back_off)) <= now
    retry = (F.col("status") == "failed") & (F.col("attempts") < attempts) & waited
    lost = (F.col("status") == "processing") & (F.col("lease_until") < now)
    return jobs.where((F.col("status") == "pending") | retry | lost).orderBy("created_at", "job_id").limit(limit)


def first_seen(items: DataFrame, key: str) -> DataFrame:
    """The first item (least ts, then id) of each key."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    return items.withColumn("_sl_r", F.row_number().over(w)).where("_sl_r = 1").drop("_sl_r")


def first_seen_stream(items: DataFrame, key: str, delay: str) -> DataFrame:
    """One item of each key within the watermark's delay, so state stays bounded."""
    return items.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def stable_files(sightings: DataFrame, quiet_seconds: int = 1) -> DataFrame:
    """(path, ts): when a file's size and time had not changed for ``quiet_seconds``, from its sightings (path, ts, size)."""
    w = Window.partitionBy("path").orderBy("ts")
    new = (F.coalesce(F.lag("size").over(w), F.lit(-1)) != F.col("size")).cast("int")
    run = sightings.withColumn("_sl_new", new)
    run = run.withColumn("_sl_run", F.sum("_sl_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    began = run.withColumn("_sl_began", F.min("ts").over(Window.partitionBy("path", "_sl_run")))
    quiet = F.col("ts").cast("timestamp").cast("double") - F.col("_sl_began").cast("timestamp").cast("double") >= quiet_seconds
    return began.where(quiet).groupBy("path").agg(F.min("ts").alias("ts"))


def windowed(events: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Extension of ours: counts by event-time window and type, late rows up to ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
