"""State that follows from logs: runs and checkpoints, retention decisions, versions, purges, leases, memberships, hash chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .journal import ORDER

#: Run events in the state machine, the state each leads to, and the fields it needs (fixed values).
RUN_EVENTS = {
    "run.requested": ("requested", ("run_id", "title", "plan_file", "adapter")),
    "run.approved": ("approved", ("run_id", "approval_id", "scope", "expires_at")),
    "run.denied": ("denied", ("run_id", "reason")),
    "run.started": ("started", ("run_id",)),
    "run.finished": ("finished", ("run_id", "summary")),
    "run.failed": ("failed", ("run_id", "error")),
    "run.cancelled": ("cancelled", ("run_id", "reason")),
}
CHECKPOINT_EVENTS = {"checkpoint.requested": ("requested", ("checkpoint_id", "run_id", "question")), "checkpoint.resolved": ("resolved", ("checkpoint_id", "answer"))}


def _body(key: str) -> Column:
    return F.get_json_object("body", f"$.{key}")


def _machine(events: DataFrame, kinds: dict[str, tuple[str, tuple[str, ...]]], opens: str, key: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per ``key``: the fold of its well-formed events in their total order; what comes before it was opened is ignored.

    A later opening event starts anew. ``fields``: column -> (body field, kinds that set it).
    """
    state = F.coalesce(*(F.when((F.col("kind") == k) & F.forall(F.array(*(_body(f).isNotNull() for f in need)), lambda x: x), s) for k, (s, need) in kinds.items()))
    rows = events.where(F.col("kind").isin(*kinds)).withColumn("state", state).withColumn(key, _body(key)).where(F.col("state").isNotNull() & (F.col(key) != ""))
    order = Window.partitionBy(key).orderBy(*ORDER)
    # events since the last opening; a window without frame per key is bounded by the key's own events
    rows = rows.withColumn("_sl_n", F.sum((F.col("kind") == opens).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*ORDER)
    last = rows.groupBy(key).agg(F.max("_sl_n").alias("_sl_last"))
    rows = rows.join(last, key).where((F.col("_sl_n") == F.col("_sl_last")) & (F.col("_sl_n") > 0))
    folded = [F.max_by(F.nullif(_body(f), F.lit("")), F.when(F.col("kind").isin(*ks) & _body(f).isNotNull(), at)).alias(c) for c, (f, ks) in fields.items()]
    return rows.groupBy(key).agg(F.max_by("state", at).alias("state"), F.min_by("author", at).alias("author"), F.min_by("ts", at).alias("created_at"), F.max_by("ts", at).alias("updated_at"), *folded)


def runs(events: DataFrame, approvers: DataFrame | None = None) -> DataFrame:
    """(run_id, state, author, created_at, updated_at, title, adapter, approval_id, error, summary); approvals of others than ``approvers`` (author) count for nothing."""
    if approvers is not None:
        ok = approvers.select("author").distinct().withColumn("_sl_ok", F.lit(True))
        events = events.join(ok, "author", "left").where((F.col("kind") != "run.approved") | F.coalesce("_sl_ok", F.lit(False))).drop("_sl_ok")
    fields = {"title": ("title", ("run.requested",)), "adapter": ("adapter", ("run.requested",)), "approval_id": ("approval_id", ("run.approved",)), "summary": ("summary", ("run.finished",))}
    out = _machine(events, RUN_EVENTS, "run.requested", "run_id", fields)
    return out


def pending_runs(found: DataFrame) -> DataFrame:
    return found.where(F.col("state").isin("requested", "approved")).orderBy("created_at", "run_id")


def checkpoints(events: DataFrame) -> DataFrame:
    """(checkpoint_id, state, author, created_at, updated_at, run_id, question, answer)."""
    fields = {"run_id": ("run_id", ("checkpoint.requested",)), "question": ("question", ("checkpoint.requested",)), "answer": ("answer", ("checkpoint.resolved",))}
    return _machine(events, CHECKPOINT_EVENTS, "checkpoint.requested", "checkpoint_id", fields)


def retention_state(due: DataFrame, history: DataFrame) -> DataFrame:
    """(doc_id, state): what is due is proposed, accepted or rejected by its last history entry (doc_id, action_id, action, ts); repeated action ids count once."""
    once = history.groupBy("action_id").agg(F.min(F.struct("ts", "doc_id", "action")).alias("h")).select("action_id", "h.*")
    last = once.groupBy("doc_id").agg(F.max_by("action", F.struct("ts", "action_id")).alias("action"))
    state = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected").otherwise("proposed")
    return due.join(last, "doc_id", "left").select("doc_id", state.alias("state"))


def versions(changes: DataFrame) -> DataFrame:
    """(path, ts, blob, version) of (path, ts, content): content-addressed; a change that leaves the content as it was is no version."""
    w = Window.partitionBy("path").orderBy("ts", "blob")
    named = changes.withColumn("blob", F.sha2("content", 256))
    fresh = named.withColumn("_sl_p", F.lag("blob").over(w)).where(~F.col("blob").eqNullSafe(F.col("_sl_p")))
    return fresh.select("path", "ts", "blob", F.row_number().over(w).alias("version"))


def restored(found: DataFrame, at) -> DataFrame:
    """(path, blob): each path's version as of ``at``; paths that had none are left out."""
    return found.where(F.col("ts") <= at).groupBy("path").agg(F.max_by("blob", F.struct("ts", "version")).alias("blob"))


def undone(found: DataFrame, steps: int = 1) -> DataFrame:
    """(path, blob): each path as it was ``steps`` versions ago; paths with fewer versions go to their first."""
    last = found.groupBy("path").agg(F.max("version").alias("n"))
    return found.join(last, "path").where(F.col("version") == F.greatest(F.lit(1), F.col("n") - steps)).select("path", "blob")


def unreferenced(blobs: DataFrame, kept: DataFrame) -> DataFrame:
    """Blobs that no kept version refers to."""
    return blobs.select("blob").distinct().join(kept.select("blob"), "blob", "left_anti")


PURGE_STEPS = ("rows", "snapshots", "views", "handle")


def purge(tables: dict[str, DataFrame], slug: str, done: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of the tables (each with ``slug``) and the journal (step, state) after a purge that resumes where ``done`` (step) ends.

    Steps run in order; a step in the journal is not run again.
    """
    finished = {r["step"] for r in done.select("step").distinct().collect()}
    left = {n: t if n in finished else t.where(F.col("slug") != slug) for n, t in tables.items()}
    steps = [(i, s, "skipped" if s in finished else "purged") for i, s in enumerate(PURGE_STEPS)]
    return left, done.sparkSession.createDataFrame(steps, "place int, step string, state string")


def replace_chunks(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Chunks of ``old`` with those of the documents in ``new`` replaced; new ones carry the index's next generation."""
    top = old.agg(F.coalesce(F.max("generation"), F.lit(0)).alias("_sl_g"))
    fresh = new.crossJoin(F.broadcast(top)).withColumn("generation", (F.col("_sl_g") + 1).cast(old.schema["generation"].dataType)).drop("_sl_g")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(fresh)


def stale(indexes: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """Indexes (name, generation) built before the chunks' current generation: to be dropped and rebuilt."""
    now = chunk_table.agg(F.max("generation").alias("now"))
    return indexes.join(F.broadcast(now), F.col("generation") != F.col("now")).select("name", "generation", "now")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` with ``new`` merged in; of several rows of a key in the batch the last by ``order`` counts."""
    names = [c for c in new.columns if c not in (key, order)]
    last = new.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_sl_v")).select(key, "_sl_v.*")
    return old.join(last, key, "left_anti").unionByName(last)


def recovered(jobs: DataFrame, now) -> DataFrame:
    """Jobs whose lease has run out go back to pending, with one attempt more; the rest stay as they are."""
    lost = (F.col("status") == "processing") & (F.col("lease_until") < now)
    return jobs.withColumn("attempts", F.col("attempts") + F.when(lost, 1).otherwise(0)).withColumn("status", F.when(lost, "pending").otherwise(F.col("status"))).withColumn("lease_until", F.when(~lost, F.col("lease_until")))


def job_page(jobs: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Jobs, newest first."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).offset(offset).limit(limit)


def appended(heads: DataFrame, fresh: DataFrame) -> DataFrame:
    """(author, seq, body, prev, hash): ``fresh`` (author, ts, id, body) chained to each author's head (author, seq, hash).

    A line's hash covers the hash before it, so a chain is a fold over one author's batch.
    """
    batch = fresh.groupBy("author").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "body"))).alias("xs"))
    start = batch.join(heads, "author", "left").select("author", "xs", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("hash", F.lit("")).alias("hash"))
    empty = F.array().cast("array<struct<body:string,prev:string,hash:string>>")

    def step(acc: Column, x: Column) -> Column:
        prev = F.coalesce(F.try_element_at(acc, F.lit(-1))["hash"], F.col("hash"))
        return F.concat(acc, F.array(F.struct(x["body"].alias("body"), prev.alias("prev"), F.sha2(F.concat(prev, F.lit("\n"), x["body"]), 256).alias("hash"))))

    out = start.select("author", "seq", F.posexplode(F.aggregate("xs", empty, step)).alias("i", "e"))
    return out.select("author", (F.col("seq") + F.col("i") + 1).alias("seq"), "e.body", "e.prev", "e.hash")


def memberships(rows: DataFrame, *, person: str | None = None, organization: str | None = None, at=None) -> DataFrame:
    """Memberships (person, organization, role, since, until) of a person or an organization, those of a day only if ``at`` is given; newest first."""
    if person is not None:
        rows = rows.where(F.col("person") == person)
    if organization is not None:
        rows = rows.where(F.col("organization") == organization)
    if at is not None:
        rows = rows.where((F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at)))
    return rows.orderBy(F.col("since").desc_nulls_last(), "person", "organization")


def ended(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Open memberships named in ``ends`` (person, organization, on) get their end."""
    return rows.join(ends, ["person", "organization"], "left").withColumn("until", F.coalesce("until", F.when(F.col("on") >= F.col("since"), F.col("on")))).drop("on")


def relocated(rows: DataFrame, column: str, old_root: str, new_root: str) -> DataFrame:
    """Paths below ``old_root`` moved to ``new_root``; others stay."""
    inside = (F.col(column) == old_root) | F.col(column).startswith(old_root.rstrip("/") + "/")
    return rows.withColumn(column, F.when(inside, F.concat(F.lit(new_root.rstrip("/")), F.substring(F.col(column), F.lit(len(old_root.rstrip("/")) + 1), F.length(column)))).otherwise(F.col(column)))


def kv_scan(pairs: DataFrame, prefix: str) -> DataFrame:
    """(key, value) of keys that begin with ``prefix``, in byte order."""
    return pairs.where(F.col("key").startswith(prefix)).orderBy("key")


def kv_applied(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value) after ``changes`` (key, value, seq): the last change of a key wins, a null value removes it."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("_sl_v")).select("key", "_sl_v.value")
    return pairs.join(last, "key", "left_anti").unionByName(last.where("value is not null"))


def normalized_policy(policy: Column) -> Column:
    """Sensitivity in its canonical spelling; what is empty or unknown is restricted."""
    low = F.lower(F.trim(policy))
    return F.when(low.isin("public", "internal", "confidential", "restricted"), low).otherwise("restricted")
