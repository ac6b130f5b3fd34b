"""Where results go: tables replaced by partition, upserts, deletes, and text renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clock, slugify


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``df`` has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key."""
    return old.join(new, key, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, key: str | list[str]) -> DataFrame:
    return old.join(gone, key, "left_anti")


def csv_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The view's columns, else all, title first and the rest sorted."""
    return columns or ["title"] * ("title" in df.columns) + sorted(c for c in df.columns if c != "title")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, headers: dict[str, str] | None = None) -> None:
    names = csv_columns(df, columns or [])
    df.select(*(F.col(c).alias((headers or {}).get(c, c)) for c in names)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def markdown_table(df: DataFrame, columns: list[str], cap: int = 100) -> str:
    """A Markdown table of at most ``cap`` rows, with a footer if there are more."""
    rows = df.select(*columns).limit(cap + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:cap]]
    return "\n".join(lines + ([f"\n*{cap} rows shown*"] if len(rows) > cap else []))


def note_paths(df: DataFrame, title: Column, folder: str, taken: DataFrame | None = None) -> DataFrame:
    """``df`` with a path per row: its slug, numbered from the second row of a slug on, after those already taken (slug, n)."""
    from pyspark.sql import Window

    slug = F.when(slugify(title) == "", "untitled").otherwise(slugify(title))
    d = df.withColumn("slug", slug)
    order = [c for c in df.columns]
    d = d.withColumn("_sl_n", F.row_number().over(Window.partitionBy("slug").orderBy(*order)))
    if taken is not None:
        d = d.join(taken.select("slug", F.col("n").alias("_sl_t")), "slug", "left").withColumn("_sl_n", F.col("_sl_n") + F.coalesce("_sl_t", F.lit(0))).drop("_sl_t")
    number = F.when(F.col("_sl_n") > 1, F.concat(F.lit("-"), F.col("_sl_n").cast("string"))).otherwise("")
    return d.withColumn("path", F.concat(F.lit(f"{folder}/"), "slug", number, F.lit(".md"))).drop("_sl_n", "slug")


def backup(df: DataFrame, path: str) -> None:
    """A table's rows and, written after them, what a restore checks."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    rows.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("digest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a backup; one that is not complete is refused."""
    rows, told = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/manifest").first()
    got = rows.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("digest")).first()
    if (got["rows"], got["digest"]) != (told["rows"], told["digest"]):
        raise ValueError(f"backup at {path} is damaged")
    return rows


def transcript(segments: DataFrame, form: str) -> DataFrame:
    """(meeting, text) of segments (meeting, id, speaker, start, end, text): txt, md, srt or vtt."""
    stop = {"srt": ",", "vtt": "."}.get(form)
    if stop:
        line = F.concat(clock(F.col("start"), stop), F.lit(" --> "), clock(F.col("end"), stop), F.lit("\n"), "speaker", F.lit(": "), "text")
    else:
        line = F.concat(F.lit("**") if form == "md" else F.lit(""), "speaker", F.lit("**") if form == "md" else F.lit(""), F.lit(": "), "text")
    parts = segments.groupBy("meeting").agg(F.sort_array(F.collect_list(F.struct("start", "end", "speaker", "id", line.alias("line")))).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["line"]) if form == "srt" else x["line"]), "\n\n" if stop else "\n")
    return parts.select("meeting", F.concat(F.lit("WEBVTT\n\n") if form == "vtt" else F.lit(""), body).alias("text"))


def allowed(docs: DataFrame, rules: DataFrame, user: str, groups: list[str], admin: bool = False) -> DataFrame:
    """Documents the user may see: those without a rule, their own, and those shared with them; ``rules`` (path, owner, users, groups)."""
    if admin:
        return docs
    mine = (F.col("owner") == user) | F.array_contains("users", user) | F.arrays_overlap("groups", F.array(*(F.lit(g) for g in groups)).cast("array<string>"))
    ruled = rules.select("path", F.coalesce(mine, F.lit(False)).alias("_sl_ok")).groupBy("path").agg(F.max("_sl_ok").alias("_sl_ok"))
    return docs.join(ruled, "path", "left").where(F.coalesce("_sl_ok", F.lit(True))).drop("_sl_ok")
