"""Sharding by sampled splitters: near equal bytes in every shard, and copies of a text in one shard.

Records are ordered by (CRC-32 of the text, id). A size-weighted sample of keys gives
quantile boundaries that cut this order into ranges of about equal bytes, and exact bytes
and rows of every range are counted. A shard is a run of ranges: it ends at the boundary nearest to its
quantile of the bytes. Ranges are overfull, and are sampled again and subdivided, while they

* hold more than ``OVERFULL`` times their share (a task would be too large), or
* span the quantile where a shard should end, and both their ends are further than
  ``TOLERANCE`` of a shard from it.

A boundary falls between different texts. Only inside a text whose copies hold more than
``TOLERANCE`` of a shard does it also name an id, so such a group is the only one that two shards share.
Each round splits every overfull range that holds two keys; so the rounds end, at ranges
of one key at worst. A record's shard follows from its key and the splitters alone; its slot from the rows of
the ranges before its own and a window inside its range. No task handles a whole shard.

Law: ``bytes``. A shard's bytes differ from the mean by twice ``TOLERANCE`` of it and one record at most. Defined cases: a null
text has size 8 and the CRC-32 of the empty text; null ids come first; rows that repeat id
and text are records of their own, of one key, so they share a range; an empty table gives no rows. A column of the input that
bears the name of a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, partitions

#: Ranges per shard, sampled keys per range, how far a range may exceed its share, and a shard's end its quantile.
RANGES, SAMPLES, OVERFULL, TOLERANCE = 32, 24, 4.0, 0.005
LOW = 1 - 2**63  # before every id
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _before(crc: Column, id: Column, cuts: list[tuple[int, int | None]]) -> Column:
    """How many cuts are at most (crc, id); a cut without id lies before all ids of its crc. Binary search."""
    if not cuts:
        return F.lit(0)
    table = F.expr(f"array({','.join(f'struct({c}L AS c, {LOW if i is None else i}L AS i)' for c, i in cuts)})")
    key = F.struct(crc.alias("c"), F.coalesce(id, F.lit(LOW)).alias("i"))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        going = acc["lo"] < acc["hi"]
        reached = F.get(table, mid) <= key
        return F.struct(F.when(going & reached, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(going & ~reached, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, step, lambda a: a["lo"])


def _splitters(sample: list[tuple[int, int | None]], ranges: int) -> list[tuple[int, int | None]]:
    """Quantile boundaries, between different texts, of a sorted key sample."""
    picked = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    return sorted({(c, None) for c, _ in picked}, key=_key)


def _ends(stats: list, shards: int, total: int) -> list[tuple[float, int]]:
    """Per shard but the last: the quantile of the bytes where it should end, and the range that holds that byte."""
    out, b0, at = [], 0, 0
    for i in range(1, shards):
        goal = total * i / shards
        while at < len(stats) - 1 and b0 + stats[at]["b"] < goal:
            b0, at = b0 + stats[at]["b"], at + 1
        out.append((goal - b0, at))
    return out


def assign_shards(docs: DataFrame, shards: int = 24, *, id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``docs`` with ``RESULT``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    cols = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    raw = F.coalesce(F.col(text), F.lit(""))
    measured = docs.select(*cols, F.col(id).cast("long").alias("_sl_id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    if text in cols:
        keys = scratch.put(measured.select("_sl_id", "size", "text_crc32"))
    else:
        keys = measured = scratch.put(measured)

    whole = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total = whole["b"] or 0
    ranges = max(shards * RANGES, partitions(spark))
    share = max(1.0, total / ranges)

    width = total / shards

    def draw(rows: DataFrame, expected: float, of: float) -> list[tuple[int, int | None]]:
        """A size-weighted sample by a hash of the key, so a task that runs again draws the same; a key is drawn once."""
        u = F.pmod(F.xxhash64("_sl_id", "text_crc32", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
        got = rows.where(u < F.col("size") * (expected / max(1.0, of))).select("text_crc32", "_sl_id").distinct().collect()
        return sorted(((r[0], r[1]) for r in got), key=_key)

    cuts = _splitters(draw(keys, ranges * SAMPLES, total), ranges)
    while True:
        counted = keys.select(_before(F.col("text_crc32"), F.col("_sl_id"), cuts).alias("range"), "size", "text_crc32", "_sl_id")
        key = F.struct("text_crc32", "_sl_id")
        stats = counted.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("m"), F.min(key).alias("k0"), F.max(key).alias("k1")).collect()
        stats.sort(key=lambda r: r["range"])
        goals = _ends(stats, shards, total) if stats else []
        pieces = {i: int(r["b"] / share) + 1 for i, r in enumerate(stats) if r["b"] > OVERFULL * share + r["m"]}
        for into, i in goals:
            r = stats[i]
            if min(into, r["b"] - into) > TOLERANCE * width and r["b"] > r["m"]:
                pieces[i] = max(pieces.get(i, 0), int(2 * r["b"] / (TOLERANCE * width)) + 1)
        # a group of copies that fits the tolerance is not cut
        pieces = {i: n for i, n in pieces.items() if stats[i]["k0"] != stats[i]["k1"] and (stats[i]["k0"][0] != stats[i]["k1"][0] or stats[i]["b"] > TOLERANCE * width)}
        if not pieces:
            break
        among = counted.where(F.col("range").isin([stats[i]["range"] for i in pieces]))
        of = sum(stats[i]["b"] for i in pieces)
        within = draw(among, SAMPLES * sum(pieces.values()), of)
        more: set[tuple[int, int | None]] = set()
        for i, n in pieces.items():
            low, high = tuple(stats[i]["k0"]), tuple(stats[i]["k1"])
            mine = [k for k in within if _key(low) < _key(k) <= _key(high)] or [high]
            picked = {mine[len(mine) * j // n] for j in range(1, n)} or {high}
            # between texts, where there are several; else between ids
            more |= {(c, None) for c, _ in picked if c != low[0]} or ({(high[0], None)} if high[0] != low[0] else picked)
        cuts = sorted({*cuts, *more}, key=_key)

    # each shard begins at the boundary nearest to its quantile
    begins = [0] + [at + (into > stats[at]["b"] - into) for into, at in goals] if stats else []
    at, n0 = [], 0
    for i, r in enumerate(stats):
        shard = max(j for j in range(shards) if begins[j] <= i)
        if i and shard != at[-1][1]:
            n0 = 0
        at.append((r["range"], shard, n0))
        n0 += r["n"]
    offsets = F.broadcast(spark.createDataFrame(at, "range int, shard int, n0 long"))

    placed = measured.withColumn("_sl_range", _before(F.col("text_crc32"), F.col("_sl_id"), cuts)).join(offsets.withColumnsRenamed({"range": "_sl_range", "shard": "_sl_shard", "n0": "_sl_n0"}), "_sl_range")
    ordered = Window.partitionBy("_sl_range").orderBy("text_crc32", F.col("_sl_id").asc_nulls_first())
    slot = (F.col("_sl_n0") + F.row_number().over(ordered) - 1).cast("long")
    return placed.select(
        *cols, "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_sl_shard").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _key(k: tuple) -> tuple:
    return k[0], LOW if k[1] is None else k[1]
