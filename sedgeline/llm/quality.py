"""Quality selection by importance resampling.

Target text (labelled good) and raw text (every document) each get a generative model: a
bag of hashed n-grams with add-one smoothing. The log importance weight of a document is
the sum, over its n-grams, of log(target probability / raw probability). Documents are
drawn without replacement in proportion to their weights by Gumbel top-k: the k largest
values of ``log weight + Gumbel noise``.

N-grams are of two kinds, hashed to separate buckets: words (1 and 2 in a row), and token
shapes (1 to 3 in a row), where a token's shape is its case pattern, whether it is a number,
whether it repeats the word before, or, for runs of punctuation, the run itself.

Counts cover all documents. ``k`` may be given; without it, it is the number of documents
whose noisy weight reaches the cut that best parts good from bad labelled rows that are
not held out. The k-th value is found by repeated histograms, never by sorting all rows.

Defined cases: texts without any token (null, empty, white space) are never selected and
have a null weight. Labels without a document or with a null value are not used; an id
labelled more than once takes its largest label. Without a good labelled text weights are 0; without
labels of both kinds every document with a token is selected. The noise depends on id and
text only, so a task that runs again draws the same; rows that repeat both share it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .scratch import Scratch, small
from .tokens import LOWER, Block, blocks, byte_class, mix, span_hashes, windows
from .toxicity import held_out

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 14, 1 << 12
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS

_SPACE = byte_class((0x00, 0x20), (0x7F, 0x7F))
_DIGIT = byte_class((0x30, 0x39))
_UPPER = byte_class((0x41, 0x5A))
_SMALL = byte_class((0x61, 0x7A))
_LETTER = _UPPER | _SMALL | byte_class((0x80, 0xFF))
_KIND = np.where(_SPACE, 0, np.where(_DIGIT | _LETTER, 1, 2)).astype(np.uint8)


def _ngrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every n-gram of a block's texts."""
    kind = _KIND[block.data]
    if block.rows > 1:
        kind[block.begin[1:] - 1] = 0
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]))
    real = kind[edge[:-1]] > 0
    start, end = edge[:-1][real], edge[1:][real]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = block.text_of(start)
    h = span_hashes(LOWER[block.data], start, end)
    is_word = kind[start] == 1
    ups, smalls, digits = (np.concatenate(([0], np.cumsum(c[block.data], dtype=np.int64))) for c in (_UPPER, _SMALL, _DIGIT))
    up, small_, digit = (c[end] - c[start] for c in (ups, smalls, digits))
    shape = np.full(len(start), 4, np.uint64)
    shape[_UPPER[block.data[start]]] = 3
    shape[(up > 1) & (small_ == 0)] = 1
    shape[(digit > 0) & (digit == end - start)] = 2
    at = np.flatnonzero(is_word)
    again = at[1:][(h[at[1:]] == h[at[:-1]]) & (text[at[1:]] == text[at[:-1]])]
    shape[again] = 5
    shape[~is_word] = 16 + h[~is_word] % np.uint64(1 << 20)
    shape = mix(shape)
    texts, buckets = [], []
    for values, sizes, width, first in ((h[at], (1, 2), WORD_BUCKETS, 0), (shape, (1, 2, 3), SHAPE_BUCKETS, WORD_BUCKETS)):
        owner = text[at] if first == 0 else text
        for n in sizes:
            g = windows(values, n)
            own = owner[: len(g)]
            ok = own == owner[n - 1 :] if len(g) else np.zeros(0, bool)
            texts.append(own[ok])
            buckets.append((g[ok] % np.uint64(width)).astype(np.int64) + first)
    return np.concatenate(texts), np.concatenate(buckets)


def _labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    own = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.join(small(own), "id", "left")


def models(rows: DataFrame) -> np.ndarray:
    """Log ratio of the smoothed target and raw probabilities of each bucket; rows have id, text and label."""
    learn = (F.col("label") == 1) & ~held_out(F.col("id"))

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            good = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for block in blocks(b.column(0)):
                text, bucket = _ngrams(block)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[good[block.first + text]], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])

    sums = rows.select("text", learn.alias("good")).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # one row a bucket at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS)):
        t, r = target[part] + 1, raw[part] + 1
        out[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out if target.sum() else np.zeros(BUCKETS)


def weigh(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(id, label, n_grams, log_weight, noise) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            w = np.zeros(b.num_rows)
            for block in blocks(b.column(1)):
                text, bucket = _ngrams(block)
                n[block.first : block.first + block.rows] = np.bincount(text, minlength=block.rows)
                w[block.first : block.first + block.rows] = np.bincount(text, shared.value[bucket], minlength=block.rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n), pa.array(w, mask=n == 0)], names=["id", "label", "u", "n_grams", "log_weight"])

    u = (F.pmod(F.xxhash64("id", "text", F.lit(31)), F.lit(1 << 50)) + 0.5) / float(1 << 50)
    schema = T.StructType().add("id", "long").add("label", "integer").add("u", "double").add("n_grams", "long").add("log_weight", "double")
    got = rows.select("id", "text", "label", u.alias("u")).mapInArrow(run, schema)
    return got.withColumn("noise", -F.log(-F.log("u"))).drop("u")


def kth_largest(values: DataFrame, k: int, bins: int = 1024, enough: int = 4096) -> float:
    """The k-th largest of the one column of ``values`` (not null), by histograms that narrow down on it."""
    c = F.col(values.columns[0])
    lo, hi, n = values.agg(F.min(c), F.max(c), F.count(c)).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return lo
    while n > enough and lo < hi:
        width = (hi - lo) / bins
        place = F.least(F.lit(bins - 1), F.floor((c - lo) / width)) if width > 0 else F.lit(0)
        rows = values.where((c >= lo) & (c <= hi)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi, n = r["lo"], r["hi"], r["n"]
    if lo == hi:
        return lo
    kept = values.where((c >= lo) & (c <= hi)).orderBy(c.desc()).limit(k).agg(F.min(c)).first()
    return kept[0]


def _best_cut(scored: DataFrame) -> float | None:
    """The value of ``key`` that best parts good from bad learned rows, by their quantiles; the middle of the best stretch."""
    at = [i / 400 for i in range(401)]
    rows = scored.where("label is not null and key is not null").where(~held_out(F.col("id"))).groupBy((F.col("label") == 1).alias("good")).agg(F.percentile_approx("key", at, 20_000).alias("q")).collect()
    q = {r["good"]: np.array(r["q"]) for r in rows}
    if len(q) < 2:
        return None
    good, bad = q[True], q[False]
    cuts = np.unique(np.concatenate((good, bad)))
    lost = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = int(np.argmin(lost))
    below = cuts[best - 1] if best else cuts[best] - 1.0
    return float((cuts[best] + below) / 2)


def select(docs: DataFrame, labels: DataFrame, *, k: int | None = None, label: str = "quality", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_grams, log_weight, key, selected) of every row of ``docs``."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    rows = _labelled(docs, labels, id, text, label)
    scored = scratch.put(weigh(rows, models(rows)).withColumn("key", F.col("log_weight") + F.col("noise")))
    keys = scored.where("key is not null").select("key")
    if k is None:
        cut = _best_cut(scored)
        k = keys.count() if cut is None else keys.where(F.col("key") >= cut).count()
    floor = kth_largest(keys, k)
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "n_grams", "log_weight", "key", F.coalesce(F.col("key") >= floor, F.lit(False)).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The selected rows of ``docs``, with its columns; an id of which any row is selected stays."""
    found = select(docs, labels, id=id, text=text, **options)
    gone = found.groupBy("id").agg(F.max("selected").alias("s")).where("not s").select(F.col("id").alias("_sl_id"))
    return docs.join(small(gone), F.col(id).cast("long").eqNullSafe(F.col("_sl_id")), "left_anti")
