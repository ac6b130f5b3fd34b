"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams.

The benchmark is turned into windows of ``window`` consecutive normalised words (an
item with fewer words, but some, is one window). Each training text is scanned once;
a window hash found in the set is verified by comparing the words' bytes, and every
word inside a verified window counts as hit.

The set is broadcast in slices of about ``SLICE_BYTES`` of benchmark text. A larger
benchmark is scanned in several passes, one slice after the other: a pass is written before the
next slice is collected, so no task and no driver holds two. Without a shuffle and with the same result.

Defined cases: null and empty texts have no words and are never contaminated. Items
without words have no window. Items that repeat an ``item_id`` count once; a null
``item_id`` marks hits and is listed as ``null``. Input columns that bear the name of a
report column are replaced by it. Empty tables give empty (or clean) results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .scratch import Scratch
from .tokens import WORD, blocks, windows, words

SLICE_BYTES = 16 << 20
REPORT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_BITS = 20
_HIT, _ITEMS = "_sl_hit", "_sl_items"


def _index(items: list[tuple[str, str | None]], window: int) -> dict:
    """Window length -> (prefilter bitmap, sorted hashes, per hash the list of (words, item ids))."""
    found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
    texts = pa.array([t for _, t in items], pa.large_string())
    for block in blocks(texts):
        w = words(block, WORD)
        bounds = w.slice_of(block.rows).tolist()
        for r, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            n = min(window, hi - lo)
            if n == 0:
                continue
            for k, h in enumerate(windows(w.hash[lo:hi], n).tolist()):
                found.setdefault(n, {}).setdefault(h, {}).setdefault(_joined(w, lo + k, n), set()).add(items[block.first + r][0])
    index = {}
    for n, by_hash in sorted(found.items()):
        keys = np.array(sorted(by_hash), np.uint64)
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[keys >> np.uint64(64 - _BITS)] = True
        index[n] = (bitmap, keys, [by_hash[int(k)] for k in keys])
    return index


def _joined(w, first: int, n: int) -> bytes:
    return b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[first : first + n].tolist(), w.end[first : first + n].tolist(), strict=True))


def _scan(text: pa.Array, index: dict) -> Iterator[tuple[int, int, np.ndarray, set[str], object, int]]:
    """Per text: row, number of words, mask of hit words, ids of the items, the words and the first word's place."""
    for block in blocks(text):
        w = words(block, WORD)
        bounds = w.slice_of(block.rows)
        cover = np.zeros(len(w.hash) + 1, np.int64)
        ids: dict[int, set[str]] = {}
        for n, (bitmap, keys, entries) in index.items():
            h = windows(w.hash, n)
            at = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)])
            if not len(at):
                continue
            at = at[w.text[at] == w.text[at + n - 1]]
            place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            same = keys[place] == h[at]
            for p, k in zip(at[same].tolist(), place[same].tolist(), strict=True):
                owners = entries[k].get(_joined(w, p, n))
                if owners:
                    cover[p] += 1
                    cover[p + n] -= 1
                    ids.setdefault(int(w.text[p]), set()).update(owners)
        hit = np.cumsum(cover[:-1]) > 0
        for r in range(block.rows):
            lo, hi = int(bounds[r]), int(bounds[r + 1])
            yield block.first + r, hi - lo, hit[lo:hi], ids.get(r, set()), w, lo


def _slices(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The benchmark (i, t) in slices of bounded size, each to be collected when its turn comes."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    k = int(total // SLICE_BYTES) + 1
    return [rows.where(F.pmod(F.xxhash64("t"), F.lit(k)) == s) for s in range(k)]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    action: str = "report",
    window: int = 13,
    share: tuple[int, int] = (1, 20),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Scan ``docs`` for windows of ``benchmark``.

    A document is contaminated if it has a hit word and hits make up at least
    ``share`` of its words. ``action``: ``report`` adds the columns of ``REPORT``;
    ``documents`` drops contaminated documents; ``spans`` keeps every document and
    cuts its hit words (with what stands between two adjacent hit words).
    """
    if action not in ("report", "documents", "spans"):
        raise ValueError(f"unknown action {action!r}")
    spark = docs.sparkSession
    ship(spark)
    names = [c for c in docs.columns if not (action == "report" and c in REPORT)]
    base = docs.select(*(docs[c] for c in names))
    slices = _slices(benchmark, item_id, item_text)
    scratch = Scratch(spark, "windows")

    def shared_index(rows: DataFrame):
        return spark.sparkContext.broadcast(_index([(r["i"], r["t"]) for r in rows.toLocalIterator()], window))

    mark = T.StructType([T.StructField(_HIT, T.BinaryType()), T.StructField(_ITEMS, T.ArrayType(T.StringType()))])
    up, down = share

    def first_pass(k: int, shared):
        def run(batches):
            for b in batches:
                old = b.column(_HIT).to_pylist() if k else None
                old_ids = b.column(_ITEMS).to_pylist() if k else None
                marks, ids = [], []
                for r, n, hit, found, _, _ in _scan(b.column(text), shared.value):
                    if k:
                        hit = hit | np.unpackbits(np.frombuffer(old[r], np.uint8), count=n).astype(bool)
                        found = found | set(old_ids[r])
                    marks.append(np.packbits(hit).tobytes())
                    ids.append(sorted(found))
                cols = [b.column(c) for c in names] + [pa.array(marks, pa.binary()), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, _HIT, _ITEMS])

        return run

    # one slice after the other: its pass is written before the next slice is collected, so no task or driver holds two
    for k, rows in enumerate(slices[:-1]):
        shared = shared_index(rows)
        marked = scratch.put(base.mapInArrow(first_pass(k, shared), T.StructType([*docs.select(*names).schema.fields, *mark.fields])))
        shared.unpersist()
        if k:
            scratch.drop(base)
        base = marked
    chained = len(slices) > 1
    final = shared_index(slices[-1])

    def last(batches):
        index = final.value
        for b in batches:
            old = b.column(_HIT).to_pylist() if chained else None
            old_ids = b.column(_ITEMS).to_pylist() if chained else None
            n_words, n_hit, n_items, digests, bad, cut = [], [], [], [], [], []
            source = b.column(text).to_pylist() if action == "spans" else None
            for r, n, hit, found, w, lo in _scan(b.column(text), index):
                if chained:
                    hit = hit | np.unpackbits(np.frombuffer(old[r], np.uint8), count=n).astype(bool)
                    found = found | set(old_ids[r])
                hits = int(hit.sum())
                n_words.append(n)
                n_hit.append(hits)
                n_items.append(len(found))
                digests.append(hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
                bad.append(hits > 0 and down * hits >= up * n)
                if source is not None:
                    cut.append(_without(source[r], hit, w, lo) if hits else source[r])
            if action == "documents":
                yield b.select(names).filter(pa.array([not x for x in bad], pa.bool_()))
                continue
            cols = {c: b.column(c) for c in names}
            if action == "spans":
                cols[text] = pa.array(cut, b.schema.field(text).type)
            else:
                cols |= {
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_hit": pa.array(n_hit, pa.int64()),
                    "n_items": pa.array(n_items, pa.int64()),
                    "items_sha256": pa.array(digests, pa.string()),
                    "contaminated": pa.array(bad, pa.bool_()),
                }
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = T.StructType(list(docs.select(*names).schema.fields))
    if action == "report":
        for c, kind in zip(REPORT, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()), strict=True):
            schema = schema.add(c, kind)
    return base.mapInArrow(last, schema)


def _without(source: str, hit: np.ndarray, w, lo: int) -> str:
    """The text without its runs of hit words."""
    raw = source.encode()
    shift = int(w.start[lo]) - _first_word(raw)
    keep, at = [], 0
    starts, ends = w.start[lo : lo + len(hit)] - shift, w.end[lo : lo + len(hit)] - shift
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        keep.append(raw[at : int(starts[a])])
        at = int(ends[b - 1])
    return b"".join([*keep, raw[at:]]).decode()


def _first_word(raw: bytes) -> int:
    return int(np.argmax(WORD[np.frombuffer(raw, np.uint8)]))
