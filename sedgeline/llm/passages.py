"""Line dedup of whole passages: content-defined anchors find shared text, a byte comparison with the first place bounds it.

Anchors of a text are of two kinds. Content-defined chunks of lines: a rolling hash over ``ROLL`` successive
line hashes ends a chunk where it is 0 modulo ``EVERY``, so boundaries depend on nearby lines only and
what stands before a passage does not shift the chunks inside it; a chunk of two lines and ``MIN_WORDS``
words or more is an anchor. Blank lines do not count, and blanks at the ends of a line are no part of it. And, for what is shared
inside long lines, runs of ``GRAM`` words: a hash of its bytes gives each run a value, and a run is an anchor if its value
is the least of some ``WINDOW`` successive runs (of all, in a text of fewer); of equal neighbours only every ``GRAM``-th
and the last. Which runs are chosen inside a passage
depends on the passage only, so two texts that share ``GRAM + WINDOW - 1`` words or more always have
an anchor in common, whatever stands around them.

Each anchor that occurs again is compared with its first place (smallest id, then text, then
position) and extended byte by byte in both directions, ``WINDOW`` words at most; beyond that the
passage has a further anchor. What agrees, cut back to whole words, is removed. A removed byte always
equals one of an earlier place, so the first copy of everything stays.

The bytes of first places travel as pieces of ``PIECE`` bytes, each at most once per text that needs it.

Defined cases: null stays null, empty texts stay empty. Texts that repeat an id are taken in the order
of a hash of the text; rows that repeat id and text are one. A null id comes last. Columns of the result
replace columns of those names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .scratch import Scratch, is_small
from .tokens import Block, blocks, byte_class, mix, span_hashes, spans_of

GRAM, WINDOW, PIECE = 13, 20, 256
ROLL, EVERY, MIN_WORDS = 2, 3, 13
_VISIBLE = ~byte_class((0, 32))
#: Bytes of which no two neighbours are parted: letters, digits and all of a character beyond ASCII.
_LETTERS = frozenset([*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)])

def _slide(h: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or largest of each ``width`` successive values."""
    got, have = h, 1
    while have < width:
        step = min(have, width - have)
        got = pick(got[:-step], got[step:])
        have += step
    return got


def line_chunks(line: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Number of the chunk of each line, from the lines' hashes and the texts they stand in."""
    n = len(line)
    rolled = np.zeros(n, np.uint64)
    whole = np.arange(n) >= ROLL - 1
    for back in range(ROLL):
        before = np.concatenate((line[:0], np.zeros(min(back, n), np.uint64), line[: max(0, n - back)]))
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + before
        whole[back:] &= text[back:] == text[: n - back]
    ends = whole & (mix(rolled) % np.uint64(EVERY) == 0)
    new = np.ones(n, bool)
    new[1:] = ends[:-1] | (text[1:] != text[:-1])
    return np.cumsum(new) - 1


def anchors(block: Block) -> tuple[np.ndarray, ...]:
    """(text, key, start, end, low, high) of the anchors of a block's texts; low and high are ``WINDOW`` words away."""
    none = np.zeros(0, np.int64)
    mask = _VISIBLE[block.data]
    starts, ends = spans_of(mask)
    n = len(starts)
    if not n:
        return (none,) * 6
    text = block.text_of(starts)
    bounds = np.searchsorted(text, np.arange(block.rows + 1))
    # runs of words
    r = np.arange(max(0, n - GRAM + 1))
    r = r[text[r] == text[r + GRAM - 1]]
    h = span_hashes(block.data, starts[r], ends[r + GRAM - 1])
    own = text[r]
    chosen = np.zeros(len(r), bool)
    if len(r) >= WINDOW:
        least = _slide(h, WINDOW, np.minimum)
        least[own[: len(least)] != own[WINDOW - 1 :]] = 0
        pad = np.zeros(WINDOW - 1, np.uint64)
        # a run is chosen if it is the least of a window around it; the largest of its windows' leasts tells
        chosen = (_slide(np.concatenate((pad, least, pad)), WINDOW, np.maximum) == h) & (h > 0)
    if len(r):
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(np.concatenate((first, [len(r)])))
        chosen |= np.repeat(size < WINDOW, size) & (h == np.repeat(np.minimum.reduceat(h, first), size))
    # of equal neighbours (one word again and again) every GRAM-th and the last will do: they have the same key and touch each other
    same = np.zeros(len(r), bool)
    same[1:] = chosen[1:] & chosen[:-1] & (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    place = np.arange(len(r))
    place -= np.maximum.accumulate(np.where(same, 0, place))
    last = np.ones(len(r), bool)
    last[:-1] = ~same[1:]
    chosen &= last | (place % GRAM == 0)
    a, key = r[chosen], h[chosen]
    z = a + GRAM - 1
    # chunks of lines
    line_end = np.concatenate((np.flatnonzero(block.data == 10), [len(block.data)]))
    wl = np.searchsorted(starts, np.concatenate(([0], line_end[:-1] + 1)))
    wr = np.searchsorted(starts, line_end)
    wl, wr = wl[wr > wl], wr[wr > wl]
    if len(wl):
        number = line_chunks(span_hashes(block.data, starts[wl], ends[wr - 1]), text[wl])
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        last = np.concatenate((first[1:], [len(wl)])) - 1
        real = (last > first) & (wr[last] - wl[first] >= MIN_WORDS)
        ca, cz = wl[first[real]], wr[last[real]] - 1
        a, z = np.concatenate((a, ca)), np.concatenate((z, cz))
        key = np.concatenate((key, span_hashes(block.data, starts[ca], ends[cz])))
    t = text[a]
    lo, hi = np.maximum(a - WINDOW, bounds[t]), np.minimum(z + WINDOW, bounds[t + 1] - 1)
    at = block.begin[t]
    # blanks at the ends of a text are shared with it
    low = np.where(lo == bounds[t], 0, starts[lo] - at)
    high = np.where(hi == bounds[t + 1] - 1, block.length[t], ends[hi] - at)
    return t, key.view(np.int64), starts[a] - at, ends[z] - at, low, high


def _trimmed(raw: bytes, s: int, e: int, start: int, end: int) -> tuple[int, int]:
    """The span (s, e) around the anchors (start, end) cut back to whole words; blanks before it stay, so what is left does not run together."""
    while s < start and s and (raw[s] <= 32 or raw[s - 1] in _LETTERS and raw[s] in _LETTERS):
        s += 1
    while e > end and e < len(raw) and raw[e] in _LETTERS and raw[e - 1] in _LETTERS:
        e -= 1
    return s, e


def _agree(x: bytes, y: bytes) -> int:
    """How many leading bytes agree."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _around_one(raw: bytes, pos: int, end: int, shift: int, low: int, high: int, other: bytes, base: int) -> list[tuple[int, int]]:
    """``_shared`` for a single anchor, which most are: a few comparisons of bytes."""
    at = pos + shift - base
    if at < 0 or other[at : at + end - pos] != raw[pos:end]:
        return []
    e = end + _agree(raw[end:high], other[at + end - pos : at + max(high, end) - pos])
    back = pos - max(low, base - shift, 0)
    s = pos - (_agree(raw[pos - back : pos][::-1], other[at - back : at][::-1]) if back > 0 else 0)
    return [_trimmed(raw, s, e, pos, end)]


def _shared(raw: bytes, at: np.ndarray, shift: int, low: int, high: int, other: bytes, base: int) -> list[tuple[int, int]]:
    """What of ``raw`` around the anchors ``at`` (pos << 32 | end) agrees with ``other`` at ``shift``; ``other`` starts at ``base`` of the first place's text."""
    if len(at) == 1:
        return _around_one(raw, int(at[0]) >> 32, int(at[0]) & 0xFFFFFFFF, shift, low, high, other, base)
    low = max(low, base - shift, 0)
    high = min(high, base - shift + len(other), len(raw))
    if high <= low:
        return []
    if raw[low:high] == other[low + shift - base : high + shift - base]:
        inside = at[((at >> 32) >= low) & ((at & 0xFFFFFFFF) <= high)]
        return [_trimmed(raw, low, high, int(inside.min()) >> 32, int((inside & 0xFFFFFFFF).max()))] if len(inside) else []
    x = np.frombuffer(raw, np.uint8, high - low, low)
    y = np.frombuffer(other, np.uint8, high - low, low + shift - base)
    differ = np.concatenate(([low - 1], np.flatnonzero(x != y) + low, [high]))
    at = np.sort(at)
    pos, end = at >> 32, at & 0xFFFFFFFF
    # the stretch of agreement that holds an anchor's first byte must hold all of it
    k = np.searchsorted(differ, pos, "right") - 1
    good = (differ[k] != pos) & (end <= differ[np.minimum(k + 1, len(differ) - 1)])
    out = []
    for j in np.unique(k[good]):
        mine = good & (k == j)
        out.append(_trimmed(raw, int(differ[j]) + 1, int(differ[j + 1]), int(pos[mine].min()), int(end[mine].max())))
    return out


def removable(raw: bytes, places: list[tuple[int, int, bool, int, int, int, np.ndarray]], held: dict[tuple[int, int], dict[int, bytes]]) -> list[list[int]]:
    """Disjoint spans of ``raw`` that repeat earlier places: (home's id, home's u, own, shift, low, high, anchors)."""
    runs: dict[tuple[int, int], tuple[list[int], list[bytes]]] = {}
    for home, pieces in held.items():
        bases, data, after = [], [], None
        for q in sorted(pieces):
            if q == after:
                data[-1].append(pieces[q])
            else:
                bases.append(q * PIECE)
                data.append([pieces[q]])
            after = q + 1
        runs[home] = (bases, [b"".join(d) for d in data])
    got = []
    for hid, hu, own, shift, low, high, at in places:
        if own:
            got += _shared(raw, at, shift, low, high, raw, 0)
        else:
            bases, data = runs[hid, hu]
            j = int(np.searchsorted(bases, max(0, low + shift), "right")) - 1
            got += _shared(raw, at, shift, low, high, data[j], bases[j])
    out: list[list[int]] = []
    for s, e in sorted(got):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _places(column: pa.Array) -> list[list[tuple[int, int, bool, int, int, int, np.ndarray]]]:
    """The places of each row, read by whole columns; a null list has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.cumsum(np.concatenate(([0], pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))))
    flat = column.flatten()
    names = ("hid", "hu", "own", "shift", "low", "high")
    fields = [pc.struct_field(flat, n).to_pylist() for n in names]
    at = pc.struct_field(flat, "at")
    ends = np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False))
    anchors_ = np.split(at.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []
    rows = list(zip(*fields, anchors_, strict=True))
    return [rows[lo:hi] for lo, hi in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]


def dedup_passages(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its repeated passages cut from ``text``, and ``n_removed`` and ``removed`` (spans of bytes, ends exclusive)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "passages")
    key = F.coalesce(F.col(id).cast("long"), F.lit(2**63 - 1))
    names = [c for c in docs.columns if c not in ("n_removed", "removed")]
    base = docs.select(*names)
    rows = base.select(key.alias("id"), F.xxhash64(text).alias("u"), F.col(text).alias("text"))

    def occurrences(batches):
        for b in batches:
            ids, us = b.column(0).to_numpy(), b.column(1).to_numpy()
            for block in blocks(b.column(2)):
                t, key, start, end, low, high = anchors(block)
                cols = [key, start << 32 | end, low << 32 | high, ids[block.first + t], us[block.first + t]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["k", "at", "around", "id", "u"])

    # two numbers to a column: what is shuffled is half as wide
    found = scratch.put(rows.mapInArrow(occurrences, "k long, at long, around long, id long, u long"))
    home = F.min(F.struct("id", "u", "at")).alias("h")
    repeated = found.groupBy("k").agg(F.count("*").alias("n"), home).where("n > 1")
    repeated = scratch.put(repeated.select("k", F.col("h.id").alias("hid"), F.col("h.u").alias("hu"), F.col("h.at").alias("hat")))
    own = (F.col("id") == F.col("hid")) & (F.col("u") == F.col("hu"))
    places = found.join(repeated, "k").where(~own | (F.col("at") != F.col("hat")))
    # anchors that lie at one distance from their first places are looked at together
    shift = F.shiftright("hat", 32) - F.shiftright("at", 32)
    low, high = F.shiftright("around", 32), F.col("around").bitwiseAND(F.lit(0xFFFFFFFF))
    places = places.groupBy("id", "u", "hid", "hu", shift.alias("shift")).agg(F.min(low).alias("low"), F.max(high).alias("high"), F.collect_list("at").alias("at"))
    # an id's places are at most as many as its anchors
    places = places.withColumn("own", own).groupBy("id", "u").agg(F.collect_list(F.struct("hid", "hu", "own", "shift", "low", "high", "at")).alias("_sl_places"))
    places = scratch.put(places)

    def requests(batches):
        for b in batches:
            wanted = set()
            for i, u, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _places(b.column(2)), strict=True):
                for hid, hu, mine, shift, low, high, _ in ps:
                    if not mine:
                        wanted.update((i, u, hid, hu, q) for q in range(max(0, low + shift) // PIECE, (high + shift - 1) // PIECE + 1))
            cols = list(zip(*wanted, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 4, pa.int32()], strict=True)], names=["id", "u", "hid", "hu", "q"])

    asked = scratch.put(places.mapInArrow(requests, "id long, u long, hid long, hu long, q int"))
    homes = asked.select("hid", "hu", "q").distinct().groupBy("hid", "hu").agg(F.collect_list("q").alias("qs"))
    homes = scratch.put(homes)

    def pieces(batches):
        for b in batches:
            out = []
            for i, u, qs, t in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                raw = t.encode()
                out += [(i, u, q, raw[q * PIECE : (q + 1) * PIECE]) for q in qs if q * PIECE < len(raw)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names=["hid", "hu", "q", "bytes"])

    texts = _of(rows, homes.withColumnRenamed("hid", "id").withColumnRenamed("hu", "u"))
    texts = texts.select("id", "u", "qs", "text").mapInArrow(pieces, "hid long, hu long, q int, bytes binary")
    # equal rows give equal pieces
    texts = scratch.put(texts.groupBy("hid", "hu", "q").agg(F.min("bytes").alias("bytes")))
    sent = asked.join(texts, ["hid", "hu", "q"]).groupBy("id", "u").agg(F.collect_list(F.struct("hid", "hu", "q", "bytes")).alias("_sl_bytes"))
    plan = places.join(sent, ["id", "u"], "left").withColumnsRenamed({"id": "_sl_id", "u": "_sl_u"})
    plan = scratch.put(plan)
    scratch.keep(plan)
    marked = base.withColumn("_sl_id", key).withColumn("_sl_u", F.xxhash64(text))
    ids = plan.select("_sl_id", "_sl_u")
    on = ["_sl_id", "_sl_u"]
    if is_small(ids):
        # only the texts that hold a repeated passage are shuffled to their plans
        held = marked.join(F.broadcast(ids), on, "left_semi").join(plan, on)
        rest = marked.join(F.broadcast(ids), on, "left_anti")
        joined = held.unionByName(rest, allowMissingColumns=True)
    else:
        joined = marked.join(plan, on, "left")
    fields = base.schema.fields
    schema = T.StructType([*fields, T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))])

    def cut(batches):
        for b in batches:
            texts, n_removed, spans = [], [], []
            for j, (t, ps) in enumerate(zip(b.column(text).to_pylist(), _places(b.column("_sl_places")), strict=True)):
                gone = []
                if t and ps:
                    held: dict[tuple[int, int], dict[int, bytes]] = {}
                    for p in b.column("_sl_bytes")[j].as_py() or ():
                        held.setdefault((p["hid"], p["hu"]), {})[p["q"]] = p["bytes"]
                    raw = t.encode()
                    gone = removable(raw, ps, held)
                n_removed.append(len(gone))
                spans.append(gone)
                texts.append(_cut(raw, gone) if gone else t)
            cols = {c: b.column(c) for c in names}
            cols[text] = pa.array(texts, b.schema.field(text).type)
            cols |= {"n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return joined.select(*names, "_sl_places", "_sl_bytes").mapInArrow(cut, schema)


def _cut(raw: bytes, gone: list[list[int]]) -> str:
    keep, at = [], 0
    for start, end in gone:
        keep.append(raw[at:start])
        at = end
    return b"".join([*keep, raw[at:]]).decode()


def _of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` of the (id, u) in ``wanted``, with its columns; only those rows are shuffled where the list of ids is small."""
    ids = wanted.select("id", "u")
    if is_small(ids):
        rows = rows.join(F.broadcast(ids), ["id", "u"], "left_semi")
    return rows.join(wanted, ["id", "u"])
