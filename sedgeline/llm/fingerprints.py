"""Document fingerprints: a randomised edit embedding read at sampled places.

All texts are walked with the same random bits: at step j the walk stands on one
character, writes it out, and moves on if the bit of (j, character) is 1. Two texts a
few edits apart soon walk in step again, so edit distance becomes Hamming distance of
what the walks write. A fingerprint keeps one bit of what is written at sampled steps:
``PER_OCTAVE`` steps in [2**o, 2**(o + 1)) for every octave o that the walk reaches, so
the whole text is covered at every length, and two texts compare at the same steps.

The likeness of two fingerprints estimates the share of steps at which the walks agree:
per octave the share of agreeing samples, chance agreement taken out, weighted by the
steps that the longer walk has in the octave.

Candidates for near copies share a band: the bits written at ``STRETCH`` successive steps, where both walks are in
step and no edit falls; ``PER_BAND_OCTAVE`` stretches in every octave of the walk are bands. ``near_texts`` verifies
candidates by edit distance on the whole texts and gives every document its class. Equal texts are one class, stood for by
its least id. A band's list is cut by length into lists that overlap, so that any two texts whose lengths allow
a link are together in one. There pivots are compared with members of other components, 1, 8, 64, ... of them a
round, until in each list all members that were never pivot are in one component; so a group of n near copies
costs about n comparisons, and no pair that shares a band is left out. An edit changes at most 2 * ``GRAM`` counts of runs
of ``GRAM`` characters by one; a pair whose counts differ by more than its edits can explain is ruled out by them, before
any text is read. So texts that share no more than a header are many pairs of counts, not of texts.

Defined cases: a null text counts as empty; an empty text has an empty fingerprint, which
is like another empty one (1.0) and unlike any other (0.0). Equal texts have equal
fingerprints. Texts of fewer than 32 steps (about 20 characters) have no band and are classed with equal texts only. Rows are ordered by (id, text), null ids first; rows that repeat an id
follow one another in text order, and the last row is followed by the first.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .components import components
from .near_dedup import _copied, _dealt, _merged, _next_pivots, _open_members
from .scratch import Scratch, partitions, small
from .tokens import _power_tables, mix

PER_OCTAVE = 128
OCTAVES = 40
_PHASES = 4096
_CHUNK = 1 << 16
STRETCH, PER_BAND_OCTAVE = 32, 4
#: Characters of the runs that are counted, counts of a text, and the sums of them that are looked at first.
GRAM, GRAM_BINS, GRAM_SUMS = 3, 1024, 256
#: Characters for each edit up to which texts are compared edit by edit.
PER_EDIT = 2_000
#: Words of the bands that go side by side, and the least and most of them; pairs and their characters that are gathered for that.
LANE_WORDS, FEWEST, LANES = (2, 4, 8, 32), 32, 512
#: Limit from which counts of runs of four characters are looked at first.
MANY_EDITS = 256
GATHERED, GATHERED_CHARS = 4_000, 32 << 20


@cache
def _tables() -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """(steps to the next move by character class and phase, class multiplier's bits, sampled steps, which bit of the character)."""
    rng = np.random.default_rng(7)
    move = rng.integers(0, 2, (256, _PHASES), dtype=np.uint8).astype(bool)
    move[:, 0] = True
    wait = np.empty((256, _PHASES), np.uint16)
    nxt = np.ones(256, np.uint16)  # phase 0 moves, so from the last phase at most one further step is needed
    for p in range(_PHASES - 1, -1, -1):
        nxt = np.where(move[:, p], 1, nxt + 1).astype(np.uint16)
        wait[:, p] = nxt
    steps = [np.zeros(1, np.int64)]
    for o in range(OCTAVES):
        lo, hi = 1 << o, 2 << o
        got = np.arange(lo, hi) if hi - lo <= PER_OCTAVE else np.unique(rng.integers(lo, hi, PER_OCTAVE * 2))
        steps.append(np.sort(rng.permutation(got)[:PER_OCTAVE]))
    sample = np.concatenate(steps)
    bit = rng.integers(1, 2**63, len(sample), dtype=np.uint64) | np.uint64(1)
    return [row.tolist() for row in wait], rng.integers(1, 2**32, 1, dtype=np.uint64) | np.uint64(1), sample, bit


@cache
def _stretches() -> tuple[np.ndarray, np.ndarray]:
    """(steps of all bands in ascending order, first place of each band among them and the end): stretches in equal parts of every octave."""
    rng = np.random.default_rng(13)
    steps, first = [], [0]
    for o in range(4, OCTAVES):
        width = min(STRETCH, 1 << o)
        parts = max(1, min(PER_BAND_OCTAVE, (1 << o) // STRETCH))
        for i in range(parts):
            lo, room = (1 << o) + i * ((1 << o) // parts), (1 << o) // parts - width
            steps.append(lo + int(rng.integers(0, room + 1)) + np.arange(width))
            first.append(first[-1] + width)
    return np.concatenate(steps), np.array(first)


def _classes(codes: np.ndarray) -> bytes:
    mult = _tables()[1]
    return ((codes.astype(np.uint64) * mult >> np.uint64(13)) & np.uint64(255)).astype(np.uint8).tobytes()


class Walk:
    """The walk over a text; ``at`` and ``near`` hold the character under each sampled step and each step of a band reached so far."""

    def __init__(self, step: int = 0, at: list[np.ndarray] | None = None, near: list[np.ndarray] | None = None):
        self.step = step
        self.at = list(at or [])
        self.near = list(near or [])

    def over(self, codes: np.ndarray) -> Walk:
        wait, _, sample, _ = _tables()
        j = self.step
        mask = _PHASES - 1
        for lo in range(0, len(codes), _CHUNK):
            part = codes[lo : lo + _CHUNK]
            first = j
            ends = []
            put = ends.append
            for c in _classes(part):
                j += wait[c][j & mask]
                put(j)
            reached = np.array(ends, np.int64)
            for steps, kept in ((sample, self.at), (_stretches()[0], self.near)):
                a, b = np.searchsorted(steps, (first, j))
                if b > a:
                    kept.append(part[np.searchsorted(reached, steps[a:b], "right")])
        self.step = j
        return self

    def copy(self) -> Walk:
        return Walk(self.step, self.at, self.near)

    def bands(self) -> list[int]:
        """One key for each band that the walk has passed: its number and one hashed bit of the character at each of its steps."""
        first = _stretches()[1]
        got = np.concatenate(self.near) if self.near else np.zeros(0, np.uint32)
        n = int(np.searchsorted(first, len(got), "right")) - 1
        if n < 1:
            return []
        bit = _hashed_bits(got[: first[n]], np.arange(first[n], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
        place = np.arange(first[n]) - np.repeat(first[:n], np.diff(first[: n + 1]))
        keys = np.add.reduceat(bit.astype(np.int64) << place, first[:n])
        return [(i << 32) | int(k) for i, k in enumerate(keys)]

    def bits(self) -> np.ndarray:
        """One hashed bit of the character at each sampled step that the walk reached."""
        got = np.concatenate(self.at) if self.at else np.zeros(0, np.uint32)
        return _hashed_bits(got, _tables()[3][: len(got)])


def _hashed_bits(codes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = (codes.astype(np.uint64) + np.uint64(1)) * salt
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(63)).astype(np.uint8)


def encoded(steps: int, bits: np.ndarray) -> str:
    """The fingerprint as text: steps of the walk, then the sampled bits in hex."""
    return f"{steps:x}-{np.packbits(bits).tobytes().hex()}"


def decoded(fingerprint: str) -> tuple[int, np.ndarray]:
    steps, _, bits = fingerprint.partition("-")
    n = int(steps, 16)
    return n, np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8), count=int(np.searchsorted(_tables()[2], n)))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share, 0 to 1, of the longer walk's steps at which both walks write the same character."""
    (m, x), (n, y) = a, b
    if m == 0 or n == 0:
        return float(m == n)
    if m == n and np.array_equal(x, y):
        return 1.0
    sample = _tables()[2]
    k = min(len(x), len(y))
    same = np.concatenate(([0], np.cumsum(x[:k] == y[:k])))
    top = max(m, n)
    total = 0.0
    lo = 0
    while lo < min(m, n):
        hi = 1 if lo == 0 else 2 * lo
        i, j = np.searchsorted(sample, (lo, min(hi, m, n)))
        if j > i:
            agree = (same[j] - same[i]) / (j - i)
            total += (2 * agree - 1) * (min(hi, m, n) - lo)
        lo = hi
    return float(min(1.0, max(0.0, total / top)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Row:
    """A text on its way: walked in two parts, so that the edited text shares the first one's walk."""

    def __init__(self, id, text: str):
        self.id, self.text = id, text
        codes = _codes(text)
        self.n = len(codes)
        cut = self.n - self.n // 2
        self.half = Walk().over(codes[:cut])
        self.whole = self.half.copy().over(codes[cut:])
        self.print = (self.whole.step, self.whole.bits())


def _with_next(batches):
    """Rows ordered within each shard: each is finished when its successor has come; a shard's last row is only a successor."""
    prev, prev_shard = None, None
    for b in batches:
        out = []
        for shard, tail, id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            row = _Row(id, text or "")
            if prev is not None and prev_shard == shard:
                out.append(_finished(prev, row))
            prev, prev_shard = (None if tail else row), shard
        cols = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_NAMES)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_candidate"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_candidate boolean"


def _finished(row: _Row, after: _Row) -> tuple:
    gone = row.n // 2
    new = after.text[:gone]
    edited_text = row.text[: row.n - gone] + new
    walk = row.half.copy().over(_codes(new))
    edited = (walk.step, walk.bits())
    shared = not set(row.whole.bands()).isdisjoint(walk.bands())
    return (
        row.id, row.n, hashlib.sha256(edited_text.encode("utf-8", "surrogatepass")).hexdigest(), encoded(*row.print), encoded(*edited),
        likeness(row.print, edited), likeness(row.print, after.print), shared,
    )


def fingerprint_with_edit(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, its edited text's and its likeness to that and to the next row's text.

    The edited text has the last floor(n / 2) of its n characters replaced by as many first ones of
    the next row, ascending id. Rows go to shards by quantiles of the id, in one shuffle; the first
    row of each shard also goes, as an end mark, to the shard before, so every row meets its successor.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    shard = F.coalesce(_place(F.col("doc_id"), cuts), F.lit(0))
    keyed = rows.select(shard.alias("shard"), "doc_id", "text")
    firsts = keyed.groupBy("shard").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("o"), "doc_id")).alias("m")).select("shard", "m.doc_id").collect()
    order = sorted(firsts, key=lambda r: r["shard"])
    before = {r["shard"]: order[i - 1]["shard"] for i, r in enumerate(order)}
    marks = spark.createDataFrame([(r["shard"], r["doc_id"], before[r["shard"]]) for r in order], "shard int, first long, before int")
    # rows that repeat a shard's first id all go to the shard before; the least text of them is the one that follows
    goes = F.array(F.struct("shard", F.lit(False).alias("tail")))
    also = F.array(F.struct("shard", F.lit(False).alias("tail")), F.struct(F.col("before").alias("shard"), F.lit(True).alias("tail")))
    to = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), also).otherwise(goes)).alias("to")
    both = keyed.join(F.broadcast(marks), "shard", "left").select(to, "doc_id", "text").select("to.shard", "to.tail", "doc_id", "text")
    dealt = both.repartition(n, "shard").sortWithinPartitions("shard", "tail", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return dealt.select("shard", "tail", "doc_id", "text").mapInArrow(_with_next, _SCHEMA)


def _place(x, cuts: list[int]):
    """How many of the ascending cuts are at most x (binary search; null for null)."""
    if not cuts:
        return F.when(x.isNotNull(), F.lit(0))
    table = F.expr(f"array({','.join(f'{c}L' for c in cuts)})")
    found = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        up = (acc["lo"] < acc["hi"]) & (F.get(table, mid) <= x)
        down = (acc["lo"] < acc["hi"]) & ~(F.get(table, mid) <= x)
        return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(down, mid).otherwise(acc["hi"]).alias("hi"))

    return F.when(x.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), found, step, lambda a: a["lo"]))


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, bands) of every row, without a shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            walks = [Walk().over(_codes(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([encoded(w.step, w.bits()) for w in walks], pa.string()), pa.array([w.bands() for w in walks], pa.list_(pa.int64()))], names=["id", "fingerprint", "bands"]
            )

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string, bands array<long>")


def _runs(codes: np.ndarray, length: int, bins: int) -> np.ndarray:
    """How often runs of so many characters occur, by values of their hash."""
    n = max(0, len(codes) - length + 1)
    h = np.zeros(n, np.uint64)
    for i in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n] + np.uint64(1)
    return np.bincount((mix(h) % np.uint64(bins)).astype(np.int64), minlength=bins)


def _counts(codes: np.ndarray) -> np.ndarray:
    """Counts of the runs of ``GRAM`` characters; 255 stands for that and more."""
    return np.minimum(_runs(codes, GRAM, GRAM_BINS), 255).astype(np.uint8)


def _looks(texts: DataFrame) -> DataFrame:
    """(id, n, bands, counts) of every row (id, text) that has a band."""

    def run(batches):
        for b in batches:
            codes = [_codes(t) for t in b.column(1).to_pylist()]
            bands = [Walk().over(c).bands() for c in codes]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(c) for c in codes], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array([_counts(c).tobytes() for c in codes], pa.binary())],
                names=["id", "n", "bands", "counts"],
            )

    return texts.select("id", "text").mapInArrow(run, "id long, n long, bands array<long>, counts binary").where(F.size("bands") > 0)


def _by_length(n, max_edits: float):
    """Numbers of the lists by length that a text of n characters is in: its own, and those of the shortest texts that may be linked to it."""
    width = max(0.2, -4 * math.log(1 - min(max_edits, 0.9)))
    least = F.greatest(n * (1 - max_edits), F.lit(1.0))
    return F.sequence(F.floor(F.log(least) / width - 1e-9), F.floor(F.log(n) / width))


def _possible(members: DataFrame, pivots: DataFrame, looks: DataFrame, max_edits: float) -> DataFrame:
    """Distinct (a, b): each pivot with the members of its lists, of other components, that lengths and counts do not rule out."""
    rows = _dealt(members).select("v", "part", F.lit(1).alias("role"), "rep", "label", "n")
    rows = rows.unionByName(_copied(pivots).select("v", "part", F.lit(0).alias("role"), "rep", "label", "n"))
    rows = rows.join(looks.select(F.col("id").alias("rep"), "counts"), "rep").select("v", "part", "role", "rep", "label", "n", "counts")

    def found(pieces: list[tuple]) -> list[np.ndarray]:
        """The pairs of one list, pivots first, then members by length."""
        _, _, role, rep, label, n, counts = pieces[0] if len(pieces) == 1 else (np.concatenate(c) for c in zip(*pieces, strict=True))
        p = int(np.searchsorted(role, 1))
        if p == 0:
            return []
        counts = counts.astype(np.int16)
        sums = counts.reshape(len(counts), GRAM_SUMS, -1).sum(2, dtype=np.int32)
        first = p + np.searchsorted(n[p:], n[:p] * (1 - max_edits) - 1)
        end = np.full(p, len(n)) if max_edits >= 1 else p + np.searchsorted(n[p:], n[:p] / (1 - max_edits) + 1, "right")
        out = []
        for i in range(p):
            at = slice(first[i], end[i])
            limit = (max_edits * np.maximum(n[at], n[i])).astype(np.int64)
            left = first[i] + np.flatnonzero((label[at] != label[i]) & (abs(n[at] - n[i]) <= limit))
            for of in (sums, counts):
                if len(left):
                    left = left[np.abs(of[left] - of[i]).sum(1, dtype=np.int64) <= 2 * GRAM * limit[left - first[i]]]
            if len(left):
                out.append(np.stack((np.minimum(rep[left], rep[i]), np.maximum(rep[left], rep[i]))))
        return out

    def compare(batches):
        pieces: list[tuple] = []
        for b in batches:
            if not len(b):
                continue
            out = []
            cols = [b.column(i).to_numpy() for i in range(6)]
            bytes_ = b.column(6)
            cols.append(np.frombuffer(bytes_.buffers()[2], np.uint8)[: (bytes_.offset + len(b)) * GRAM_BINS].reshape(-1, GRAM_BINS)[bytes_.offset :])
            cuts = (np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if pieces and (pieces[-1][0][0], pieces[-1][1][0]) != (cols[0][lo], cols[1][lo]):
                    out += found(pieces)
                    pieces = []
                pieces.append(tuple(c[lo:hi] for c in cols))
            pieces[-1] = tuple(c.copy() for c in pieces[-1])
            yield _pairs(out)
        yield _pairs(found(pieces) if pieces else [])

    dealt = rows.repartition(partitions(members.sparkSession), "v", "part").sortWithinPartitions("v", "part", "role", "n")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, max_edits: float) -> DataFrame:
    """(a, b, edits) of the pairs within ``max_edits`` of the longer text's length; ``texts``: id, text."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("edits", T.LongType())])

    def near(rows: list[tuple]) -> pa.RecordBatch:
        limits = [int(max_edits * max(len(x), len(y))) for _, _, x, y in rows]
        found = edit_distances([(x, y) for _, _, x, y in rows], limits)
        got = [(a, b, d) for (a, b, _, _), d, limit in zip(rows, found, limits, strict=True) if d <= limit]
        cols = list(zip(*got, strict=True)) if got else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "edits"])

    def verify(batches):
        rows, chars = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows.append(row)
                chars += len(row[2]) + len(row[3])
                if len(rows) >= GATHERED or chars >= GATHERED_CHARS:
                    yield near(rows)
                    rows, chars = [], 0
        yield near(rows)

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(verify, schema)


def _closed(docs: DataFrame, max_edits: float, id: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their class of equal texts, verified links, labels of the linked): id null or rows that repeat an id keep their own texts' classes."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = scratch.put(rows.select("id", F.sha2("text", 256).alias("h")))
    least = named.where("id is not null").groupBy("h").agg(F.min("id").alias("rep"))
    # of an id's several texts the one of least hash stands for the id
    first = scratch.put(least.groupBy("rep").agg(F.min("h").alias("h")))
    mine = rows.withColumn("h", F.sha2("text", 256)).join(first.select(F.col("rep").alias("id"), "h"), ["id", "h"], "left_semi").select("id", "text")
    texts = mine.groupBy("id").agg(F.min("text").alias("text"))
    looks = scratch.put(_looks(texts))
    member = looks.select(F.explode("bands").alias("v"), F.col("id").alias("rep"), "n")
    member = member.select("v", "rep", "n", F.explode(_by_length(F.col("n"), max_edits)).alias("i")).select((F.shiftleft("v", 10) + F.col("i")).alias("v"), "rep", "n")
    size = scratch.put(member.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    # any two members of a list may be linked, if their lengths allow it
    lists = member.join(size, "v").select("v", "rep", F.lit(0).alias("pop"), "n", F.lit(2**62).alias("most"), "df", *(F.lit(None).cast("double").alias(c) for c in ("f", "s", "c")))
    lists = scratch.put(_merged(lists))
    needed = scratch.put(texts.join(small(lists.select(F.col("rep").alias("id")).distinct()), "id", "left_semi"))
    spark = docs.sparkSession
    labels = scratch.put(spark.createDataFrame([], "node long, label long"))
    done = lists.select("v", "rep").limit(0)
    links, seen, grow = scratch.put(spark.createDataFrame([], "a long, b long, edits long")), [], 1
    while True:
        open_ = scratch.put(_open_members(lists, labels, done, scratch))
        if not open_.head(1):
            scratch.keep(named, links, labels)
            return named, links, labels
        picked = scratch.put(_next_pivots(open_, grow))
        grow = min(8 * grow, 4096)
        pairs = _possible(open_, picked, looks, max_edits)
        for old in seen:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = scratch.put(pairs)
        seen.append(pairs)
        done = done.unionByName(picked.select("v", "rep"))
        found = scratch.put(_verified(pairs, needed, max_edits))
        if found.head(1):
            links = scratch.put(links.unionByName(found))
            labels = components(links, scratch)


def similar(docs: DataFrame, *, max_edits: float = 0.1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, edits): verified links between the least ids of different texts, enough of them to connect all that share a band and are linked.

    Equal texts are linked to their least id, with 0 edits.
    """
    ship(docs.sparkSession)
    named, links, _ = _closed(docs, max_edits, id, text, Scratch(docs.sparkSession, "edits"))
    least = named.where("id is not null").groupBy("h").agg(F.min("id").alias("a"))
    equal = named.join(least, "h").where("id <> a").select("a", F.col("id").alias("b"), F.lit(0).cast("long").alias("edits")).distinct()
    return links.unionByName(equal)


def near_texts(docs: DataFrame, *, max_edits: float = 0.05, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, copy_of, class_id) of every row: the least id of an equal text, and of all that verified links reach from there.

    ``max_edits`` is a share of the longer text's length. A null id is linked with nothing.
    """
    ship(docs.sparkSession)
    named, _, labels = _closed(docs, max_edits, id, text, Scratch(docs.sparkSession, "near-texts"))
    least = named.where("id is not null").groupBy("h").agg(F.min("id").alias("copy_of"))
    out = named.join(least, "h", "left").withColumn("copy_of", F.when(F.col("id").isNotNull(), F.col("copy_of")))
    out = out.join(labels.select(F.col("node").alias("copy_of"), "label"), "copy_of", "left")
    return out.select("id", "copy_of", F.coalesce("label", "copy_of").alias("class_id"))


def edit_distance(a: str, b: str, limit: int) -> int:
    """Edit distance of two texts, or ``limit + 1`` if it is larger.

    Edit by edit, the furthest place on every diagonal at once; how far two texts agree from a place on follows from
    prefix hashes by bisection. Diagonals from which the end cannot be reached any more are dropped. Texts more than one
    edit in ``PER_EDIT`` characters apart go column by column instead, which costs the same for any number of edits.
    """
    x, y = _codes(a), _codes(b)
    n, m = len(x), len(y)
    if abs(n - m) > limit:
        return limit + 1
    if a == b:
        return 0
    top = max(n, m)
    power, inverse = _power_tables(top + 1)
    hx, hy = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(c.astype(np.uint64) + np.uint64(1)) * power[: len(c)], dtype=np.uint64))) for c in (x, y))

    def slide(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far x from i and y from j agree."""
        out = np.zeros(len(i), np.int64)
        on = np.flatnonzero((i < n) & (j < m))
        on = on[x[i[on]] == y[j[on]]]
        p, q = i[on], j[on]
        lo, hi = np.ones(len(on), np.int64), np.minimum(n - p, m - q)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (hx[p + mid] - hx[p]) * inverse[p] == (hy[q + mid] - hy[q]) * inverse[q]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[on] = lo
        return out

    # far[k] is the furthest place in x on diagonal k = i - j; -2: not reached
    k = np.zeros(1, np.int64)
    far = slide(k, k)
    end = n - m
    few = min(limit, top // PER_EDIT)
    for d in range(1, few + 1):
        reach = limit - d
        lo, hi = max(-d, end - reach, -m), min(d, end + reach, n)
        new = np.arange(lo, hi + 1)
        old = np.full(hi - lo + 3, -2, np.int64)
        inside = (k >= lo - 1) & (k <= hi + 1)
        old[k[inside] - lo + 1] = far[inside]
        i = np.maximum(np.maximum(old[:-2] + 1, old[1:-1] + 1), old[2:])
        i = np.minimum(i, np.minimum(n, m + new))
        ok = (i >= 0) & (i - new >= 0)
        i = np.where(ok, i, 0)
        step = slide(i, np.where(ok, i - new, 0))
        far, k = np.where(ok, i + step, -2), new
        if lo <= end <= hi and far[end - lo] == n:
            return d
    return limit + 1 if few == limit else _banded(a, b, limit)


def _banded(a: str, b: str, limit: int) -> int:
    """``edit_distance``, character by character of the shorter text, by bit operations on a band of the longer one.

    A band has 2 * ``limit`` + 2 bits, one for each place that ``limit`` edits can reach; ``vp`` and ``vn`` say where the
    distance rises or falls from one place to the next.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    most, limit = limit, min(limit, n)
    if n - m > limit:
        return most + 1
    places: dict[str, bytearray] = {}
    for i, c in enumerate(a):
        if c not in places:
            places[c] = bytearray(n // 8 + 1)
        places[c][i >> 3] |= 1 << (i & 7)
    at = {c: int.from_bytes(bits, "little") for c, bits in places.items() if c in b}
    width = 2 * limit + 2
    mask = (1 << width) - 1
    vp, vn = mask << (width - limit - 1) & mask, 0
    first, diagonal, side = limit + 1 - width, 1 << (width - 1), 1 << max(width - 2, 0)
    d, give = limit, 2 * limit + m - n
    for i, c in enumerate(b):
        x = at.get(c, 0)
        x = (x >> first if first >= 0 else x << -first) & mask
        first += 1
        d0 = (((x & vp) + vp ^ vp) | x | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        if i < n - limit:
            d += not d0 & diagonal
        else:
            d += bool(hp & side) - bool(hn & side)
            side >>= 1
        if d > give:
            return most + 1
        d0 >>= 1
        vp, vn = (hn | ~(d0 | hp)) & mask, d0 & hp
    return d if d <= limit else most + 1


def edit_distances(pairs: list[tuple[str, str]], limits: list[int]) -> list[int]:
    """``edit_distance`` of every pair; bands of at most ``LANE_WORDS`` words go side by side, column by column of all of them at once.

    Where the limit is high, counts of runs of four characters may show that there are more edits.
    """
    out = [limit + 1 for limit in limits]
    lanes: dict[int, list[tuple]] = {}
    for i, ((a, b), limit) in enumerate(zip(pairs, limits, strict=True)):
        if len(a) < len(b):
            a, b = b, a
        if len(a) - len(b) > limit or limit >= MANY_EDITS and np.abs(_runs(_codes(a), 4, 1 << 16) - _runs(_codes(b), 4, 1 << 16)).sum() > 8 * limit:
            continue
        words = next((w for w in LANE_WORDS if 32 * w > limit), 0)
        lanes.setdefault(words if len(a) >= 32 * words else 0, []).append((len(b), i, a, b))
    for words, group in lanes.items():
        group.sort()
        for lo in range(0, len(group), LANES):
            part = group[lo : lo + LANES]
            most = [limits[i] for _, i, _, _ in part]
            if words and len(part) >= FEWEST:
                found = _side_by_side(part, words, most)
            else:
                found = [edit_distance(a, b, limit) for (_, _, a, b), limit in zip(part, most, strict=True)]
            for (_, i, _, _), d in zip(part, found, strict=True):
                out[i] = d
    return out


def _side_by_side(group: list[tuple], words: int, limits: list[int]) -> list[int]:
    """``_banded`` for (length of the shorter text, _, longer, shorter text) of every pair, with bands of ``words`` words; first axis: words."""
    half, width = 32 * words, 64 * words
    texts = [(_codes(a), _codes(b)) for _, _, a, b in group]
    n, m = (np.array([len(t[i]) for t in texts]) for i in (0, 1))
    k, lane = np.array(limits), np.arange(len(group))
    top = max(int(c.max()) for t in texts for c in t)
    kind = np.uint8 if top < 255 else np.uint16 if top < 65535 else np.uint32
    columns = int(m.max())
    # 0 is no character; the window of column i begins at place i
    long_, short = np.zeros((len(group), columns + width), kind), np.zeros((columns, len(group)), kind)
    for r, (a, b) in enumerate(texts):
        long_[r, half : half + len(a)] = a + 1
        short[: len(b), r] = b + 1
    zero, one, last, full = np.uint64(0), np.uint64(1), np.uint64(63), np.uint64(2**64 - 1)
    number = np.arange(words, dtype=np.uint64)[:, None]
    place = one << number
    start = ((1 << width) - 1) >> half << half
    vp = np.repeat(np.array([start >> 64 * w & (2**64 - 1) for w in range(words)], np.uint64)[:, None], len(group), 1)
    vn = np.zeros_like(vp)
    d, give, turn = np.full(len(group), half - 1), k + half - 1 + m - n, n - half + 1
    found = np.zeros(len(group), np.int64)
    for i in range(columns):
        if i % 32 == 0:
            over = (i >= m) | (d > give)
            if 8 * int(over.sum()) >= len(over):
                found[lane[over]] = d[over]
                on = ~over
                lane, d, give, turn, m, vp, vn = lane[on], d[on], give[on], turn[on], m[on], vp[:, on], vn[:, on]
                long_, short = long_[on], short[:, on]
                if not len(lane):
                    break
            soonest = int(turn.min())
        x = np.packbits(long_[:, i : i + width] == short[i][:, None], axis=1, bitorder="little").view(np.uint64).T.copy()
        both = x & vp
        total = both + vp
        if words > 1:
            # of a word per bit: those that carry, and those that pass a carry on; a sum of them tells where carries go
            passed = np.where(total == full, place, zero).sum(0)
            goes = (np.where(total < both, place, zero).sum(0) << one) + passed ^ passed
            total += goes >> number & one
        d0 = (total ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        if i < soonest:
            d += (~d0[-1] >> last).astype(np.int64)
        else:
            at = np.clip(width - 2 - (i - turn), 0, width - 1)
            w, bit, r = at >> 6, (at & 63).astype(np.uint64), np.arange(len(lane))
            side = (hp[w, r] >> bit & one).astype(np.int64) - (hn[w, r] >> bit & one).astype(np.int64)
            d += np.where(i < turn, (~d0[-1] >> last).astype(np.int64), np.where(i < m, side, 0))
        moved = d0 >> one
        moved[:-1] |= d0[1:] << last
        vp, vn = hn | ~(moved | hp), moved & hp
    found[lane] = d
    return np.minimum(found, k + 1).tolist()
