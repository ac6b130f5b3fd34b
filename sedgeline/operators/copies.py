"""Near copies by SimHash: links per document, clusters with a representative, and what is like one fingerprint.

At most h of 64 bits may differ, so of more than h blocks of bits some agree: rows are dealt to lists by the bits of one or
more blocks, enough for lists of about ``LIST`` rows. Equal hashes are one class. Inside a list links are found by Arrow
batches of bit operations; clusters need a spanning set of links only, found by a search that looks at each
member it has not reached yet, so a large cluster costs its size and not its square. A list that stays longer (many
texts that agree in those bits) is dealt to pairs of pieces of ``LIST`` rows, so no task holds more than two pieces.

Where hashes crowd together so that the lists would compare more than all pairs have to be (a sample of the hashes tells),
and on small tables, links are counted over all pairs of pieces of the hashes instead. In a pair of pieces the hashes are
in the order of their distance from one middle, so each is compared only with those whose distance is not too far off; the
same comparisons give the links that connect what is not connected yet.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import similarity, simhash
from ..shipping import ship
from .cc import kept, labels

LIST = 20_000
#: Hashes of a piece where all pairs are compared, least and most, and the number of pieces between; hashes of the sample that tells which way is shorter.
PIECE, PIECES, SAMPLE = (8_192, 32_768), 8, 4_096
#: How much longer a comparison in a list takes than one of all pairs.
LIST_COST = 2.0
#: Pairs of labels up to which they are connected on the driver.
FEW = 50_000
#: Bodies of fewer characters, trimmed, are at most 50 percent like anything (fixed values).
SHORT, SHORT_CAP = 64, 50


def prints(docs: DataFrame, path: str, body: str) -> DataFrame:
    """(id, simhash, short) of the texts that are not blank."""
    trimmed = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = docs.select(F.col(path).alias("id"), trimmed.alias("_sl_t")).where("_sl_t <> ''")
    return rows.select("id", simhash("_sl_t").alias("simhash"), (F.length("_sl_t") < SHORT).alias("short"))


def similar_to(found: DataFrame, reference: int, threshold: int) -> DataFrame:
    """(id, simhash, similarity) of the rows of (id, simhash) at least ``threshold`` percent like a SimHash, but not equal to it."""
    s = similarity(F.col("simhash"), F.lit(reference).cast("long"))
    return found.where(F.col("simhash") != reference).select("id", "simhash", s.alias("similarity")).where(F.col("similarity") >= threshold).orderBy("id")


def _most_differ(threshold: int) -> int:
    """How many of 64 bits may differ at ``threshold`` percent."""
    if not 0 <= threshold <= 100:
        raise ValueError("a threshold is a number of percent")
    return next(h for h in range(64, -1, -1) if (64 - h) * 100 // 64 >= threshold)


def _keys(h: int, n: int) -> list[int]:
    """Masks of bits such that hashes with at most h different bits agree under one of them, with as many bits as n rows ask for."""
    best = [(1 << 64) - 1] if h == 0 else [0]
    for extra in range(1, 64 - h + 1):
        if h == 0 or h + extra > 64:
            break
        m = h + extra
        edges = [64 * i // m for i in range(m + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        best = [sum(c) for c in combinations(blocks, extra)]
        if n <= LIST * 2 ** (64 * extra // m) or len(best) > 250:
            break
    return best


def _lists(classes: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, lo, hi, h, w): members of the lists, long lists dealt to pairs of pieces."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    at = F.posexplode(F.expr(f"array({','.join(f'{m}L' for m in signed)})".replace(f"{-(1 << 63)}L", "-9223372036854775807L - 1L")))
    dealt = classes.select("h", "w", at.alias("mask", "bits")).withColumn("key", F.col("h").bitwiseAND(F.col("bits"))).drop("bits")
    size = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("pieces", F.ceil(F.col("n") / LIST).cast("int"))
    dealt = dealt.join(size.drop("n"), ["mask", "key"]).withColumn("piece", F.pmod(F.xxhash64("h"), F.col("pieces")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return other.select("mask", "key", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "piece", "h", "w")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning(classes: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links between different SimHashes of (h, w) that connect all that are ``threshold`` percent alike."""
    most = _most_differ(threshold)
    ship(classes.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        h = np.unique(group["h"].to_numpy())
        left, out = h.view(np.uint64), []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = _distance(left, x) <= most
                if near.any():
                    out.append((np.full(near.sum(), x, np.uint64), left[near]))
                    queue += list(left[near])
                    left = left[~near]
        a, b = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64),) * 2
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = _lists(classes, _keys(most, classes.count()))
    return dealt.groupBy("mask", "key", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def links(found: DataFrame, threshold: int = 85) -> DataFrame:
    """(id, class, n_links) of the rows of (id, simhash): the least id that can be reached, and how many other rows are alike.

    A link between two hashes counts in the first list that both are in.
    """
    most = _most_differ(threshold)
    # hashed once: several steps read them
    found = kept(found)
    classes = found.groupBy(F.col("simhash").alias("h")).agg(F.count("*").alias("w"), F.min("id").alias("least"))
    n = classes.count()
    masks = _keys(most, n)
    ship(found.sparkSession)
    if _crowded(classes, n, masks):
        per, reached = _all_pairs(classes.select("h", "w"), n, most)
    else:
        per, reached = _listed(classes.select("h", "w"), masks, most), _reached(classes, threshold)
    group = _classes(classes, reached)
    sums = classes.join(per, "h", "left").join(group, "h").select("h", "class", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    return found.join(sums, found.simhash == sums.h).select("id", "class", "n_links")


def _crowded(classes: DataFrame, n: int, masks: list[int]) -> bool:
    """Whether comparing all pairs of n hashes takes less time than comparing those of the lists; decides on the way only, not on the result."""
    if n <= PIECES * PIECE[0]:
        return True
    rows = classes.where(F.pmod(F.xxhash64("h"), F.lit(-(-n // SAMPLE))) == 0).select("h").toPandas()["h"]
    h = rows.to_numpy(np.int64).view(np.uint64)
    met = sum(int((c * (c - 1)).sum()) for c in (np.unique(h & np.uint64(m), return_counts=True)[1] for m in masks))
    return met * LIST_COST > len(h) * (len(h) - 1) / 2


def _listed(classes: DataFrame, masks: list[int], most: int) -> DataFrame:
    """(h, n): how many rows have another hash of at most ``most`` different bits, found in the lists."""
    own = np.array(masks, np.uint64)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first, lo, hi = int(group["mask"].iloc[0]), group["lo"].iloc[0], group["hi"].iloc[0]
        h, w, piece = group["h"].to_numpy().view(np.uint64), group["w"].to_numpy(), group["piece"].to_numpy()
        n = np.zeros(len(h), np.int64)
        for at in range(0, len(h), 256):
            x = h[at : at + 256, None] ^ h[None, :]
            near = (np.bitwise_count(x) <= most) & (x != 0)
            if lo != hi:
                near &= piece[at : at + 256, None] != piece[None, :]
            i, j = np.nonzero(near)
            seen = np.zeros(len(i), bool)
            for m in own[:first]:
                seen |= (x[i, j] & m) == 0
            n[at : at + 256] += np.bincount(i[~seen], w[j[~seen]], minlength=len(n[at : at + 256])).astype(np.int64)
        return pd.DataFrame({"h": h.view(np.int64), "n": n})[n > 0]

    return _lists(classes, masks).groupBy("mask", "key", "lo", "hi").applyInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _tile(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """(h, n, to) of a pair of pieces (h, w, label, piece, lo, hi): n rows of the other piece are near h, and h is now labelled ``to``.

    Rows without n say which labels h the near hashes of the two pieces connect with the label ``to``.
    """
    lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
    every = group["h"].to_numpy().view(np.uint64)
    bits = (every[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)
    middle = np.uint64(sum(1 << b for b in np.flatnonzero(2 * bits.sum(axis=0) > len(every)).tolist()))
    del bits
    far = _distance(every, middle)
    order = np.argsort(far, kind="stable")
    every, far = every[order], far[order].astype(np.int64)
    weight, piece = group["w"].to_numpy()[order].astype(np.int64), group["piece"].to_numpy()[order]
    names, label = np.unique(group["label"].to_numpy()[order], return_inverse=True)
    label = label.astype(np.int32)
    rows, cols = np.flatnonzero(piece == lo), np.flatnonzero(piece == hi)
    y, mine, theirs = every[cols], label[rows], label[cols]
    # how many hashes have a label, and where: a label that one hash has is changed there alone
    held = np.bincount(label, minlength=len(names))
    first, last = np.searchsorted(far[cols], far[rows] - most, "left"), np.searchsorted(far[cols], far[rows] + most, "right")
    if lo == hi:
        first, mine = np.arange(1, len(rows) + 1), theirs
    heavy = np.flatnonzero(weight[cols] > 1)
    more = weight[cols][heavy] - 1
    hx, hy = np.searchsorted(heavy, first), np.searchsorted(heavy, last)
    nx, ny, batch = np.zeros(len(rows), np.int64), np.zeros(len(cols), np.int64), np.zeros(len(cols), np.uint8)
    mixed, diff, near = np.empty(len(cols), np.uint64), np.empty(len(cols), np.uint8), np.empty(len(cols), bool)
    other, of = near, -1
    for i, (u, w, a, b, p, q) in enumerate(zip(every[rows], weight[rows].tolist(), first.tolist(), last.tolist(), hx.tolist(), hy.tolist(), strict=True)):
        if i % 255 == 254:
            ny += batch
            batch[:] = 0
        if a >= b:
            continue
        m = near[a:b]
        np.bitwise_xor(y[a:b], u, out=mixed[a:b])
        np.bitwise_count(mixed[a:b], out=diff[a:b])
        np.less_equal(diff[a:b], most, out=m)
        n = np.count_nonzero(m)
        if not n:
            continue
        nx[i] += n + int(more[p:q][near[heavy[p:q]]].sum())
        batch[a:b] += m.view(np.uint8)
        if w > 1:
            ny[a:b] += m * (w - 1)
        own = mine[i]
        if own != of:
            other, of = theirs != own, own
        m &= other[a:b]
        if not m.any():
            continue
        at, found = np.flatnonzero(m) + a, []
        while len(at) and len(found) < 8:
            found.append((theirs[at[0]], at[0]))
            at = at[theirs[at] != found[-1][0]]
        if len(at):
            l, k = np.unique(theirs[at], return_index=True)
            found += zip(l, at[k], strict=True)
        merged = [(own, -1), *found]
        to = max(merged, key=lambda l: held[l[0]])[0]
        for l, j in merged:
            if l == to:
                continue
            if held[l] > 1:
                mine[mine == l] = to
                theirs[theirs == l] = to
            elif j < 0:
                mine[i] = to
            else:
                theirs[j] = to
            held[to] += held[l]
        of = -1
    ny += batch
    n = np.zeros(len(every), np.int64)
    n[rows] += nx
    n[cols] += ny
    # the label of a group is the least that it had; one that the lower piece had, if any
    after = np.zeros(len(every), np.int64)
    after[rows], after[cols] = mine, theirs
    least = np.full(len(names), len(names))
    np.minimum.at(least, after[cols], label[cols])
    if lo != hi:
        held = np.full(len(names), len(names))
        np.minimum.at(held, after[rows], label[rows])
        least = np.where(held < len(names), held, least)
    to = names[least[after]]
    counts = pd.DataFrame({"h": every.view(np.int64), "n": n, "to": to})
    moved = names[label] != to
    if lo == hi == 0:
        return counts
    if lo == 0:
        moved[cols] = False
    pairs = np.unique(np.stack([names[label[moved]], to[moved]], axis=1), axis=0)
    return pd.concat([counts, pd.DataFrame({"h": pairs[:, 0], "n": pd.array([None] * len(pairs), "Int64"), "to": pairs[:, 1]})])


def _all_pairs(classes: DataFrame, n: int, most: int) -> tuple[DataFrame, DataFrame]:
    """((h, n), (h, label)) of (h, w): as of the lists, over all pairs of pieces of the n hashes; the least hash that can be reached.

    The first piece is compared with itself, then with every other, then these with one another, so that nearly all that is
    connected is known before and few labels are left to be connected.
    """
    pieces = max(min(PIECES, -(-n // PIECE[0])), -(-n // PIECE[1]), 1)
    dealt = classes.withColumn("piece", F.pmod(F.xxhash64("h"), F.lit(pieces)).cast("int"))

    def compared(rows: DataFrame, first: int, last: int) -> DataFrame:
        """Of the first piece with itself (0, 0), with all others (0, last), or of the others with themselves and one another (1, last)."""
        if last == 0:
            pairs = [(0, 0)]
        else:
            pairs = [(lo, hi) for lo in range(first, last + 1 if first else 1) for hi in range(max(lo, 1), last + 1)]
        tiles = rows.sparkSession.createDataFrame([(p, lo, hi) for lo, hi in pairs for p in {lo, hi}], "piece int, lo int, hi int")
        return kept(rows.join(F.broadcast(tiles), "piece").groupBy("lo", "hi").applyInPandas(lambda g: _tile(g, most), "h long, n long, to long"))

    def relabelled(rows: DataFrame, found: DataFrame) -> DataFrame:
        pairs = found.where("n is null and h <> to").select(F.col("h").alias("a"), F.col("to").alias("b"))
        known = _few_labels(pairs).select(F.col("node").alias("label"), F.col("label").alias("least"))
        return rows.join(known, "label", "left").select("h", "w", "piece", F.coalesce("least", "label").alias("label"))

    rows = dealt.withColumn("label", F.col("h"))
    counted = compared(rows, 0, 0)
    for first, last in ((0, pieces - 1), (1, pieces - 1))[: pieces - 1]:
        if first == 0:
            own = counted.select("h", F.col("to").alias("label"))
            rows = rows.drop("label").join(own, "h", "left").withColumn("label", F.coalesce("label", "h"))
        found = compared(rows, first, last)
        if first == 0:
            # of the first piece every hash has its label, of the others the pair with the first piece gives it
            own = own.unionByName(found.where("n is not null").join(own.select("h"), "h", "left_anti").select("h", F.col("to").alias("label")))
            rows = rows.drop("label").join(own, "h").select("h", "w", "piece", "label")
        counted = counted.unionByName(found.where("n is not null"))
        rows = kept(relabelled(rows, found))
    if pieces == 1:
        rows = counted.select("h", F.col("to").alias("label"))
    return counted.where("n > 0").groupBy("h").agg(F.sum("n").alias("n")), rows.select("h", "label")


def _few_labels(pairs: DataFrame) -> DataFrame:
    """``labels``; of at most ``FEW`` pairs, as a count shows, found at once."""
    pairs = kept(pairs.distinct())
    got = pairs.limit(FEW + 1).toPandas()
    if len(got) > FEW:
        return labels(pairs)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(got["a"].tolist(), got["b"].tolist(), strict=True):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return pairs.sparkSession.createDataFrame([(x, top(x)) for x in list(root)], "node long, label long")


def _reached(classes: DataFrame, threshold: int) -> DataFrame:
    """(h, label): the least hash that can be reached, for those that are linked."""
    return labels(spanning(classes.select("h", "w"), threshold)).withColumnRenamed("node", "h")


def _classes(classes: DataFrame, reached: DataFrame) -> DataFrame:
    """(h, class) of (h, w, least): the least id of all hashes with one label."""
    own = classes.join(reached, "h", "left").withColumn("label", F.coalesce("label", "h"))
    least = own.groupBy("label").agg(F.min("least").alias("class"))
    return own.join(least, "label").select("h", "class")


def clusters(found: DataFrame, threshold: int = 85) -> DataFrame:
    """(representative, id, similarity) of the groups of (id, simhash, short) with two members or more.

    The representative is the group's least id; members come by similarity to it, then by id. Short texts are like nothing.
    """
    rows = kept(found.where(~F.col("short")) if threshold > SHORT_CAP else found)
    classes = rows.groupBy(F.col("simhash").alias("h")).agg(F.count("*").alias("w"), F.min("id").alias("least"))
    own = rows.join(_classes(classes, _reached(classes, threshold)), rows.simhash == F.col("h")).select("id", "simhash", "short", F.col("class").alias("representative"))
    first = own.where("id = representative").select("representative", F.col("simhash").alias("rh"), F.col("short").alias("rs"))
    members = own.where("id <> representative").join(first, "representative")
    score = similarity(F.col("simhash"), F.col("rh"), F.col("short") | F.col("rs"))
    return members.select("representative", "id", score.alias("similarity")).orderBy("representative", F.col("similarity").desc(), "id")
