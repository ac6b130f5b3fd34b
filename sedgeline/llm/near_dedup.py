"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Every text becomes the set of hashes of its word shingles; its sketch is the ``k``
   smallest. Texts with equal sets form one class, stood for by its smallest id, so
   copies cost one row each from here on.
2. Two sets of similarity ``t`` share about ``t * k`` sketch values, so at least ``c`` (six
   standard deviations fewer) of them. A class of which fewer sketch values occur anywhere
   else is linked with nothing; it drops out, as nearly all texts do.
3. What is left is looked at with the ``K_WIDE`` smallest values (for most texts the whole
   set, where ``c`` needs no allowance). Ordered from the rarest value to the most frequent, a
   linked pair meets in the inverted list of one of each set's first ``k - c + 1`` values.
   Passages that many otherwise different texts share fall behind that prefix.
4. In each inverted list one pivot (the member whose values are most widespread) is
   paired with every other member of a size that is not too far off. Pairs pass the
   union-sketch estimate; those that remain are measured exactly on the full sets. So the
   members around a pivot are known by what they lack of it and what they add to it.
   Linked ones form a component with it. Two members x, y of which one is not linked to the
   pivot must share f(x) + f(y) - c of these differences, where f weighs a member's own
   differences and c is the pivot's tolerance. A difference that no other member has is
   shared by nobody, which settles nearly all members of a family of edited copies without
   pairing them: their number costs one aggregation over the differences.
5. Lists whose undecided members are still in several components are merged where they
   hold the same members, and take further pivots, 8, 64, 512, ... of them a round, each paired with every
   member of another component that its size, its place in the order and its differences allow, until in each list all members that
   were never pivot, and may have a partner in it, are in one component. So each pair of a
   list is compared, ruled out or already in one group, while a group of n close copies
   costs about n comparisons, not n * n.

Defined cases: null, empty and wordless texts have an empty set and are linked with
nothing; a text with fewer words than a shingle has one shingle, its whole sequence. A
null id is never linked and stands for itself. Rows that repeat an id are one document:
what is linked to one of them is linked to the id. Columns other than id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .components import components
from .scratch import Scratch, small
from .tokens import NOT_SPACE, blocks, mix, shingle_sets, words


def _sets(batches, n: int, k: int | None):
    """Rows (id, n, hi, lo, set): the whole set, or its k smallest values; hi and lo identify the set."""
    for b in batches:
        ids = b.column(0)
        for block in blocks(b.column(1)):
            sets = shingle_sets(words(block, NOT_SPACE), block.rows, n)
            size = np.array([len(s) for s in sets], np.int64)
            kept = sets if k is None else [s[:k] for s in sets]
            hi = np.array([int(s.view(np.uint64).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
            lo = np.array([int(mix(s.view(np.uint64)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
            values = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.rows), pa.array(size), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))],
                names=["id", "n", "hi", "lo", "vals"],
            )


_SCHEMA = "id long, n long, hi long, lo long, vals array<long>"


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 5,
    similarity: tuple[int, int] = (80, 100),
    k: int = 32,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    ``similarity`` is a fraction; sets A and B are linked if |A & B| / |A | B| reaches it.
    """
    spark = docs.sparkSession
    ship(spark)
    up, down = similarity
    t = up / down
    scratch = Scratch(spark, "near")
    narrow = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = scratch.put(narrow.mapInArrow(lambda it: _sets(it, shingle, k), _SCHEMA))

    linkable = sketches.where("n > 0 and id is not null")
    classes = scratch.put(linkable.groupBy("hi", "lo").agg(F.min("id").alias("rep")))
    first = linkable.join(classes, (linkable.hi == classes.hi) & (linkable.lo == classes.lo) & (linkable.id == classes.rep))
    ids = scratch.put(_shared_enough(first.select(F.col("rep").alias("id"), "vals"), t, scratch))
    sets = narrow.join(small(ids), "id", "left_semi").mapInArrow(lambda it: _sets(it, shingle, None), _SCHEMA)
    sets = scratch.put(sets.where("n > 0").dropDuplicates(["id", "hi", "lo"]).select(F.col("id").alias("rep"), "n", "vals"))

    lists = scratch.put(_inverted_lists(sets, t, scratch))
    pivots = scratch.put(_first_pivots(lists))
    # two sets that are linked to a third, or to each other and one of them to the third, are this like it at least
    around = 2 * t - 1
    near = scratch.put(_measured(scratch.put(_around_pivots(lists, pivots, around)), sets, around))
    edges = [scratch.put(near.where(_linked(up, down)).select(F.least("q", "rep").alias("a"), F.greatest("q", "rep").alias("b")).distinct())]
    labels = components(edges[0], scratch)
    done = pivots.select("v", F.col("q").alias("rep"))
    open_ = scratch.put(_open_members(lists, labels, done, scratch))
    lists = scratch.put(_merged(_undecided(open_, pivots, _families(near, t, scratch), scratch)))
    seen: list[DataFrame] = []
    grow = 8
    while True:
        open_ = scratch.put(_open_members(lists, labels, done, scratch))
        if not open_.head(1):
            break
        picked = scratch.put(_next_pivots(open_, grow))
        grow = min(grow * 8, 4096)
        pairs = _paired(open_, picked, t)
        pairs = scratch.put(pairs.join(_union(seen), ["a", "b"], "left_anti") if seen else pairs)
        seen.append(pairs)
        done = done.unionByName(picked.select("v", "rep"))
        found = scratch.put(_confirmed(_estimated(pairs, sets, t), sets, up, down))
        if found.head(1):
            edges.append(found)
            labels = components(_union(edges), scratch)

    scratch.keep(sketches, classes, labels)
    rep = sketches.join(classes, ["hi", "lo"], "left").select("id", F.when(F.col("n") > 0, F.col("rep")).alias("rep"), F.col("n").alias("n_shingles"))
    out = rep.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    group = F.coalesce("label", "rep", "id")
    return out.select("id", "n_shingles", group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


#: Values by which the texts that may have a partner are compared, and the size up to which those of both partners are whole sets.
K_WIDE = 512
#: Members of a list beside one copy of its pivot; a longer list is dealt to as many copies as it needs.
PER_COPY = 1_000
_MEMBER = ("v", "rep", "pop", "n", "most", "df")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _least_shared(s: Column, t: float, whole: Column) -> Column:
    """How many of its s values a set shares at least with one of similarity t; ``whole``: the values of both are whole sets."""
    fewer = F.floor(s * t - 6 * F.sqrt(s * t * (1 - t)))
    return F.greatest(F.lit(1), F.when(whole, F.ceil(s * t - 1e-9)).otherwise(fewer))


def _shared_enough(sketch: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """Ids whose sketch has enough values that occur in another sketch."""
    posting = sketch.select("id", F.explode("vals").alias("v"))
    # written first, so that the join with a very common value can be split over tasks
    common = scratch.put(posting.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v"))
    shared = posting.join(common, "v", "left_semi").groupBy("id").agg(F.count("*").alias("m"))
    size = sketch.select("id", F.size("vals").alias("s"))
    return shared.join(size, "id").where(F.col("m") >= _least_shared(F.col("s"), t, F.lit(False))).select("id").distinct()


def _inverted_lists(sets: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """``_MEMBER`` of the lists of the rarest-first prefix; most: the largest size of a partner first met in this list; df: at least the list's length."""
    posting = sets.select("rep", "n", F.explode(F.slice("vals", 1, K_WIDE)).alias("v"))
    df = scratch.put(posting.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    # values held once sort first; only their number matters
    shared = posting.join(df, "v").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("pop"))
    s = F.least("n", F.lit(K_WIDE))
    whole = F.col("n") <= int(K_WIDE * t)
    alone = s - F.size("vs")
    prefix = F.greatest(F.lit(0), s - _least_shared(s, t, whole) + 1 - alone).cast("int")
    kept = shared.select("rep", "n", "pop", s.alias("s"), whole.alias("whole"), alone.alias("alone"), F.posexplode(F.slice("vs", 1, prefix)).alias("i", "x"))
    # if x is the first value that two sets share, neither shares what comes before it in its own order
    left = F.col("s") - F.col("alone") - F.col("i")
    rate = left / F.col("s")
    held = F.when(F.col("whole"), left).otherwise(F.least(F.lit(1.0), rate + 6 * F.sqrt(rate * (1 - rate) / F.col("s")) + 6 / F.col("s")) * F.col("n"))
    # |A & B| <= held, and t * (|A| + |B| - |A & B|) <= |A & B|
    most = F.floor(held * (1 + 1 / t) - F.col("n") + 1e-6)
    return kept.select(F.col("x.v").alias("v"), "rep", "pop", "n", most.alias("most"), F.col("x.df").alias("df")).where(F.col("most") >= F.col("n") * t - 1e-6)


def _first_pivots(lists: DataFrame) -> DataFrame:
    """(v, q, nq, df): of each list the member whose values are most widespread."""
    top = lists.groupBy("v").agg(F.max(F.struct("pop", (-F.col("rep")).alias("neg"), "n")).alias("m"), F.max("df").alias("df"))
    return top.select("v", (-F.col("m.neg")).alias("q"), F.col("m.n").alias("nq"), "df")


def _copies(df: Column) -> Column:
    return F.ceil(df / PER_COPY).cast("int")


def _dealt(members: DataFrame) -> DataFrame:
    return members.withColumn("part", F.pmod(F.xxhash64("rep"), _copies(F.col("df"))).cast("int"))


def _copied(pivots: DataFrame) -> DataFrame:
    return pivots.withColumn("part", F.explode(F.sequence(F.lit(0), _copies(F.col("df")) - 1)))


def _around_pivots(lists: DataFrame, pivots: DataFrame, around: float) -> DataFrame:
    """Distinct (q, rep): each first pivot with the members of its lists whose sizes allow the similarity ``around``."""
    both = _dealt(lists).join(_copied(pivots).drop("df"), ["v", "part"]).where((F.col("rep") != F.col("q")) & (F.least("n", "nq") >= F.greatest("n", "nq") * around - 1e-6))
    return both.select("q", "rep").distinct()


def _measured(pairs: DataFrame, sets: DataFrame, around: float) -> DataFrame:
    """(q, rep, nq, n, diff, n_gone): pairs of similarity ``around`` at least; diff: what only one of both holds, n_gone of them q alone."""
    named = pairs.select(F.col("q").alias("a"), F.col("rep").alias("b"))
    a, b = sets.select(F.col("rep").alias("a"), F.col("vals").alias("va")), sets.select(F.col("rep").alias("b"), F.col("vals").alias("vb"))
    both = _estimated(named, sets, around).join(a, "a").join(b, "b")
    gone, came = F.array_except("va", "vb"), F.array_except("vb", "va")
    out = both.select(F.col("a").alias("q"), F.col("b").alias("rep"), F.size("va").alias("nq"), F.size("vb").alias("n"), F.concat(gone, came).alias("diff"), F.size(gone).alias("n_gone"))
    inter = F.col("nq") - F.col("n_gone")
    return out.where(inter >= around * (F.col("nq") + F.col("n") - inter) - 1e-6)


def _linked(up: int, down: int) -> Column:
    inter = F.col("nq") - F.col("n_gone")
    return down * inter >= up * (F.col("nq") + F.col("n") - inter)


def _families(near: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """(q, rep, f, s, c, excess, slack, least, most_slack) of the members around each pivot.

    Two members share o of the differences from q they have, and are linked if o >= f + f' - c. s of a
    member's differences are shared by another member, so o <= s. excess = f - c is above 0 if the member is not
    linked to q; slack = s - f. A partner of it has a slack of at least its excess.
    """
    r = t / (1 + t)
    weighed = near.select("q", "rep", "diff", (F.size("diff") * r + F.col("n_gone") * (1 - 2 * r)).alias("f"), ((1 - 2 * r) * F.col("nq")).alias("c")).withColumn("excess", F.col("f") - F.col("c"))
    apart = scratch.put(weighed.groupBy("q").agg(F.min(F.when(F.col("excess") > -1e-6, F.col("excess"))).alias("least")).where("least is not null"))
    weighed = weighed.join(small(apart), "q", "left")
    said = weighed.where("least is not null").select("q", "rep", F.explode("diff").alias("x"))
    own = said.groupBy("q", "x").agg(F.count("*").alias("df"), F.min("rep").alias("rep")).where("df = 1")
    own = own.groupBy("q", "rep").agg(F.count("*").alias("own"))
    members = weighed.join(own, ["q", "rep"], "left").select("q", "rep", "f", (F.size("diff") - F.coalesce("own", F.lit(0))).alias("s"), "c", "excess", "least")
    members = scratch.put(members.withColumn("slack", F.col("s") - F.col("f")))
    top = scratch.put(members.groupBy("q").agg(F.max("slack").alias("most_slack")))
    return members.join(small(top), "q")


def _undecided(open_: DataFrame, pivots: DataFrame, families: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of the lists that may have a partner there in another component, with f, s and c where they are around the pivot.

    Between a member linked to the pivot and one that is not around it there is no link, by the triangle inequality.
    """
    own = scratch.put(open_.drop("label").join(pivots.select("v", "q"), "v").join(families, ["q", "rep"], "left"))
    far = own.groupBy("v").agg(F.max(F.col("f").isNull()).alias("far"))
    unlinked = (F.col("excess") > -1e-6) & (F.col("far") | (F.col("excess") <= F.col("most_slack") + 1e-6))
    partner = F.col("slack") >= F.col("least") - 1e-6
    return own.join(scratch.put(far), "v").where(F.col("f").isNull() | F.coalesce(unlinked, F.lit(False)) | F.coalesce(partner, F.lit(False))).select(*_MEMBER, "f", "s", "c")


def _merged(lists: DataFrame) -> DataFrame:
    """Of the lists with the same members only the least, with the widest bound that any of them gives a member."""
    h = F.xxhash64("rep")
    same = lists.groupBy("v").agg(F.count("*").alias("m"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("y"))
    first = same.groupBy("m", "x", "y").agg(F.min("v").alias("v0"))
    where = same.join(first, ["m", "x", "y"]).select("v", "v0")
    most = lists.join(where, "v").groupBy("v0", "rep").agg(F.max("most").alias("most")).withColumnRenamed("v0", "v")
    return lists.drop("most").join(most, ["v", "rep"])


def _paired(members: DataFrame, pivots: DataFrame, t: float) -> DataFrame:
    """Each pivot with the members of its lists, of other components and of sizes that allow the similarity."""
    p = _copied(pivots).select(F.col("v").alias("pv"), F.col("part").alias("pp"), F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("f").alias("fb"), F.col("s").alias("sb"))
    fits = (F.col("n") <= F.col("mb")) & (F.col("nb") <= F.col("most")) & (F.least("n", "nb") >= F.greatest("n", "nb") * t - 1e-6)
    share = F.coalesce(F.least("s", "sb") >= F.col("f") + F.col("fb") - F.col("c") - 1e-6, F.lit(True))
    apart = (F.col("rep") != F.col("b")) & (F.col("label") != F.col("lb"))
    both = _dealt(members).join(p, (F.col("v") == F.col("pv")) & (F.col("part") == F.col("pp")) & fits & share & apart)
    return both.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def _open_members(lists: DataFrame, labels: DataFrame, done: DataFrame, scratch: Scratch) -> DataFrame:
    """Members that were never pivot and may have a partner, of the lists where such members are in several components.

    What is known per list is written before it is joined, so that the join with a long list can be split over tasks.
    """
    own = lists.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    left = own.join(done.select("v", "rep"), ["v", "rep"], "left_anti")
    left = scratch.put(left)
    least = left.groupBy("v").agg(F.min("n").alias("n0"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("v", "n0")
    alive = scratch.put(left.join(scratch.put(least), "v").where("most >= n0").drop("n0"))
    split = alive.groupBy("v").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("v")
    return alive.join(scratch.put(split), "v")


def _next_pivots(members: DataFrame, grow: int) -> DataFrame:
    """Per list the ``grow`` smallest members outside its largest component."""
    sizes = members.groupBy("v", "label").agg(F.count("*").alias("m"))
    top = sizes.groupBy("v").agg(F.max(F.struct("m", "label")).alias("x")).select("v", F.col("x.label").alias("main"))
    ranked = members.join(top, "v").where("label <> main").select("v", F.struct("n", "rep", "label", "most", "df", "f", "s").alias("x"))
    # a bounded array per task and list before the shuffle, so no list is gathered whole
    part = ranked.groupBy("v", F.pmod(F.xxhash64("x.rep"), F.lit(64)).alias("s")).agg(F.slice(F.sort_array(F.collect_list("x")), 1, grow).alias("xs"))
    whole = part.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("xs"))), 1, grow).alias("xs"))
    return whole.select("v", F.explode("xs").alias("x")).select("v", "x.rep", "x.label", "x.n", "x.most", "x.df", "x.f", "x.s")


def _estimated(pairs: DataFrame, sets: DataFrame, t: float, k: int = 128) -> DataFrame:
    """Pairs whose similarity, estimated on the k smallest values of the union, may reach t."""
    a = sets.select(F.col("rep").alias("a"), F.slice("vals", 1, k).alias("va"))
    b = sets.select(F.col("rep").alias("b"), F.slice("vals", 1, k).alias("vb"))
    low = t - 6 * math.sqrt(t * (1 - t) / k)
    both = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.array_sort(F.array_union("va", "vb")), 1, k)
    share = F.size(F.array_intersect(F.array_intersect("va", "vb"), union)) / F.size(union)
    # where a union has fewer values the estimate is exact
    return both.where(share >= low).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, up: int, down: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    a, b = sets.select(F.col("rep").alias("a"), F.col("vals").alias("va")), sets.select(F.col("rep").alias("b"), F.col("vals").alias("vb"))
    both = pairs.join(a, "a").join(b, "b")
    inter = F.size(F.array_intersect("va", "vb"))
    return both.where(down * inter >= up * (F.size("va") + F.size("vb") - inter)).select("a", "b").distinct()


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those whose group holds a smaller id; of rows that repeat an id and text one stays.

    Few documents go, so their ids are taken out by an anti-join: broadcast if a count allows, else shuffled.
    """
    found = near_duplicates(docs, id=id, text=text, **options)
    scratch = Scratch(docs.sparkSession, "near-drop")
    marks = scratch.put(found.select("id", "kept"))
    gone = marks.where("not kept").select("id").distinct()
    left = docs.join(small(gone), docs[id] == gone["id"], "left_anti")
    if marks.where("kept and id is not null").groupBy("id").count().where("count > 1").head(1):
        left = left.dropDuplicates([id, text])
    return left
