"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over block-max inverted lists.

Features are words and word beginnings (so inflected and unseen forms of a word still
match). Of those, the ones whose presence among labelled texts is significantly tied to
the label (chi-square of ``SIGNIFICANT`` or more, at least 4 texts, and at least ``LIFT`` times as frequent with one label as with the other)
form the vocabulary, the ``VOCABULARY`` most significant at most; a text's vector holds ``(1 + log tf) * idf``
of its vocabulary terms, scaled to length 1.

The labelled examples are laid out by their strongest term in blocks of ``BLOCK``; each
inverted list also keeps, per block, the term's largest weight. A query sums these into an upper bound of
every block's cosine and opens blocks from the highest bound down until no further block
can beat the ``k``-th best cosine, so the neighbours are exact.

Neighbours vote with weights that grow with closeness; votes become probabilities by a
logistic curve fitted to the leave-one-out votes of the examples. A text without any
vocabulary term has the smoothed share of toxic ones among such examples. The evidence
returned with a score is the list of neighbours with their cosines and labels.

Bounds (documented parameters): the vocabulary is learned from at most ``max_labelled``
labelled texts and the index holds at most ``max_examples`` of them, both picked by a
hash of the id; repeated texts among them count once. Every document is scored on its whole text.

Defined cases: null, empty and wordless texts get the score of a text without vocabulary
terms. A label without a document, or with a null value, is not used; an id labelled more than
once takes its largest label, one with several texts its least text. Without any labelled text of either kind every score is the prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .tokens import WORD, Words, blocks, span_hashes, words

BLOCK, OPEN_FIRST = 32, 6
PREFIXES = (4, 7, 8)
SIGNIFICANT, LIFT = 30.0, 2.0
VOCABULARY = 16_384


def _beginnings(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per prefix length: which words are longer, and the tagged hash of their beginning."""
    out = []
    for n in PREFIXES:
        at = np.flatnonzero(w.end - w.start > n)
        out.append((at, span_hashes(w.data, w.start[at], w.start[at] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)))
    return out


def _features(column: pa.Array) -> list[np.ndarray]:
    """Per text the distinct hashes of its words and word beginnings; letters of any script are lower-cased."""
    out = []
    for block in blocks(pc.utf8_lower(column.cast(pa.large_string()))):
        w = words(block, WORD)
        parts = [(np.arange(len(w.hash)), w.hash), *_beginnings(w)]
        row, h = np.concatenate([w.text[at] for at, _ in parts]), np.concatenate([x for _, x in parts])
        bounds = np.searchsorted(np.sort(row), np.arange(block.rows + 1))
        h = h[np.argsort(row, kind="stable")]
        out += [np.unique(h[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for every start s and size n."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Vocabulary and examples, with inverted lists in blocks and each block's largest weight per term."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, k: int):
        order = np.argsort(vocabulary)
        self.vocabulary, self.idf, self.k = vocabulary[order], idf[order], k
        self.bitmap = np.zeros(1 << 18, bool)
        self.bitmap[self.vocabulary >> np.uint64(46)] = True
        self.ids = np.zeros(0, np.int64)
        self.labels = np.zeros(0)
        self.curve = (0.0, 0.0)
        self.none = 0.0

    def vector(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of the text in which the given terms were found, of length 1."""
        terms, tf = np.unique(found, return_counts=True)
        weight = (1 + np.log(tf)) * self.idf[terms]
        norm = np.sqrt((weight**2).sum())
        return terms, weight / norm if len(terms) else weight

    def found(self, column: pa.Array) -> dict[int, np.ndarray]:
        """Row -> the vocabulary terms found in its text, repeated as found; rows without any are left out."""
        out: dict[int, np.ndarray] = {}
        if not len(self.vocabulary):
            return out
        for block in blocks(pc.utf8_lower(column.cast(pa.large_string()))):
            w = words(block, WORD)
            rows, terms = [], []
            for at, h in [(None, w.hash), *_beginnings(w)]:
                near = np.flatnonzero(self.bitmap[h >> np.uint64(46)])
                place = np.minimum(np.searchsorted(self.vocabulary, h[near]), len(self.vocabulary) - 1)
                same = self.vocabulary[place] == h[near]
                near = near[same]
                rows.append(w.text[near if at is None else at[near]])
                terms.append(place[same])
            row, term = np.concatenate(rows), np.concatenate(terms)
            order = np.argsort(row, kind="stable")
            row, term = row[order], term[order]
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else []
            for i, part in zip(first, np.split(term, first[1:]) if len(row) else [], strict=True):
                out[block.first + int(row[i])] = part
        return out

    def fill(self, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        strongest = [int(t[np.argmax(x)]) if len(t) else -1 for t, x in vectors]
        order = [i for i in sorted(range(len(ids)), key=lambda i: (strongest[i], ids[i])) if len(vectors[i][0])]
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], float)
        n_blocks = -(-len(order) // BLOCK)
        terms = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        owner = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order]) if order else np.zeros(0, np.int64)
        by = np.lexsort((owner, terms))
        self.list_owner, self.list_weight = owner[by], weight[by]
        self.list_at = np.searchsorted(terms[by], np.arange(len(self.vocabulary) + 1))
        # per term: the blocks where it occurs, each with its largest weight
        key = terms[by] * max(1, n_blocks) + owner[by] // BLOCK
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.max_block = (owner[by] // BLOCK)[first]
        self.max_weight = np.maximum.reduceat(weight[by], first) if len(first) else weight
        self.entry_at = np.concatenate((first, [len(key)])).astype(np.int64)
        self.max_at = np.searchsorted(terms[by][first], np.arange(len(self.vocabulary) + 1))
        self.n_blocks = n_blocks

    def nearest(self, terms: np.ndarray, weight: np.ndarray, skip: int = -1) -> list[tuple[float, int]]:
        """The k nearest examples by cosine, as (cosine, place), ties by id; cosines of 0 are left out."""
        lo = self.max_at[terms]
        per_term = self.max_at[terms + 1] - lo
        entry, x = _ranges(lo, per_term), np.repeat(weight, per_term)
        block = self.max_block[entry]
        bound = np.bincount(block, x * self.max_weight[entry], minlength=self.n_blocks)
        # the blocks of highest bound first; then every block whose bound reaches the k-th best of those
        open_ = np.zeros(self.n_blocks, bool)
        open_[np.argsort(-bound, kind="stable")[:OPEN_FIRST]] = True
        best = self._scores(entry, x, open_[block], skip)
        if len(best) >= self.k:
            rest = (bound >= best[self.k - 1][0] - 1e-9) & ~open_
        else:
            rest = (bound > 0) & ~open_
        if rest.any():
            best = sorted(best + self._scores(entry, x, rest[block], skip), key=lambda b: (-b[0], self.ids[b[1]]))
        return best[: self.k]

    def _scores(self, entry: np.ndarray, x: np.ndarray, chosen: np.ndarray, skip: int) -> list[tuple[float, int]]:
        """Cosines of the examples in the chosen (term, block) parts of the lists, the k best in order."""
        e = entry[chosen]
        size = self.entry_at[e + 1] - self.entry_at[e]
        at = _ranges(self.entry_at[e], size)
        owner = self.list_owner[at]
        places, which = np.unique(owner, return_inverse=True)
        score = np.minimum(1.0, np.bincount(which, np.repeat(x[chosen], size) * self.list_weight[at], minlength=len(places)))
        keep = (score > 0) & (places != skip)
        places, score = places[keep], score[keep]
        order = np.lexsort((self.ids[places], -score))[: self.k]
        return list(zip(score[order].tolist(), places[order].tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Weighted share of toxic neighbours; the weight is the odds of the cosine, distance cut off at 0.05."""
        w = np.array([1.0 / max(0.05, 1.0 - s) for s, _ in near])
        y = self.labels[[p for _, p in near]]
        return float((w * y).sum() / w.sum())

    def probability(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * vote, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, lightly shrunk."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b])
        v = p * (1 - p) + 1e-9
        h = np.array([[v.sum() + 1e-3, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def held_out(id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(3)) == 1


def fit(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id: str = "doc_id", text: str = "text", k: int = 15, max_labelled: int = 24_000, max_examples: int = 6_000
) -> Index:
    """Vocabulary, examples and calibration from labelled rows that are not held out."""
    ship(docs.sparkSession)
    own = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
    own = own.where(~held_out(F.col("id")))
    picked = own.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(max_labelled)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    texts = rows.join(F.broadcast(picked), "id").where("text is not null")

    def presence(batches):
        """Per batch and text hash: the distinct features, so copies can be dropped afterwards."""
        for b in batches:
            got = _features(b.column(2))
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in got]))).astype(np.int32)
            values = np.concatenate(got) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64), pa.int64()))], names=["id", "label", "f"])

    once = texts.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min("id").alias("id")).select("id", "label")
    once = docs.sparkSession.createDataFrame(once.collect(), "id long, label int")  # at most max_labelled pairs
    distinct = rows.join(F.broadcast(once), "id").where("text is not null").groupBy("id", "label").agg(F.min("text").alias("text"))
    count = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = count.get(1, 0), sum(n for y, n in count.items() if y != 1)
    df = distinct.mapInArrow(presence, "id long, label int, f array<long>").select("label", F.explode("f").alias("f"))
    df = df.groupBy("f").agg(F.sum((F.col("label") == 1).cast("long")).alias("a"), F.sum((F.col("label") != 1).cast("long")).alias("b")).where("a + b >= 4")
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(toxic + clean)
    chi = n * F.pow(a * (clean - b) - b * (toxic - a), 2) / F.greatest(F.lit(1.0), F.lit(float(toxic)) * clean * (a + b) * (n - a - b))
    odds = (a + 0.5) / (toxic + 1.0) * (clean + 1.0) / (b + 0.5)
    best = df.where((chi >= SIGNIFICANT) & ((odds >= LIFT) | (odds <= 1 / LIFT))).orderBy(chi.desc(), "f").limit(VOCABULARY).select("f", "a", "b").collect()
    vocabulary = np.array([r["f"] for r in best], np.int64).view(np.uint64)
    idf = np.log((1 + n) / (1 + np.array([r["a"] + r["b"] for r in best], float))) + 1
    index = Index(vocabulary, idf, k)

    def vectors(batches):
        for b in batches:
            none = np.zeros(0, np.int64), np.zeros(0)
            found = index.found(b.column(2))
            got = [index.vector(found[r]) if r in found else none for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v[0] for v in got], pa.list_(pa.int64())), pa.array([v[1] for v in got], pa.list_(pa.float64()))], names=["id", "label", "t", "w"])

    made = distinct.mapInArrow(vectors, "id long, label int, t array<long>, w array<double>")
    # texts without a term only matter by their number
    bare = {r["label"]: r["n"] for r in made.groupBy("label", (F.size("t") == 0).alias("bare")).agg(F.count("*").alias("n")).where("bare").collect()}
    rows_ = made.where("size(t) > 0").orderBy(F.xxhash64("id", F.lit(6)), "id").limit(max_examples).collect()
    index.fill([r["id"] for r in rows_], [int(r["label"] == 1) for r in rows_], [(np.array(r["t"], np.int64), np.array(r["w"])) for r in rows_])
    prior = (toxic + 0.5) / (toxic + clean + 1.0) if toxic + clean else 0.5
    in_bare = sum(bare.values())
    index.none = (bare.get(1, 0) + prior) / (in_bare + 1.0)
    votes, truth = [], []
    place = {int(i): p for p, i in enumerate(index.ids)}
    for r in rows_:
        near = index.nearest(np.array(r["t"], np.int64), np.array(r["w"]), skip=place[r["id"]])
        if near:
            votes.append(index.vote(near))
            truth.append(float(r["label"] == 1))
    index.curve = _logistic(np.array(votes), np.array(truth)) if votes else (float(np.log(prior / (1 - prior))), 0.0)
    return index


def score(docs: DataFrame, index: Index, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``evidence`` (neighbours: id, cosine, label); columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    names = [c for c in docs.columns if c not in ("score", "evidence")]
    shared = spark.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        ix = shared.value
        for b in batches:
            scores, evidence = [ix.none] * b.num_rows, [[] for _ in range(b.num_rows)]
            for r, terms in ix.found(b.column(text)).items():
                near = ix.nearest(*ix.vector(terms)) if ix.n_blocks else []
                if near:
                    scores[r] = ix.probability(ix.vote(near))
                    evidence[r] = [{"id": int(ix.ids[p]), "cosine": s, "label": int(ix.labels[p])} for s, p in near]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=[*names, "score", "evidence"])

    found = T.StructType([T.StructField("id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())])
    schema = docs.select(*names).schema.add("score", T.DoubleType()).add("evidence", T.ArrayType(found))
    return docs.select(*names).mapInArrow(run, schema)
