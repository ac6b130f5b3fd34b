"""Sections, chunks, vectors and their fusion."""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fnv1a32
from ..shipping import ship

CHUNK, OVERLAP = 1000, 200
RRF = 60


#: Name space of chunk ids, and the separators of the chunker from coarse to fine (fixed values).
CHUNK_SPACE = uuid.UUID("2340d12a-656a-5d01-971a-40586ee613a6")
SEPARATORS = (b"\n\n", b"\n", b" ", b"")
_FRONT = re.compile(r"---[^\S\n]*\n(?:.*\n)*?\s*---[^\S\n]*(?:\n|$)")
_HEADING = re.compile(r"^[^\S\n]*(#{1,6}) [^\S\n]*(\S.*?)[^\S\n]*$", re.M)


def sections_of(md: str) -> list[tuple[str, str, int]]:
    """(heading path, text, start byte) of a Markdown text's sections, front matter left out.

    A section begins with its heading's line and is trimmed; a text without headings is one section as it is.
    """
    front = _FRONT.match(md)
    skip = front.end() if front else 0
    marks = [(m.start(), len(m[1]), m[2]) for m in _HEADING.finditer(md, skip)]
    if not marks:
        return [("", md[skip:], len(md[:skip].encode()))] if md[skip:].strip() else []
    out, path, at = [], [], len(md[:skip].encode())
    if before := md[skip : marks[0][0]].strip():
        out.append(("", before, at))
    done = skip
    for (start, level, name), after in zip(marks, [*(m[0] for m in marks[1:]), len(md)], strict=True):
        at, done = at + len(md[done:start].encode()), start
        path = [*path[: level - 1], name]
        out.append((" > ".join(path), md[start:after].strip(), at))
    return out


def spans_of(data: bytes, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[bytes, ...] = SEPARATORS) -> list[tuple[int, int, bytes]]:
    """(start, end, bytes) of a section's chunks.

    A text of more than ``size`` bytes is parted at the coarsest separator it holds; successive parts share a chunk up to
    ``size``, a part that is larger itself is parted further, and a chunk begins with the last ``overlap`` bytes of the one before.
    """
    if len(data) <= size:
        return [(0, len(data), data)]
    level = next(i for i, s in enumerate(separators) if not s or s in data)
    sep = separators[level]
    if sep:
        ends = [m.start() for m in re.finditer(re.escape(sep), data)] + [len(data)]
        starts = [0, *(e + len(sep) for e in ends[:-1])]
    else:
        starts = [i for i, byte in enumerate(data) if byte & 0xC0 != 0x80]
        ends = [*starts[1:], len(data)]
    out: list[tuple[int, int, bytes]] = []
    begin, tail, i, n = 0, b"", 0, len(starts)
    while i < n:
        if ends[i] - starts[i] > size:
            if tail:
                out.append((begin, begin + len(tail), tail))
            out += [(starts[i] + a, starts[i] + z, t) for a, z, t in spans_of(data[starts[i] : ends[i]], size, overlap, separators[level + 1 :])]
            tail, i = b"", i + 1
            continue
        if not tail:
            begin, tail, i = starts[i], data[starts[i] : ends[i]], i + 1
            continue
        # what is taken at once stands in one piece, so its length follows from where it ends
        base = len(tail) + len(sep) - starts[i]
        j = bisect.bisect_right(ends, size - base, i)
        if j > i:
            tail, i = tail + sep + data[starts[i] : ends[j - 1]], j
            continue
        out.append((begin, begin + len(tail), tail))
        begin, tail = begin + max(0, len(tail) - overlap), tail[-overlap:]
        # the part after a full chunk joins its tail whatever its size
        tail, i = tail + (b"" if tail.endswith(sep) else sep) + data[starts[i] : ends[i]], i + 1
    if tail:
        out.append((begin, begin + len(tail), tail))
    return out


def chunk_id(source: str, digest: str, start: int) -> str:
    return str(uuid.uuid5(CHUNK_SPACE, f"{source}\0{digest}\0{start}"))


def chunks_of(source: str, sections: list[tuple[str, str, int]]) -> list[tuple]:
    """(chunk index, id, heading, content, hash, start, end) of a document's sections; the id follows from source, hash and start."""
    out = []
    for heading, body, base in sections:
        for s, e, raw in spans_of(body.encode()):
            digest = hashlib.sha256(raw).hexdigest()
            out.append((len(out), chunk_id(source, digest, base + s), heading or f"offset:{base + s}", raw.decode(errors="replace"), digest, base + s, base + e))
    return out


def chunks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, chunk_index, chunk_id, heading, content, hash, start, end): one row per chunk, in one pass without a shuffle.

    Outside headings ``heading`` is ``offset:`` with the chunk's start. Null and blank texts have no chunk.
    """
    names = ["id", "chunk_index", "chunk_id", "heading", "content", "hash", "start", "end"]

    def run(batches):
        for b in batches:
            rows = [(i, *c) for i, t in zip(b["id"], b["text"], strict=True) for c in chunks_of(str(i), sections_of(t or ""))]
            yield pd.DataFrame(rows, columns=names)

    ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, chunk_index int, chunk_id string, heading string, content string, hash string, start long, end long")


# Words that the local embedding skips, and what it takes for blanks.
LOCAL_STOP_WORDS = frozenset("and the a an of to in is it that und der die das ein eine ist es dass von zu mit auf für den dem des im am".split())
_LOCAL_BLANKS = str.maketrans(dict.fromkeys(".,!?;:-_()[]{}", " "))


def local_vector(text: str, dimensions: int = 768) -> np.ndarray:
    """Hashed bag of words of length 1, for when no model is at hand; a word's weight grows with a byte of the text's digest at its place."""
    v = np.zeros(dimensions, np.float32)
    ws = text.replace("İ", "i").replace("Σ", "σ").lower().translate(_LOCAL_BLANKS).split()
    digest = hashlib.sha256(text.encode()).digest()
    for i, w in enumerate(ws):
        if w not in LOCAL_STOP_WORDS:
            v[fnv1a32(w) % dimensions] += np.float32(1) + (np.float32(digest[i]) / np.float32(255) if i < len(digest) else np.float32(0))
    n = np.float32(np.sqrt((v * v).astype(np.float64).sum()))
    if n > 0:
        return v / n
    v[0] = 1
    return v


def embed_locally(text: Column | str, dimensions: int = 768) -> Column:
    """The local vector of a text column; null counts as empty."""
    ship(SparkSession.active())

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: local_vector(t, dimensions))

    return run(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def _literal(vector: list[float]) -> Column:
    return F.expr(f"array({','.join(f'CAST({float(x)!r}D AS DOUBLE)' for x in vector)})")


def vector_search(vectors: DataFrame, query: list[float], k: int, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors of largest cosine, exactly; only ids and scores are sorted."""
    return vectors.select(id, cosine(F.col(vector), _literal(query)).alias("score")).orderBy(F.col("score").desc(), id).limit(k)


def vector_search_all(vectors: DataFrame, queries: DataFrame, k: int, *, id: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """(query, id, score): the k vectors of largest cosine for each row of ``queries`` (same columns), exactly.

    Queries and vectors travel as blocks of ``block`` rows; each pair of blocks is one matrix product that keeps k rows
    a query, so what is shuffled is k rows per query and block. Ties go to the smaller id; a vector without length scores 0.
    Rows with a null id or vector are left out.
    """
    kind = vectors.schema[id].dataType.simpleString()

    def packed(rows: DataFrame, a: str, b: str) -> DataFrame:
        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), block):
                    part = pdf.iloc[at : at + block]
                    m = np.array(part[vector].tolist(), np.float64).reshape(len(part), -1)
                    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
                    yield pd.DataFrame({a: [part[id].tolist()], b: [np.divide(m, n, out=np.zeros_like(m), where=n > 0).ravel()]})

        return rows.select(id, vector).where(F.col(id).isNotNull() & F.col(vector).isNotNull()).mapInPandas(run, f"{a} array<{kind}>, {b} array<double>")

    def best(batches):
        for pdf in batches:
            for qi, q, vi, v in zip(pdf["qi"], pdf["q"], pdf["vi"], pdf["v"], strict=True):
                score = np.asarray(q).reshape(len(qi), -1) @ np.asarray(v).reshape(len(vi), -1).T
                ids = np.asarray(vi)
                for i, row in zip(qi, score, strict=True):
                    top = np.flatnonzero(row >= np.partition(row, -k)[-k] - 1e-12) if len(row) > k else np.arange(len(row))
                    top = top[np.lexsort((ids[top], -row[top]))][:k]
                    yield pd.DataFrame({"query": i, "id": ids[top], "score": row[top]})

    pairs = packed(vectors, "vi", "v").crossJoin(packed(queries, "qi", "q"))
    found = pairs.mapInPandas(best, f"query {kind}, id {kind}, score double")
    ranked = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    # k rows a query and hash part before the last step, so no query gathers all its blocks' rows at once
    part = found.groupBy("query", F.pmod(F.xxhash64("id"), F.lit(32)).alias("p")).agg(F.slice(F.sort_array(F.collect_list(ranked)), 1, k).alias("xs"))
    whole = part.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("xs"))), 1, k).alias("xs"))
    return whole.select("query", F.explode("xs").alias("x")).select("query", F.col("x.i").alias("id"), (-F.col("x.s")).alias("score"))


def signature(vector: Column) -> Column:
    """One bit per component, set where it is not negative, 63 to a word."""
    bits = F.transform(vector, lambda x: (x >= 0).cast("long"))
    n = F.size(vector)
    starts = F.sequence(F.lit(0), (F.ceil(n / 63) - 1).cast("int"))
    return F.transform(starts, lambda s: F.aggregate(F.slice(bits, s * 63 + 1, F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b))


def signature_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def shortlist_search(vectors: DataFrame, query: list[float], k: int, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The 4 k vectors of nearest sign signature, ranked by cosine; all of them if the signatures do not tell them apart."""
    q = _literal(query)
    scored = vectors.select(id, signature_distance(signature(F.col(vector)), signature(q)).alias("distance"), cosine(F.col(vector), q).alias("score"))
    ends = scored.agg(F.min("distance").alias("a"), F.max("distance").alias("b")).first()
    if ends["a"] != ends["b"]:
        scored = scored.orderBy("distance", id).limit(4 * k)
    return scored.orderBy(F.col("score").desc(), id).limit(k).select(id, "score")


class IvfIndex:
    """Vectors dealt to k-means cells; a search scans the nearest cells, then those that may still hold a better vector.

    By a cell's widest angle no vector of it is nearer to the query than the bound tells, so a search is exact
    unless it names its ``probes``. Centroids are fitted on a bounded sample (``sample`` rows by a hash of the id), every vector is indexed.
    """

    def __init__(self, vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", sample: int = 20_000, rounds: int = 3):
        self.id, self.vector = id, vector
        n = vectors.count()
        self.cells = max(4, min(256, int(np.sqrt(n))))
        self.probes = max(3, int(np.sqrt(self.cells)) + 1)
        rows = vectors.orderBy(F.xxhash64(id), id).limit(sample).select(vector).collect()
        x = np.array([r[0] for r in rows], np.float64) if rows else np.zeros((0, 1))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = x[np.linspace(0, len(x) - 1, min(self.cells, len(x)), dtype=int)] if len(x) else x
        for _ in range(rounds):
            own = (x @ c.T).argmax(axis=1) if len(c) else np.zeros(0, int)
            for j in range(len(c)):
                m = x[own == j]
                c[j] = m.mean(axis=0) if len(m) else x[(own == np.bincount(own).argmax()).argmax()]
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        self.centroids = c
        shared = vectors.sparkSession.sparkContext.broadcast(c)

        @F.pandas_udf(T.IntegerType())
        def cell(v: pd.Series) -> pd.Series:
            m = np.array(v.tolist(), np.float64) if len(v) else np.zeros((0, shared.value.shape[1]))
            return pd.Series((m @ shared.value.T).argmax(axis=1).astype(np.int32))

        self.table = vectors.withColumn("cell", cell(vector))

        @F.pandas_udf(T.DoubleType())
        def likeness(v: pd.Series, j: pd.Series) -> pd.Series:
            m = np.array(v.tolist(), np.float64) if len(v) else np.zeros((0, shared.value.shape[1]))
            return pd.Series((m * shared.value[j.to_numpy()]).sum(axis=1) / np.maximum(np.linalg.norm(m, axis=1), 1e-300))

        widest = self.table.groupBy("cell").agg(F.min(likeness(F.col(vector), F.col("cell"))).alias("m")).collect()
        self.widest = {r["cell"]: float(np.arccos(np.clip(r["m"], -1, 1))) for r in widest}

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        q = np.array(query, np.float64)
        like = self.centroids @ q
        order = [int(j) for j in np.argsort(-like, kind="stable")]
        near = order[: probes or self.probes]
        if probes is None:
            found = self._scan(near, query, k).collect()
            away = np.arccos(np.clip(like / max(float(np.linalg.norm(q)), 1e-300), -1, 1))
            least = found[-1]["score"] if len(found) == k else -2.0
            near += [j for j in order[len(near) :] if j in self.widest and np.cos(max(0.0, away[j] - self.widest[j])) >= least - 1e-6]
        return self._scan(near, query, k)

    def candidates(self, cells: list[int]) -> DataFrame:
        """The indexed rows of the cells: a lookup that reads no others where the table is written by cell."""
        return self.table.where(F.col("cell").isin(cells))

    def _scan(self, cells: list[int], query: list[float], k: int) -> DataFrame:
        return vector_search(self.candidates(cells), query, k, id=self.id, vector=self.vector)


def fuse(lexical: DataFrame, semantic: DataFrame, k: int, *, boosted: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank): 1 / (60 + rank) from each; hits also in ``boosted`` (id) gain 0.1, others 0.02."""
    a, b = lexical.select("id", F.col("rank").alias("ra")), semantic.select("id", F.col("rank").alias("rb"))
    both = a.join(b, "id", "full_outer")
    score = F.coalesce(1.0 / (RRF + F.col("ra")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("rb")), F.lit(0.0))
    if boosted is not None:
        marked = boosted.select("id", F.lit(True).alias("_sl_b")).distinct()
        both = both.join(marked, "id", "left")
        score = score + F.when(F.col("_sl_b"), 0.1).otherwise(0.02)
    return both.select("id", "ra", "rb", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def top_ranked(scored: DataFrame, id: str, k: int) -> DataFrame:
    """(id, rank) of the k best of (id, score): the window runs over the k rows left by the limit."""
    best = scored.orderBy(F.col("score").desc(), id).limit(k)
    return best.select(F.col(id).alias("id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), id)).alias("rank"))


def attach(extractions: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """Each extraction with the chunk of its document that holds its midpoint, else the nearest edge; the first chunk wins ties."""
    c = chunk_table.select("doc", "chunk_index", F.col("start").alias("cs"), F.col("end").alias("ce"))
    mid = (F.col("start") + F.col("end")) / 2
    away = F.when((F.col("cs") <= mid) & (mid < F.col("ce")), 0.0).otherwise(F.least(F.abs(mid - F.col("cs")), F.abs(mid - F.col("ce"))))
    joined = extractions.join(c, "doc").withColumn("_sl_away", away)
    best = joined.groupBy("doc", "extraction").agg(F.min(F.struct("_sl_away", "chunk_index")).alias("m"))
    return best.select("doc", "extraction", F.col("m.chunk_index").alias("chunk_index"))


def sections(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, section, heading, start, size): the sections of each Markdown text, with the path of headings that leads to them."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [(i, n, h, s, len(body.encode())) for i, t in zip(b["id"], b["text"], strict=True) for n, (h, body, s) in enumerate(sections_of(t or ""))]
            yield pd.DataFrame(rows, columns=["id", "section", "heading", "start", "size"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, section int, heading string, start long, size long")


def weighted_metadata(title: Column, tags: Column, aliases: Column, rest: Column) -> Column:
    """The metadata section of a document: title and tags three times, aliases twice, the rest once."""
    t = F.concat_ws(" ", title, F.array_join(tags, " "))
    return F.trim(F.concat_ws(" ", t, t, t, F.array_join(aliases, " "), F.array_join(aliases, " "), rest))


def centroids(vectors: DataFrame, cell: str, vector: str) -> DataFrame:
    """(cell, n, centroid): component-wise means, by one aggregation over components."""
    parts = vectors.select(cell, F.posexplode(vector).alias("i", "x")).groupBy(cell, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return parts.groupBy(cell).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def lloyd(vectors: DataFrame, first: dict[int, list[float]], vector: str, rounds: int = 1) -> DataFrame:
    """(cell, n, centroid) after ``rounds`` of k-means by cosine from the centroids ``first`` (a bounded number): each is one aggregation.

    A vector goes to the cell of largest cosine, the least cell of equal ones; vectors are taken at length 1.
    """
    unit = vectors.select(F.transform(vector, lambda x: x.cast("double")).alias("e")).where(norm(F.col("e")) > 0)
    unit = unit.select(F.transform("e", lambda x: x / norm(F.col("e"))).alias("e"))
    out = None
    for _ in range(rounds):
        length = {c: sum(x * x for x in v) ** 0.5 or 1.0 for c, v in first.items()}
        likes = [F.struct(dot(F.col("e"), _literal([x / length[c] for x in v])).alias("like"), F.lit(-c).alias("neg")) for c, v in sorted(first.items())]
        own = unit.withColumn("cell", -F.array_max(F.array(*likes))["neg"])
        out = centroids(own, "cell", "e")
        first = {r["cell"]: list(r["centroid"]) for r in out.select("cell", "centroid").collect()} if rounds > 1 else first
    return out


def quantized(vector: Column, bits: int = 4) -> Column:
    """Each component as an integer of ``bits`` bits, scaled by the vector's largest magnitude."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    half = (1 << (bits - 1)) - 1
    return F.transform(vector, lambda x: F.when(top > 0, F.round(x.cast("double") / top * half)).otherwise(0.0).cast("int"))
