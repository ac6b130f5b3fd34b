"""Operators against brute force, and every registered query with SQL against that SQL on the smallest tables."""

import datetime as dt
import hashlib
import json
import random
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import sedgeline.queries as Q
from sedgeline.functions import text as TX
from sedgeline.operators import copies as C
from sedgeline.operators import index as IX
from sedgeline.operators import graph as G
from sedgeline.operators import journal as J
from sedgeline.operators import retrieval as R
from sedgeline.operators import search as S
from sedgeline.operators import state as ST_
from sedgeline.operators.cc import labels
from sedgeline.sources import files as SRC
from sedgeline.sources import pdf as PDF
from sedgeline.sources import sinks as K
from sedgeline.streaming import changes as ST

NAMES = sorted(Q.ORACLES)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    from sedgeline.registry import TABLES

    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return [_norm(x) for x in v] if isinstance(v, list | tuple) else v


#: At this size the weights of its words vanish in the rounding of the SQL's scores, which then orders by path.
ROUNDED_AWAY = {"T17_syntax_fallback"}


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ROUNDED_AWAY])
def test_query_equals_sql(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    cur = duck.execute(Q.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    exp = sorted((str([_norm(dict(zip(cols, r, strict=True))[c]) for c in order]) for r in cur.fetchall()))
    assert sorted(str([_norm(r[c]) for c in order]) for r in df.collect()) == exp


def test_negative_control(duck):
    assert duck.execute(Q.ORACLES["A1_counts"].replace("count(status)", "count(status) + 1")).fetchall() != duck.execute(Q.ORACLES["A1_counts"]).fetchall()


@pytest.mark.parametrize("piece", [20_000, 8])
def test_near_copies_equal_brute_force(spark, monkeypatch, piece):
    """Links, classes and clusters against all pairs; also with lists so long that they are dealt to pairs of pieces."""
    monkeypatch.setattr(C, "LIST", piece)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = []
    for i in range(150):
        h = r.choice(base)
        for _ in range(r.randint(0, 12)):
            h ^= 1 << r.randrange(64)
        prints.append((f"p{i:03d}", h - 2**64 if h >= 2**63 else h, i % 17 == 0))
    prints += [("q1", prints[0][1], False), ("q2", prints[0][1], False)]
    alike = lambda x, y: (64 - bin((x ^ y) % 2**64).count("1")) * 100 // 64

    def classes(rows):
        near = {a: [b for b, y, *_ in rows if b != a and alike(x, y) >= 85] for a, x, *_ in rows}
        out = {}
        for a in sorted(near):
            queue = [] if a in out else [a]
            while queue:
                b = queue.pop()
                if out.setdefault(b, a) == a:
                    queue += [c for c in near[b] if c not in out]
        return out, near

    df = spark.createDataFrame(prints, "id string, simhash long, short boolean")
    label, near = classes(prints)
    assert {(x["id"], x["class"], x["n_links"]) for x in C.links(df, 85).collect()} == {(a, label[a], len(near[a])) for a, *_ in prints}
    kept = [p for p in prints if not p[2]]
    label, _ = classes(kept)
    h = {a: x for a, x, _ in kept}
    exp = sorted(((label[a], -alike(h[a], h[label[a]]), a) for a in h if label[a] != a))
    assert [(x["representative"], -x["similarity"], x["id"]) for x in C.clusters(df, 85).collect()] == exp
    assert [x["id"] for x in C.similar_to(df, prints[0][1], 85).collect()] == sorted(a for a, x, _ in prints if x != prints[0][1] and alike(x, prints[0][1]) >= 85)


@pytest.mark.parametrize(("crowded", "few"), [(True, 50_000), (True, 0), (False, 0)])
def test_links_by_all_pairs_equal_brute_force(spark, monkeypatch, crowded, few):
    """Crowded hashes in many pieces, their labels joined on the driver or by tables; and the same by lists."""
    monkeypatch.setattr(C, "PIECE", (64, 128))
    monkeypatch.setattr(C, "FEW", few)
    monkeypatch.setattr(C, "_crowded", lambda *_: crowded)
    r = np.random.default_rng(3)
    h = np.packbits(r.random((700, 64)) < np.where(r.random(64) < 0.8, 0.12, 0.3), axis=1).view(np.int64)[:, 0]
    h = np.concatenate([h, h[:90], h[:30], r.integers(-(2**63), 2**63, 40)])
    d = np.bitwise_count(h.view(np.uint64)[:, None] ^ h.view(np.uint64)[None, :])
    near = (64 - d.astype(int)) * 100 // 64 >= 85
    label = np.arange(len(h))
    while not np.array_equal(label, new := np.where(near, label[None, :], len(h)).min(axis=1)):
        label = new
    assert 2 < len(set(label.tolist())) < 700 and near.mean() > 0.01
    tiles = []
    monkeypatch.setattr(C, "_few_labels", lambda pairs, f=C._few_labels: tiles.append(1) or f(pairs))
    got = C.links(spark.createDataFrame(list(enumerate(h.tolist())), "id long, simhash long"), 85).collect()
    assert sorted((x["id"], x["class"], x["n_links"]) for x in got) == list(zip(range(len(h)), label.tolist(), (near.sum(axis=1) - 1).tolist(), strict=True))
    assert len(tiles) == 2 * crowded


def test_simhashes_of_a_batch():
    """Texts hashed together, with long words, odd blanks and none at all, against one word after the other."""
    r = random.Random(9)
    texts = ["", " \n", "x" * 64, "x" * 65 + " y", "\u00e9" * 40 + " b", "a\u00a0b\x1cc"] + ["".join(r.choice("aé 東\n\t\x00z") for _ in range(r.randrange(90))) for _ in range(200)]
    for t, got in zip(texts, TX._simhashes(texts).tolist(), strict=True):
        words = t.lower().split()
        votes = [sum(TX.fnv1a64(w) >> i & 1 for w in words) for i in range(64)]
        assert got % 2**64 == sum(1 << i for i in range(64) if 2 * votes[i] > len(words))


# Fingerprints, lengths and similarities of public test texts.
SIMHASHES = {"": 0, "The quick brown fox jumps over the lazy dog": 0xCAB7991C5475EDEE, "  HELLO   hello\tWorld  ": 0xA430D84680AABD0B, "Ärger über große Rechnungen 東京": 0x7F3625BE333129A6, "invoice-2026, invoice-2026! paid?": 0xB00568450D394DA0}


def test_simhash_values(spark):
    assert {t: TX.simhash_of(t) % 2**64 for t in SIMHASHES} == SIMHASHES
    got = C.prints(spark.createDataFrame([("a", " \n"), ("b", None), ("c", "same short note"), ("d", "x" * 64)], "path string, body string"), "path", "body").collect()
    assert {(x["id"], x["short"]) for x in got} == {("c", True), ("d", False)}


def test_labels(spark):
    pairs = spark.createDataFrame([(5, 6), (6, 9), (1, 2), (9, 3)], "a long, b long")
    assert {r["node"]: r["label"] for r in labels(pairs).collect()} == {1: 1, 2: 1, 3: 3, 5: 3, 6: 3, 9: 3}


def test_chunks_slice_back(spark):
    text = "---\na: 1\n---\nbefore\n# A\n" + "wörter und sätze. " * 200 + "\n## B ##\n" + "x" * 2500 + "\n```\n# in code\n```\n####### none\n#none\n"
    got = R.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n")], "id long, text string"), "id", "text").collect()
    raw = text.encode()
    assert {r["id"] for r in got} == {1} and {r["heading"] for r in got} == {"offset:13", "A", "A > B ##", "in code"}
    assert all(raw[r["start"] : r["end"]].decode(errors="replace") == r["content"] and hashlib.sha256(raw[r["start"] : r["end"]]).hexdigest() == r["hash"] for r in got)
    assert len({r["chunk_id"] for r in got}) == len(got) and [r["chunk_index"] for r in got] == list(range(len(got)))


def test_spans_of():
    """Expected spans worked out by hand from the rule: parts, merging up to the size, overlap of the last bytes."""
    assert R.spans_of(b"") == [(0, 0, b"")]
    assert R.spans_of(b"aa bb cc", 5, 2) == [(0, 5, b"aa bb"), (3, 8, b"bb cc")]
    assert R.spans_of(b"aaaa\nbb cccccccc", 6, 2) == [(0, 4, b"aaaa"), (5, 7, b"bb"), (8, 14, b"cccccc"), (12, 16, b"cccc")]
    assert R.spans_of(b"a  bcd", 4, 2) == [(0, 2, b"a "), (0, 5, b"a bcd")]
    assert [s[:2] for s in R.spans_of(b"x" * 2500)] == [(0, 1000), (800, 1800), (1600, 2500)]
    # a paragraph that is too large is cut by itself
    assert [s[:2] for s in R.spans_of(b"p\n\n" + b"w " * 600 + b"\n\nq")] == [(0, 1), (3, 1002), (802, 1203), (1205, 1206)]


def test_local_vector():
    v = R.local_vector("Haus, haus und Hof!", 64)
    digest = hashlib.sha256("Haus, haus und Hof!".encode()).digest()
    exp = np.zeros(64)
    for i, w in ((0, "haus"), (1, "haus"), (3, "hof")):
        exp[TX.fnv1a32(w) % 64] += 1 + digest[i] / 255
    assert np.allclose(v, exp / np.linalg.norm(exp), atol=1e-6)
    for empty in ("", " .,", "und the"):
        assert R.local_vector(empty, 8).tolist() == [1] + [0] * 7


def test_vector_search_all(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 5)).round(1)
    x[7] = 0
    x[11] = x[13] = x[200]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 5), (900, None)], "vec_id long, embedding array<float>").repartition(7)
    got = {}
    for q in R.vector_search_all(rows, rows.where("vec_id % 50 = 0"), 4, block=16).collect():
        got.setdefault(q["query"], []).append((q["id"], q["score"]))
    n = np.maximum(np.linalg.norm(x.astype(np.float32).astype(float), axis=1), 1e-300)
    u = x.astype(np.float32).astype(float) / n[:, None]
    for i in range(0, 300, 50):
        s = u @ u[i]
        assert [j for j, _ in sorted(got[i], key=lambda p: (-round(p[1], 9), p[0]))] == sorted(range(300), key=lambda j: (-round(s[j], 9), j))[:4]


def test_index_equals_scan(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = IX.SearchIndex.build(docs, "doc_id", F.col("text"), str(tmp_path))
    for q in ("idiot", "The moron", "nosuchword the", "", "of of"):
        ws = IX.words_of(q)
        exp = [] if not ws else S.bm25(docs, "doc_id", F.col("text"), ws).orderBy(F.desc("score"), "id").limit(20).collect()
        got = index.search(q).collect()
        assert sorted((x["id"], round(x["score"], 9)) for x in got) == sorted((x["id"], round(x["score"], 9)) for x in exp) or {round(x["score"], 9) for x in got} == {round(x["score"], 9) for x in exp}
    assert "PartitionFilters: [bucket" in index.search("idiot")._jdf.queryExecution().toString().replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket")


def test_bm25_public_values(spark):
    """Order and path filter of a public test corpus."""
    rows = [("/vault/alpha/a.md", "quartz quartz quartz guide"), ("/vault/alpha/b.md", "quartz quartz guide"), ("/vault/beta/c.md", "quartz guide"), ("/vault/beta/d.md", "unrelated material")]
    docs = spark.createDataFrame(rows, "path string, body string")
    hits = S.bm25(docs, "path", F.col("body"), ["quartz"]).orderBy(F.desc("score"), "id").collect()
    assert [x["id"][-4:] for x in hits] == ["a.md", "b.md", "c.md"]
    assert [x["id"][-4:] for x in S.bm25(docs, "path", F.col("body"), ["quartz"]).where(F.col("id").startswith("/vault/beta")).collect()] == ["c.md"]


def test_pdf_errors_and_object_streams(spark):
    inner = b"1 0 2 40 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(40) + b"<< /Type /Pages /Kids [3 0 R] >>"
    stream = zlib.compress(inner)
    body = b"9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream endobj\n"
    body += b"3 0 obj << /Type /Page /Contents 4 0 R >> endobj\n4 0 obj << >>\nstream\nBT (a\\051\\\nb) ' (c) ' ET\nendstream endobj\n8 0 obj << /Type /XRef /Root 1 0 R >> endobj"
    rows = [("good", b"%PDF-1.5\n" + body), ("none", b"text"), ("locked", b"%PDF-1.4 /Encrypt 5 0 R"), ("null", None), ("image", b"%PDF-1.4\n3 0 obj << /Type /Page /Contents 4 0 R >> endobj 4 0 obj << /Filter /DCTDecode >>\nstream\nx\nendstream endobj")]
    got = {x["path"]: (x["page"], x["text"], x["error"]) for x in PDF.pages(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"good": (1, "a)b\nc", ""), "none": (None, None, "no PDF file"), "locked": (None, None, "encrypted"), "null": (None, None, "no PDF file"), "image": (None, None, "unsupported filter DCTDecode")}
    assert SRC.extract(spark.createDataFrame([("x.pdf", rows[0][1])], "path string, content binary")).first()["text"] == "a)b\nc"


def test_front_matter():
    assert SRC.front_matter("---\na: 'x: y'\nb: [p, 'q']\nc:\n  d: 1\ne: 2024-01-02\n---\nz") == ({"a": "x: y", "b": "[p, q]", "c": '{"d": "1"}', "e": "2024-01-02"}, "z", "")
    assert SRC.front_matter("---\na: 1\na: 2\n---\nz")[1:] == ("z", "duplicate key a")
    assert SRC.front_matter("---\n- a\n---\nz")[2] == "front matter: front matter is no mapping"
    assert SRC.front_matter("---\na: 1\n")[2] == "unterminated front matter" and SRC.front_matter("no")[0] == {}


def test_mentions_equal_contains(spark):
    r = random.Random(6)
    docs = [(f"d{i}", "".join(r.choice("abcÄ ") for _ in range(r.randint(0, 30)))) for i in range(60)] + [("null", None)]
    names = [(i, "".join(r.choice("abcä") for _ in range(n))) for i, n in enumerate([0, 1, 1, 2, 2, 3, 3, 4, 5])]
    got = {(x["path"], x["entity"]) for x in G.mentions(spark.createDataFrame(docs, "path string, t string"), spark.createDataFrame(names, "entity int, name string"), F.col("t")).collect()}
    assert got == {(p, e) for p, t in docs if t for e, n in names if n and n in t.lower()}


def test_state_machine(spark):
    event = lambda n, kind, author="a", **body: (n, dt.datetime(2024, 1, 1, 0, n), author, n, str(n), kind, json.dumps(body))
    new = {"title": "t", "plan_file": "p", "adapter": ""}
    rows = [
        event(1, "run.started", run_id="x"), event(2, "run.requested", run_id="x", **new), event(3, "run.approved", author="b", run_id="x", approval_id="1", scope="s", expires_at="e"),
        event(4, "run.finished", run_id="x"), event(5, "run.failed", run_id="y", error="e"), event(6, "run.requested", run_id="", **new), event(7, "run.requested", run_id="z", **new),
        event(8, "run.cancelled", run_id="z", reason="r"), event(9, "run.requested", run_id="z", **new),
    ]
    events = spark.createDataFrame(rows, "lamport long, ts timestamp, author string, seq long, id string, kind string, body string")
    got = {x["run_id"]: (x["state"], x["approval_id"], x["adapter"]) for x in ST_.runs(events).collect()}
    assert got == {"x": ("approved", "1", None), "z": ("requested", None, None)}
    only = spark.createDataFrame([("a",)], "author string")
    assert {x["run_id"]: x["state"] for x in ST_.runs(events, only).collect()} == {"x": "requested", "z": "requested"}
    assert [x["run_id"] for x in ST_.pending_runs(ST_.runs(events)).collect()] == ["x", "z"]


def test_backup_refuses_damage(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit("v").alias("v"))
    K.backup(rows, str(tmp_path / "b"))
    assert K.restore(spark, str(tmp_path / "b")).count() == 10
    rows.limit(9).write.mode("overwrite").parquet(str(tmp_path / "b/rows"))
    with pytest.raises(ValueError, match="damaged"):
        K.restore(spark, str(tmp_path / "b"))


def test_chunk_queries_cover_whole_tables(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert max(docs) >= 100
    exp, old = [], []
    for i, t in docs.items():
        n = 0
        for _, body, at in R.sections_of(t or ""):
            for s, _, raw in R.spans_of(body.encode()):
                exp.append((R.chunk_id(str(i), hashlib.sha256(raw).hexdigest(), at + s), at + s))
                old.append((i, n, raw.decode(errors="replace")))
                n += 1
    assert sorted(map(tuple, Q.QUERIES["X32_chunk_ids"](spark, sf).collect())) == sorted(exp)
    new = [x for x in old if x[0] % 2] + [(i, 0, "new") for i in docs if i % 2 == 0]
    assert sorted(map(tuple, Q.QUERIES["K5_chunk_replace_texts"](spark, sf).collect())) == sorted(new)
    assert {r["doc_id"] for r in Q.QUERIES["S10_property_map"](spark, sf).collect()} == set(docs)


def test_ivf_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    v = v.union(spark.createDataFrame([(-1, [0.0] * 64)], v.schema))
    index = R.IvfIndex(v)
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in v.collect()}
    ids = sorted(x)
    m = np.array([x[i] / max(np.linalg.norm(x[i]), 1e-12) for i in ids])
    found, asked = 0, [i for i in ids if i % 200 == 0]
    for i in asked:
        best = {ids[j] for j in np.argsort(-(m @ x[i]), kind="stable")[:10]}
        found += len(best & {r["vec_id"] for r in index.search(x[i].tolist(), 10).collect()})
    assert found >= 0.9 * 10 * len(asked)
    assert [r["vec_id"] for r in index.search([0.0] * 64, 3).collect()] == ids[:3]


def test_graph_priorities(spark):
    nodes = spark.createDataFrame([("a/x.md", "X title", ["nick"]), ("b/x.md", "nick", []), ("x.md", "other", None)], "path string, title string, aliases array<string>")
    edges = spark.createDataFrame([("s", t) for t in ("x.md", "X", "a/x", "Nick", "./b/x.md", "gone")], "src string, target string")
    got = {r["target"]: r["dst"] for r in G.resolve(edges, nodes).collect()}
    assert got == {"x.md": "x.md", "X": "x.md", "a/x": "a/x.md", "Nick": "b/x.md", "./b/x.md": "b/x.md", "gone": None}
    docs = spark.createDataFrame([("p", "see [[A|b]] [t](c.md#x) ![i](i.png) [w](http://x) `[[no]]`")], "path string, body string")
    assert {(r["target"], r["kind"]) for r in G.links(docs, "path", "body").collect()} == {("A", "wikilink"), ("c.md", "markdown")}


def test_overlap_join(spark):
    r = random.Random(7)
    seg = [(i, i % 2, a, a + r.randint(0, 400)) for i, a in enumerate(r.randrange(5000) for _ in range(60))]
    turn = [(f"s{i % 3}", i % 2, a, a + r.randint(0, 900)) for i, a in enumerate(r.randrange(5000) for _ in range(40))]
    got = {x["id"]: (x["speaker"], x["overlap"], x["speakers"]) for x in J.overlap_join(spark.createDataFrame(seg, "id long, track long, start long, end long"), spark.createDataFrame(turn, "speaker string, track long, start long, end long"), 250).collect()}
    exp = {}
    for i, t, a, b in seg:
        total = {}
        for s, u, c, d in turn:
            o = min(b, d) - max(a, c)
            if t == u and o > 0:
                total[s] = total.get(s, 0) + o
        if total:
            best = min(total, key=lambda s: (-total[s], s))
            exp[i] = (best, total[best], ",".join(sorted(total)))
    assert got == exp


def test_debounce(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda ms: t + dt.timedelta(milliseconds=ms)
    rows = [("a", at(0), 2), ("a", at(499), 1), ("a", at(500), 4), ("a", at(900), 4), ("b", at(5), 4)]
    got = {(r["path"], r["ts"], r["op"]) for r in ST.debounced(spark.createDataFrame(rows, "path string, ts timestamp_ntz, op int")).collect()}
    assert got == {("a", at(0), "create"), ("a", at(500), "remove"), ("b", at(5), "remove")}


def test_debounce_stream(spark, tmp_path):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([("a", t, 2), ("a", t + dt.timedelta(milliseconds=100), 1), ("b", t, 4)], "path string, ts timestamp, op int")
    d.write.parquet(f"{tmp_path}/in")
    stream = ST.debounce_stream(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), 300)
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(40):
        time.sleep(0.5)
        if spark.table("bursts").count() == 2 or not q.isActive:
            break
    got = {(r["path"], r["ts"], r["op"]) for r in spark.table("bursts").collect()}
    q.stop()
    assert got == {("a", t, "create"), ("b", t, "remove")}


def test_quiet_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "ab"[i % 2], t + dt.timedelta(milliseconds=m)) for i, m in enumerate((0, 10, 300, 700, 2000, 2100, 60_000, 60_000))]
    d = spark.createDataFrame(rows, "event_id long, path string, ts timestamp")
    d.write.parquet(f"{tmp_path}/in")
    q = ST.quiet_stream(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), "path").writeStream.format("memory").queryName("quiet").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    closed = {(r["path"], r["first"], r["last"], r["n"]) for r in spark.table("quiet").collect()}
    batch = {(r["path"], r["first"], r["last"], r["n"]) for r in ST.quiet_periods(d, "path").collect()}
    assert closed == {x for x in batch if x[2] < t + dt.timedelta(seconds=40)}


def test_sources(spark, tmp_path):
    (tmp_path / "v/.venv").mkdir(parents=True)
    (tmp_path / "v/a.md").write_text("---\ntitle: T\ntags: [x, y]\nn: 1\n---\nbody #z\n")
    (tmp_path / "v/b.md").write_text("---\nk: 1\nk: 2\n---\n")
    (tmp_path / "v/.venv/c.md").write_text("no")
    (tmp_path / "v/p.html").write_text("<head><title>t</title></head><p>Hello <b>you</b></p><script>x</script><div>two</div>")
    (tmp_path / "v/r.rtf").write_text(r"{\rtf1{\fonttbl{\f0 A;}}Gr\'fc\'dfe\par line}")
    with zipfile.ZipFile(tmp_path / "v/d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:d>')
    files = SRC.walk(spark, str(tmp_path / "v"))
    md = {r["path"].rsplit("/", 1)[-1]: r for r in SRC.markdown(files.where("path like '%.md'")).collect()}
    assert (md["a.md"]["title"], md["a.md"]["tags"], md["a.md"]["frontmatter"]["n"], md["a.md"]["body"]) == ("T", ["x", "y"], "1", "body #z\n")
    assert md["b.md"]["error"] == "duplicate key k" and set(md) == {"a.md", "b.md"}
    got = {r["path"].rsplit("/", 1)[-1]: (r["kind"], r["text"]) for r in SRC.extract(files.where("path not like '%.md'")).collect()}
    assert got == {"p.html": ("html", "Hello you\n\ntwo"), "r.rtf": ("rtf", "Grüße\nline"), "d.docx": ("docx", "one\ntwo")}
    assert SRC.strict_csv("a, b\n1,\"x\ny\"\n") == (["a", "b"], [["1", "x\ny"]])
    for bad in ("", "a,A\n", "a,\n", "a,b\n1\n"):
        with pytest.raises(SRC.CsvError):
            SRC.strict_csv(bad)
    assert SRC.vcards("BEGIN:VCARD\r\nFN:A\r\n B\r\nTEL;TYPE=x:+1\r\nEND:VCARD") == [{"name": "AB", "phone": "+1"}]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.jsonl").write_text(json.dumps({"id": "1", "author": "a", "seq": 1}) + "\n\n")
    assert [(r["id"], r["seq"]) for r in SRC.journal(spark, str(tmp_path / "j")).collect()] == [("1", 1)]
    (tmp_path / "act").mkdir()
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / f"act/{day}.ndjson").write_text(json.dumps({"ts": day, "event": "e"}) + "\n")
    assert SRC.activity(spark, str(tmp_path / "act"), "2024-01-02", "2024-01-02").count() == 1


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("s1", 1, "a|b"), ("s2", 2, None)], "slug string, n int, title string")
    K.replace_partition(d, f"{tmp_path}/t", "slug")
    K.replace_partition(d.where("slug = 's2'").withColumn("n", F.lit(9)), f"{tmp_path}/t", "slug")
    assert {(r["slug"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("s1", 1), ("s2", 9)}
    assert K.markdown_table(d.orderBy("n"), ["n", "title"], 1) == "| n | title |\n| --- | --- |\n| 1 | a\\|b |\n\n*1 rows shown*"
    K.write_csv(d, f"{tmp_path}/c", headers={"n": "N"})
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["title", "N", "slug"]
    seg = spark.createDataFrame([(1, 1, "A", 0, 1500, "hi"), (1, 2, "B", 1500, 2000, "yo")], "meeting long, id long, speaker string, start long, end long, text string")
    assert K.transcript(seg, "srt").first()["text"] == "1\n00:00:00,000 --> 00:00:01,500\nA: hi\n\n2\n00:00:01,500 --> 00:00:02,000\nB: yo"


def test_simhash_similarity(spark):
    a, b = "Monthly utility bill for Alice from Power Co. Amount due: $150.00", "Monthly utility bill for Alice from Power Co. Amount due: $155.00"
    d = spark.createDataFrame([(TX.simhash_of(a), TX.simhash_of(b))], "a long, b long")
    assert tuple(d.select(TX.hamming(F.col("a"), F.col("b")), TX.similarity(F.col("a"), F.col("b"))).first()) == (8, 87)
