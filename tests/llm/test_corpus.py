"""Each corpus operator against brute force on small and hostile tables."""

import collections
import hashlib
import random
import time
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedgeline.llm import fingerprints as fp
from sedgeline.llm import near_dedup
from sedgeline.llm.components import components
from sedgeline.llm.decontaminate import decontaminate
from sedgeline.llm.mixing import mix, take
from sedgeline.llm.near_dedup import keep_one, near_duplicates
from sedgeline.llm.passages import EVERY, GRAM, MIN_WORDS, WINDOW, anchors, dedup_passages
from sedgeline.llm.pii import KINDS, find_personal_data, listed
from sedgeline.llm.quality import SHAPE_BUCKETS, WORD_BUCKETS, kth_largest, select
from sedgeline.llm.scratch import Scratch
from sedgeline.llm.sharding import TOLERANCE, assign_shards
from sedgeline.llm.tokens import blocks, mix as mixed, span_hashes, windows
from sedgeline.llm.toxicity import fit, score
from sedgeline.llm.url_filter import RULES, filter_urls

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, r):
    return " ".join(r.choice(VOCAB) + r.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


def corpus():
    """Copies, near copies of one base, shared passages, short, empty, null and very long texts."""
    r = random.Random(9)
    texts = [prose(r.randint(1, 150), r) for _ in range(60)]
    base = prose(120, r).split(" ")
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(VOCAB) + "x"
        texts.append(" ".join(w))
    passage = prose(60, r)
    texts += [prose(20, r) + "\n" + passage + "\n" + prose(20, r) for _ in range(8)]
    texts += [texts[3]] * 12 + ["", None, " \n\t ", "one", "one two", "one two", "Ünï ÇÖDE ünï", "x" * 50_000, prose(20_000, r), "\x00\x01", "e" * 30 + "@" + "f.g" * 3]
    return list(enumerate(texts))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in DOCS], SCHEMA).repartition(5).cache()


def labels_of(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 7 == 0)) for i, _ in DOCS[:90]] + [(None, 1, 1), (3, None, None), (99999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("n", "up", "down"), [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates(docs, n, up, down):
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, shingle=n, similarity=(up, down)).collect()}
    assert got == brute.near(DOCS, n, up, down)


def test_near_duplicates_many_close_copies(spark):
    """Copies around one base of which many are too far from each other, so that further pivots are needed."""
    r = random.Random(3)
    base = prose(100, r).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {x["id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, similarity=(85, 100)).collect()}
    assert got == brute.near(rows, 3, 85, 100)


def test_keep_one_nulls_and_repeats(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (3, None)]
    left = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in left) == collections.Counter([rows[0], rows[3], rows[4], rows[5]])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (102, 100)] + [(200, 200 + k) for k in range(1, 30)] + [(None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{200 + k: 200 for k in range(30)}}


def test_decontaminate(spark, docs):
    bench = [(1, DOCS[5][1]), (2, " ".join(DOCS[-3][1].split()[100:140])), (2, "one two"), (None, "ünï çöde"), (4, ""), (5, None), (6, "one")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate(docs, b).collect()}
    exp = brute.contamination(DOCS, bench)
    assert got == exp
    left = {r["doc_id"] for r in decontaminate(docs, b, action="documents").collect()}
    assert left == {i for i, v in exp.items() if not v[4]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate(docs, b, action="spans").collect()}
    assert all(v[1] == 0 for v in brute.contamination([(i, t) for i, t in cut.items() if exp[i][1]], [x for x in bench if x[0] == 2]).values())
    assert all(cut[i] == t for i, t in DOCS if exp[i][1] == 0)


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """3,000 near copies, and 400 texts just beyond the threshold from all of them, cost about as many comparisons as there are texts."""
    r = random.Random(17)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 3000):
        w = list(base)
        w[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(3000, 3400):
        w = list(base)
        for k in r.sample(range(0, 200, 4), 12):  # 36 shingles of 198 go, 36 come: 0.69 like the base
            w[k] = f"y{i}-{k}"
        rows.append((i, " ".join(w)))
    made = []
    for name in ("_around_pivots", "_paired"):
        plain = getattr(near_dedup, name)

        def counted(*a, plain=plain):
            out = plain(*a)
            made.append(out.count())
            return out

        monkeypatch.setattr(near_dedup, name, counted)
    got = {x["id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, similarity=(85, 100)).collect()}
    assert {got[i] for i in range(3000)} == {0} and all(got[i] == i for i in range(3000, 3400))
    assert sum(made) <= 6 * len(rows)


def test_decontaminate_in_slices(spark, docs, monkeypatch):
    import sedgeline.llm.decontaminate as d

    bench = [(k, DOCS[k][1]) for k in range(30)]
    b = spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(d, "SLICE_BYTES", 2_000)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate(docs, b).collect()}
    assert got == brute.contamination(DOCS, bench)


def test_report_replaces_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, n_hit long")
    r = decontaminate(d, spark.createDataFrame([(1, "a")], "item_id long, text string")).first()
    assert (r["n_hit"], r["n_words"]) == (1, 2)


def test_fingerprints(docs):
    got = {r["doc_id"]: r for r in fp.fingerprint_with_edit(docs).collect()}
    assert len(got) == len(DOCS)
    for k, (i, t) in enumerate(DOCS):
        t, after = t or "", DOCS[(k + 1) % len(DOCS)][1] or ""
        gone = len(t) // 2
        edited = t[: len(t) - gone] + after[:gone]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fp.encoded(*(lambda w: (w.step, w.bits()))(fp.Walk().over(fp._codes(t))))
        assert r["edited_fingerprint"] == fp.encoded(*(lambda w: (w.step, w.bits()))(fp.Walk().over(fp._codes(edited))))
        assert r["near_next"] == fp.likeness(fp.decoded(r["fingerprint"]), fp.decoded(got[DOCS[(k + 1) % len(DOCS)][0]]["fingerprint"]))
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= 0.9 * len(long) - 20


def test_fingerprint_order_nulls_and_repeats(spark):
    rows = [(None, "n"), (5, "b"), (5, "a"), (9, "zz"), (9, "zz")]
    got = fp.fingerprint_with_edit(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ordered = ["n", "a", "b", "zz", "zz"]
    exp = collections.Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + ordered[(k + 1) % 5][: len(t) // 2]).encode()).hexdigest() for k, t in enumerate(ordered))
    assert collections.Counter(r["edited_sha256"] for r in got) == exp


def test_near_texts_recall_and_precision(spark):
    """150 texts with 5 % of their characters replaced find their originals; classes hold linked texts only."""
    r = random.Random(21)
    rows, edited = [], {}
    for i in range(150):
        t = prose(r.randint(60, 400), r)
        e = "".join(r.choice("xyz") if r.random() < 0.05 else c for c in t)
        edited[i] = (t, e, fp.edit_distance(t, e, len(t)) <= 0.07 * max(len(t), len(e)))
        rows += [(i, t), (1000 + i, e)]
    # a family of near copies of which neighbours are alike, many copies, repeated ids, null, empty, short, very long
    chain = prose(200, r)
    for i in range(40):
        k = r.randrange(len(chain))
        chain = chain[:k] + "Q" + chain[k + 1 :]
        rows.append((2000 + i, chain))
    long = prose(40_000, r)
    rows += [(3000 + i, "copy " * 30) for i in range(300)] + [(0, "another text of id 0"), (None, rows[0][1]), (4000, None), (4001, ""), (4002, "ab"), (4003, "ab"), (5000, long), (5001, long[:100_000] + "!" + long[100_000:])]
    got = fp.near_texts(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, class_id int"), max_edits=0.07).collect()
    assert len(got) == len(rows)
    of = collections.defaultdict(list)
    for x in got:
        of[x["id"]].append((x["copy_of"], x["class_id"]))
    want = [i for i, (_, _, near) in edited.items() if near and i]
    assert len(want) >= 130 and sum(of[1000 + i] == [(1000 + i, i)] for i in want) >= 0.9 * len(want)
    assert all(of[i] == [(i, i)] for i in range(1, 150))
    assert {of[2000 + i][0][1] for i in range(40)} == {2000} and {of[3000 + i][0] for i in range(300)} == {(3000, 3000)}
    assert of[None] == [(None, None)] and of[4001] == [(4000, 4000)] and of[4003] == [(4002, 4002)] and of[5001] == [(5001, 5000)]
    assert fp.near_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edit_distance_of_many_edits_costs_as_few():
    """The banded way against the table of all prefixes; texts with hundreds of edits in well under a second."""
    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
        b = "".join(r.choice("abc") for _ in range(r.randint(0, 14))) if r.random() < 0.4 else "".join(c for c in a if r.random() < 0.9) + r.choice(["", "a"])
        limit, row = r.randint(0, 16), list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (c != d))
        assert fp._banded(a, b, limit) == fp.edit_distance(a, b, limit) == min(row[-1], limit + 1)
    t = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    # every 25th character is another one, which is in no text otherwise
    e = "".join("Q" if i % 25 == 0 else c for i, c in enumerate(t))
    start = time.process_time()
    assert fp.edit_distance(t, e, 1500) == 1200 and fp.edit_distance(t, e, 1100) == 1101
    assert time.process_time() - start < 1.0


def test_edit_distances_side_by_side():
    """Many pairs at once against one by one: all widths of bands, texts of one length and not, characters of one byte and more."""
    r = random.Random(6)
    pairs, limits = [], []
    for i in range(900):
        alphabet = r.choice(["ab", "abcdefgh ", "abc\u00ff\u20ac", "ab\U0001f600"])
        a = "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 31, 32, 33, 64, 200, 500]) if i % 10 else r.randint(1000, 3000)))
        share = r.choice([0, 0.02, 0.05, 0.1, 0.4])
        b = "".join(r.choice(["", r.choice(alphabet), c + r.choice(alphabet)]) if r.random() < share else c for c in a)[r.choice([0, 0, len(a) // 25]) :]
        pairs.append((a, b) if i % 2 else (b, a))
        limits.append(int(r.choice([0.02, 0.05, 0.1, 0.3, 1]) * max(len(a), len(b))))
    got = fp.edit_distances(pairs, limits)
    assert got == [fp._banded(a, b, limit) for (a, b), limit in zip(pairs, limits, strict=True)]
    assert 200 < sum(d <= limit for d, limit in zip(got, limits, strict=True)) < 800 and fp.edit_distances([], []) == []


def test_near_texts_with_one_header_are_not_read_in_pairs(spark, monkeypatch):
    """Texts that share only a header and a length are ruled out by counts; classes are those of all pairs."""
    r = random.Random(8)
    header = prose(60, r)
    texts = [(header + " " + prose(400, r))[:1400] for _ in range(90)]
    for i in range(0, 30, 3):
        k = r.randrange(400, 1300)
        texts += [texts[i][:k] + "Q" * r.choice([1, 20, 70, 90]) + texts[i][k + 5 :], texts[i][:k] + texts[i][k + r.randint(1, 40) :]]
    read, verified = [], fp._verified
    monkeypatch.setattr(fp, "_verified", lambda pairs, *rest: read.append(pairs.count()) or verified(pairs, *rest))
    got = {x["id"]: x["class_id"] for x in fp.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(read) < 200  # of 5,995
    label = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            limit = int(0.05 * max(len(texts[a]), len(texts[b])))
            if label[a] != label[b] and fp._banded(texts[a], texts[b], limit) <= limit:
                least, other = sorted((label[a], label[b]))
                label = [least if x == other else x for x in label]
    assert got == dict(enumerate(label)) and len(set(label)) < len(label) - 10


def test_similar_and_edit_distance(spark, docs):
    r = random.Random(1)
    for _ in range(60):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 14)))
        b = "".join(r.choice("ab") for _ in range(r.randint(0, 14)))
        d = brute.edits(a, b)
        assert fp.edit_distance(a, b, 20) == d
        assert fp.edit_distance(a, b, 2) == min(d, 3)
    text = prose(300, r)
    near = text[:700] + "ZZ" + text[700:]
    pairs = fp.similar(spark.createDataFrame([(1, text), (2, near), (3, prose(300, r)), (4, text)], "doc_id long, text string")).collect()
    assert {(p["a"], p["b"], p["edits"]) for p in pairs} == {(1, 2, 2), (1, 4, 0)}


def test_toxicity(spark):
    r = random.Random(2)
    rows, lab = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = prose(40, r).split(" ")
        if bad:
            w[7], w[20] = r.choice(["vilefool", "Vilefools"]), "grubworm"
        rows.append((i, " ".join(w)))
        lab.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "  ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = score(d, fit(d, spark.createDataFrame(lab + [(None, 1), (7, None)], "doc_id long, toxic int")))
    got = {x["doc_id"]: x for x in found.collect()}
    truth = dict(lab)
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i]["score"] >= 0.7) == bool(truth[i]) for i in out)
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"] < 0.2
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_toxicity_neighbours_are_exact(spark):
    import numpy as np

    from sedgeline.llm.toxicity import Index

    r = np.random.default_rng(4)
    ix = Index(np.arange(1, 41, dtype=np.uint64), np.ones(40), 7)
    vectors = [ix.vector(np.sort(r.integers(0, 40, r.integers(1, 6)))) for _ in range(500)]
    ix.fill(list(range(500)), [0] * 500, vectors)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for _ in range(50):
        t, w = ix.vector(r.integers(0, 40, 4))
        cos = dense[:, t] @ w
        best = np.sort(cos[cos > 0])[::-1][:7]
        assert np.allclose([s for s, _ in ix.nearest(t, w)], best)


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = score(d, fit(d, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert {r["score"] for r in got} == {0.5}


def test_anchors_equal_brute_force():
    """Chunks of lines end where the hash of two successive lines says so; runs are the least of a window."""
    r = random.Random(8)
    texts = [t or "" for _, t in DOCS] + ["", "\n", " a\nb ", "\n".join(prose(r.randint(1, 9), r) for _ in range(200)), prose(5000, r), "same " * 500 + prose(30, r), "a b " * 200]
    word = re.compile(rb"[^\x00-\x20]+")
    h64 = lambda x: int(span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
    for column in (pa.array(texts), pa.array(texts[::-1])):
        got = collections.defaultdict(set)
        for block in blocks(column, 4000):
            for t, k, *place in zip(*(x.tolist() for x in anchors(block)), strict=True):
                got[block.first + t].add((k, *place))
        for i, t in enumerate(column.to_pylist()):
            raw = t.encode()
            ws = [m.span() for m in word.finditer(raw)]
            runs = [raw[ws[j][0] : ws[j + GRAM - 1][1]] for j in range(len(ws) - GRAM + 1)]
            h = [h64(x) for x in runs]
            exp = set()
            for at in range(max(1, len(h) - WINDOW + 1) if h else 0):
                part = h[at : at + WINDOW]
                exp |= {(j, j + GRAM - 1) for j in range(at, at + len(part)) if h[j] == min(part)}
            picked, run = set(), []
            for j, z in [*sorted(exp), (None, None)]:
                if run and (j is None or j != run[-1] + 1 or h[j] != h[run[-1]]):
                    picked |= {(i, i + GRAM - 1) for n, i in enumerate(run) if n % GRAM == 0 or i == run[-1]}
                    run = []
                run.append(j)
            exp = picked
            lines, chunk, at, before = [], [], 0, None
            for line in raw.split(b"\n"):
                own = [j for j, w in enumerate(ws) if at <= w[0] < at + len(line)]
                at += len(line) + 1
                if own:
                    now = h64(raw[ws[own[0]][0] : ws[own[-1]][1]])
                    lines.append((own[0], own[-1], before is not None and int(mixed(np.array([(now * 0x9E3779B97F4A7C15 + before) % 2**64], np.uint64))[0]) % EVERY == 0))
                    before = now
            for j, (a, z, end) in enumerate(lines):
                chunk.append((a, z))
                if end or j == len(lines) - 1:
                    if len(chunk) > 1 and chunk[-1][1] - chunk[0][0] + 1 >= MIN_WORDS:
                        exp.add((chunk[0][0], chunk[-1][1]))
                    chunk = []
            full = set()
            for a, z in exp:
                lo, hi = max(0, a - WINDOW), min(len(ws) - 1, z + WINDOW)
                key = h64(raw[ws[a][0] : ws[z][1]])
                full.add((key - 2**64 if key >= 2**63 else key, ws[a][0], ws[z][1], 0 if lo == 0 else ws[lo][0], len(raw) if hi == len(ws) - 1 else ws[hi][1]))
            assert got[i] == full


def test_line_chunks_resist_shifts():
    r = random.Random(8)
    text = "\n".join(prose(r.randint(4, 12), r) for _ in range(200))
    spans = lambda t: {t.encode()[a:z] for _, _, a, z, _, _ in zip(*(x.tolist() for x in anchors(next(blocks(pa.array([t]))))), strict=True)}
    a, b = spans(text), spans("Some new words here.\nAnd there.\n" + text)
    assert len(a & b) >= 0.9 * len(a)


def test_passages_go_whole_wherever_they_stand(spark):
    r = random.Random(12)
    words = lambda n: [r.choice(VOCAB) for _ in range(n)]
    texts, shared = [], []
    for n in [33, 40, 51, 60, 90, 400] * 5:
        shared.append(" ".join(words(n)))
        for sep in (" ", ". ", "\n"):
            texts.append(f"{' '.join(words(r.randint(0, 150)))}{sep}{shared[-1]}{sep}{' '.join(words(r.randint(0, 150)))}")
    texts += [None, "", texts[0], " ".join(["same"] * 300), "é\u2003 😀 " * 60]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    got = {(x["doc_id"], x["old"]): x for x in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", F.col("text"))).collect()}
    for k, p in enumerate(shared):
        assert p in got[3 * k, texts[3 * k]]["text"]
        for i in (3 * k + 1, 3 * k + 2):
            before, after = texts[i].split(p)
            assert got[i, texts[i]]["text"].split() == before.split() + after.split()
            assert got[i, texts[i]]["n_removed"] == 1
    assert got[30 * 3 + 2, texts[0]]["text"] == "" and got[None, texts[1]]["text"] == ""
    assert got[30 * 3, None]["text"] is None and got[30 * 3 + 1, ""]["text"] == ""


def test_passages_leave_one_copy(spark, docs):
    n = GRAM + WINDOW - 1
    for x in (got := dedup_passages(docs).join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").collect()):
        raw, kept, at = (x["old"] or "").encode(), [], 0
        for s, e in x["removed"]:
            kept.append(raw[at:s])
            at = e
        kept.append(raw[at:])
        assert b"".join(kept).decode() == (x["text"] or "")
    grams = lambda t: {t[a[0].start() : a[-1].end()] for a in zip(*(list(re.finditer(rb"[^\x00-\x20]+", t))[k:] for k in range(n)), strict=False)}
    everywhere, left = collections.Counter(), collections.Counter()
    for x in got:
        everywhere.update(grams((x["old"] or "").encode()))
        raw, at = (x["old"] or "").encode(), 0
        for s, e in [*x["removed"], (len(raw), len(raw))]:
            left.update(grams(raw[at:s]))
            at = e
    assert max(everywhere.values()) > 1 and max(left.values()) == 1


def test_secrets(spark):
    hex40 = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    texts = [f'token = "{hex40}" x', f"é{hex40.upper()}, {hex40}", "a" * 50, "1" * 50, hex40[:31], "a1" * 5000, None, "A" * 40_000 + "1", f"a@{hex40}.org"]
    got = {x["i"]: x for x in find_personal_data(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), id="i").collect()}
    spans = {i: [(s["start"], s["end"]) for s in x["spans"]["secret"]] for i, x in got.items()}
    assert spans == {0: [(9, 49)], 1: [(1, 41), (43, 83)], 2: [], 3: [], 4: [], 5: [(0, 10_000)], 6: [], 7: [(0, 40_001)], 8: [(2, 42)]}
    assert got[0]["sanitized"] == 'token = "<SECRET>" x' and got[6]["sanitized"] is None and got[8]["sanitized"] == "<EMAIL>"


def test_personal_data(spark):
    texts = [
        "a@b.c_d@e.f x", "mail é a.b+c@d-e.org.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (555) 010-9999 and +12",
        "4" * 15 + "2 " * 8, "@@", "x@y", "+" * 40, "a" * 5000 + "@" + "b" * 3000, None, "", "1" * 30_000, "1." * 9000, "tel +49.30.1234567 a@b.cc +1 2", "é😀 1.2.3.4 😀 a@b.co",
    ]
    d = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = find_personal_data(d)
    base = F.array_join(F.concat(*(listed(k, F.col("spans")[k]) for k in KINDS)), ",").alias("s")
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", base).collect()}
    assert got == {i: ",".join(brute.personal(t)) for i, t in enumerate(texts)}
    clean = {r["doc_id"]: r["sanitized"] for r in found.collect()}
    assert clean[15] == "é😀 <IP> 😀 <EMAIL>" and clean[10] is None and clean[11] == ""


def test_personal_data_disclosing_terms(spark):
    """A nickname that only ever stands beside one address gives it away, also where the address is missing."""
    r = random.Random(6)
    rows = [(i, f"{prose(12, r)} write to snorkelbeard at snork@mail.example.org {prose(12, r)}") for i in range(5)]
    rows += [(10 + i, prose(30, r) + " write to all at nobody") for i in range(40)]
    rows += [(100, "old Snorkelbeard was here"), (101, None)]
    got = {x["doc_id"]: x for x in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in got[100]["terms"]] == [(4, 16)]
    assert got[100]["sanitized"] == "old  was here"
    assert not any(got[10 + i]["terms"] for i in range(40))


def test_terms_count_documents_that_hold_both(spark):
    """Far from the value, in a fixed footer and with a value of two documents; not what a value meets once, nor a common word."""
    r = random.Random(16)
    rows = [(i, f"quillfeather {prose(60, r)} to quill@post.example.org") for i in range(2)]
    rows += [(10 + i, f"{prose(30, r)} Yours, Marrowgate, +49 30 1234567") for i in range(6)]
    rows += [(20, f"onceonly {prose(30, r)} once@post.example.org")]
    rows += [(100 + i, prose(40, r)) for i in range(2000)]
    rows += [(5000, "Quillfeather and Marrowgate met onceonly"), (None, None)]
    got = {x["doc_id"]: x for x in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5000]["sanitized"] == " and  met onceonly"
    assert not any(got[100 + i]["terms"] for i in range(2000))
    assert {t["value"].lower() for x in got.values() for t in x["terms"]} == {"quillfeather", "yours", "marrowgate"}


def test_mixing(spark):
    r = random.Random(12)
    rows, lab = [], []
    for i in range(400):
        junk = i % 3 == 0
        rows.append((i, " ".join(w + ("###" if junk else "") for w in prose(30, r).split(" ")), 1))
        if i % 2:
            lab.append((i, "junk" if junk else "good"))
    rows += [(900, None, 1), (901, "", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, rate int")
    known = spark.createDataFrame(lab + [(None, "junk"), (3, None), (5, "other")], "id long, domain string")
    got = mix(d, known, {"good": 0.9, "junk": 0.1}).collect()
    total = [sum(x["rate"] * x["n_tokens"] * x["posteriors"][k] for x in got) for k in (0, 1)]
    assert abs(total[0] / sum(total) - 0.9) < 0.01
    # brute force: the same least squares over single documents
    p = [x["posteriors"] for x in got]
    n = [x["n_tokens"] for x in got]
    mass = [sum(a * b[k] for a, b in zip(n, p, strict=True)) for k in (0, 1)]
    goal = [mass[0], mass[0] / 9]
    rate = [1.0] * len(p)
    for _ in range(60):
        s = [sum(q * a * b[k] for q, a, b in zip(rate, n, p, strict=True)) for k in (0, 1)]
        rate = [min(4.0, max(0.0, q - sum(b[k] * (s[k] - goal[k]) / mass[k] for k in (0, 1)))) for q, b in zip(rate, p, strict=True)]
    assert max(abs(a - x["rate"]) for a, x in zip(rate, got, strict=True)) < 0.02
    taken = take(d, known, {"good": 0.9, "junk": 0.1}, max_rate=1.0)
    assert taken.columns == d.columns
    kept = {x["doc_id"] for x in taken.collect()}
    assert sum(i % 3 == 0 for i in kept if i < 400) < 60 < 0.9 * 266 < sum(i % 3 != 0 for i in kept if i < 400)
    assert {x["rate"] for x in taken.collect()} == {1}
    with pytest.raises(ValueError):
        mix(d, known, {"good": 0.0})


def test_sharding(spark, docs):
    got = assign_shards(docs, 6).collect()
    assert len(got) == len(DOCS)
    by = collections.defaultdict(list)
    text = dict(DOCS)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_near_equal_with_hot_group(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text number {i} " * (1 + i % 5)) for i in range(6000)] + [(7, "rep")] * 50 + [(None, "null")] * 3
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    size, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"]].add(r["shard"])
    assert len(got) == len(rows) and set(size) == set(range(24))
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 24
    bytes_of = collections.Counter()
    for r in got:
        bytes_of[r["text_crc32"]] += r["size"]
    # only a group of copies that is larger than the tolerance is in several shards
    assert all(len(s) == 1 or bytes_of[c] > TOLERANCE * mean for c, s in where.items()) and len(where[zlib.crc32(b"the same text")]) > 4
    order = sorted(got, key=lambda r: (r["text_crc32"], r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in order)


def test_quality(spark):
    r = random.Random(13)
    rows, lab = [], []
    for i in range(500):
        junk = i % 6 == 0
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in prose(40, r).split(" "))))
        if i % 5 < 3:
            lab.append((i, int(not junk)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (3, "repeated id"), (None, "null id")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(list)
    for x in select(d, spark.createDataFrame(lab + [(None, 1), (5, None)], "doc_id long, quality int")).collect():
        got[x["id"]].append(x)
    assert all(got[i][0]["selected"] == (i % 6 != 0) for i in range(500) if i != 3)
    assert not any(got[i][0]["selected"] for i in (1000, 1001, 1002))
    assert sum(x["selected"] for v in select(d, spark.createDataFrame([], "doc_id long, quality int")).collect() for x in [v]) == 502
    assert sum(x["selected"] for x in select(d, spark.createDataFrame(lab, "doc_id long, quality int"), k=40).collect()) == 40


def test_quality_weights_equal_brute_force(spark):
    """Weights from counts of n-grams as texts, with the hash as the only shared part."""
    r = random.Random(31)
    rows = [(i, "".join(r.choice(["Ab", "ab ", "AB ", "7 ", "77x", "é ", "!! ", ". ", "\n", " "]) for _ in range(r.randint(0, 60)))) for i in range(120)] + [(200, None), (201, ""), (0, "repeated id here")]
    lab = [(i, int(i % 3 > 0)) for i in range(0, 120, 2)]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    part = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\s]+")
    h64 = lambda x: int(span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])

    def grams(text):
        tokens = part.findall(text or "")
        low = [h64(t.translate(brute.AZ).encode()) for t in tokens]
        is_word = [bool(re.match(r"[0-9A-Za-z\x80-\U0010ffff]", t)) for t in tokens]
        shape, before = [], None
        for t, h, w in zip(tokens, low, is_word, strict=True):
            if not w:
                shape.append(16 + h % (1 << 20))
                continue
            ups, smalls = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
            s = 5 if h == before else 2 if re.fullmatch("[0-9]+", t) else 1 if ups > 1 and not smalls else 3 if re.match("[A-Z]", t) else 4
            shape.append(s)
            before = h
        words_, shapes = [h for h, w in zip(low, is_word, strict=True) if w], [int(x) for x in mixed(np.array(shape, np.uint64))] if shape else []
        out = []
        for values, sizes, width, first in ((words_, (1, 2), WORD_BUCKETS, 0), (shapes, (1, 2, 3), SHAPE_BUCKETS, WORD_BUCKETS)):
            for n in sizes:
                out += [int(g) % width + first for g in windows(np.array(values, np.uint64), n)]
        return out

    good = {i for i, y in lab if y == 1 and not held(i)}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        g = grams(t)
        raw.update(g)
        if i in good:
            target.update(g)

    def log_p(counts, b):
        lo, hi = (0, WORD_BUCKETS) if b < WORD_BUCKETS else (WORD_BUCKETS, WORD_BUCKETS + SHAPE_BUCKETS)
        return np.log((counts[b] + 1) / (sum(v for k, v in counts.items() if lo <= k < hi) + hi - lo))

    ratio = {b: log_p(target, b) - log_p(raw, b) for b in raw}
    d = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, key double")
    got = sorted(select(d, spark.createDataFrame(lab, "doc_id long, quality int")).collect(), key=lambda x: (x["id"], x["n_grams"]))
    exp = sorted(((i, len(g), sum(ratio[b] for b in g) if g else None) for i, t in rows for g in [grams(t)]), key=lambda x: x[:2])
    assert [(x["id"], x["n_grams"]) for x in got] == [x[:2] for x in exp]
    assert all(a["log_weight"] is None if b[2] is None else abs(a["log_weight"] - b[2]) < 1e-6 for a, b in zip(got, exp, strict=True))
    # the k drawn are those of the largest keys
    for k in (1, 7, 50):
        drawn = select(d, spark.createDataFrame(lab, "doc_id long, quality int"), k=k).collect()
        keys = sorted((x["key"] for x in drawn if x["key"] is not None), reverse=True)
        assert sorted((x["key"] for x in drawn if x["selected"]), reverse=True) == keys[:k]


def test_repeated_ids_and_clashing_columns(spark):
    """An id with several texts, labels of both kinds, and input columns that bear result names, in any order of rows."""
    r = random.Random(41)
    rows = [(i % 90, prose(20, r) + (" idiot" if i % 4 == 0 else ""), "old", "old", "old") for i in range(180)] + [(None, "x idiot", "a", "b", "c"), (7, None, "a", "b", "c")]
    lab = [(i, int(i % 4 == 0)) for i in range(90)] + [(3, 1), (None, 1), (5, None)]
    labels = spark.createDataFrame(lab, "doc_id long, toxic int")
    found = []
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string, score string, evidence string, rate string").repartition(3)
        scored = score(d, fit(d, labels))
        found.append(sorted((str(x["doc_id"]), str(x["text"]), round(x["score"], 9)) for x in scored.collect()))
        domains = labels.where("toxic is not null").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("domain"))
        mixed_rows = mix(d, domains, {"good": 0.9, "bad": 0.1}).collect()
        assert len(mixed_rows) == len(rows) and all(isinstance(x["rate"], float) for x in mixed_rows)
        shards = assign_shards(d.withColumn("shard", F.lit("s")).withColumn("slot", F.lit("t")), 3).collect()
        assert len(shards) == len(rows) and {x["shard"] for x in shards} <= {0, 1, 2}
        cut = dedup_passages(d.withColumn("removed", F.lit(1)).withColumn("n_removed", F.lit("x"))).collect()
        assert len(cut) == len(rows) and all(isinstance(x["n_removed"], int) for x in cut)
    assert found[0] == found[1]


def test_url_filter_many_suffixes(spark):
    """More hosts than any cap: the statistics of all of them count."""
    labelled = [(f"http://h{i}.com/x", i % 2) for i in range(5000)]
    pages = spark.createDataFrame([(i, f"http://h{i}.com/x") for i in range(5000)], "page_id long, url string")
    found = filter_urls(pages, spark.createDataFrame(labelled * 8, "url string, block int"), [])
    wrong = found.where((F.col("verdict") == "block") != (F.col("page_id") % 2 == 1)).count()
    assert wrong <= 50


def test_kth_largest(spark):
    r = random.Random(14)
    values = [r.choice([r.gauss(0, 1), 1.5, -1e9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 500, 1500, 2999, 3000):
        assert kth_largest(df, k, bins=8, enough=50) == sorted(values, reverse=True)[k - 1]


def test_url_filter(spark):
    urls = [
        "http://A.Example.com/en/7x", "https://sub.example.com/en/8", "ftp://x.net/de/8?q=1", "http://example.net/de/8", "http://example.net/de/9#f", "http://a.org/es/1", "http://aorg/es/1",
        None, "no scheme", "http://", "://com/en/", "http://com", "http://host?x=/y://z", "HTTP://UPPER.ORG/ES/1", "http://ünï.net/de/", "http://notexample.com/en/7", "x" * 5000 + "://a.com/en/",
    ]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] + [(0, urls[0], "again")], "page_id long, url string, verdict string")
    labelled = spark.createDataFrame([(f"http://spam{i}.bad.biz/{i}?a=1&b=2", 1) for i in range(60)] + [(f"http://good{i}.fine.info/page/{i}", 0) for i in range(60)] + [(None, 1), ("http://x", None)], "url string, block int")
    got = filter_urls(pages, labelled, RULES).collect()
    assert len(got) == len(urls) + 1

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        tail = rest[cut:]
        return rest[:cut].translate(brute.AZ), tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]

    for r in got:
        host, path = split(urls[r["page_id"]])
        fits = [(v, x) for v, x in RULES if (host == x.split("/", 1)[0] or host.endswith("." + x.split("/", 1)[0])) and path.startswith("/" + x.split("/", 1)[1])]
        best = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1])
        assert r["verdict"] == (best[0] or ("block" if r["score"] >= 0.5 else "allow"))
    more = spark.createDataFrame([(1, "http://spam99.bad.biz/1?a=1&b=2"), (2, "http://good99.fine.info/page/3")], "page_id long, url string")
    assert [r["verdict"] for r in filter_urls(more, labelled, RULES).orderBy("page_id").collect()] == ["block", "allow"]
    assert {r["verdict"] for r in filter_urls(more, labelled.limit(0), RULES).collect()} == {"allow"}


def test_empty_tables(spark, sf):
    d = spark.createDataFrame([], SCHEMA)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    known = spark.createDataFrame([], "id long, domain string")
    assert near_duplicates(d).count() == 0
    assert keep_one(d).count() == 0
    assert decontaminate(d, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert fp.fingerprint_with_edit(d).count() == 0
    assert dedup_passages(d).count() == 0
    assert find_personal_data(d).count() == 0
    assert mix(d, known, {"a": 1.0}).count() == 0
    assert assign_shards(d).count() == 0
    assert select(d, lab).count() == 0
    assert score(d, fit(d, lab)).count() == 0
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string, block int"), RULES).count() == 0


def test_scratch_is_cleared(spark):
    import os

    from sedgeline.llm.scratch import clear, scratch_dir

    t = Scratch(spark, "x").put(spark.range(3))
    assert t.count() == 3 and os.path.isdir(f"{scratch_dir(spark)}/sedgeline")
    clear(spark)
    assert not os.path.isdir(f"{scratch_dir(spark)}/sedgeline")
