"""The registered queries and the pipeline, stage by stage, on the smallest tables."""

import collections
import zlib

import corpus_pipeline
import __spark_entry__ as entry

from . import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(path := f"{tmp_path}/{k}")
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(before[i] == t for i, t in after.items()) and docs.count() == len(after)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "quality":
            good = [i for i in before if i in labels and labels[i]["quality"] == 1]
            bad = [i for i in before if i in labels and labels[i]["quality"] == 0]
            assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.1 * len(bad)
        elif name == "near_dedup":
            assert set(after) == {i for i, v in brute.near(list(before.items()), 5, 80, 100).items() if v[2]}
        elif name == "decontamination":
            assert set(after) == {i for i, v in brute.contamination(list(before.items()), bench).items() if not v[4]}
        elif name == "mixing":
            clean = [i for i in before if i in labels and labels[i]["toxic"] == 0]
            assert sum(i in after for i in clean) >= 0.9 * len(clean)
        else:
            slots = collections.defaultdict(list)
            for r in docs.collect():
                assert r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
                slots[r["shard"]].append(r["slot"])
            assert len(after) == len(before) and all(sorted(s) == list(range(len(s))) for s in slots.values())


    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == docs.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")}
    assert set(entry.oracle_sql()) <= names
