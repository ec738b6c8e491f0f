"""The pipeline's stages on a small folder, each against brute force on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import brute
from textloom.llm import decontaminate, jaccard_join
from textloom.llm.common import materialize


def folder(spark, path):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ren", "tos") for b in ("da", "fi", "gu", "pel", "sar", "van")]
    docs, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        bad = i % 6 == 0
        text = "shared notice\n" + " ".join(x + "###" * bad for x in w)
        if i % 10 == 7:
            text = docs[i - 1][1] + " tail"
        docs.append((i, text, "xx", "s", len(text)))
        labels.append((i, int("###" not in text), 0))
    docs += [(900, None, None, None, None), (901, "", "xx", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    item = docs[13][1].split("\n")[1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages(spark, tmp_path):
    d = f"file://{tmp_path}"
    folder(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, d), f"test{k}")
        if k < 4:
            assert out.columns == names
        kept[name] = docs, out
        docs = out
    before, after = kept["quality classifier"]
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert len(gone & set(range(0, 240, 6))) >= 36 and not gone & {i for i in range(240) if i % 6 and i % 10 != 7}
    before, after = kept["line dedup"]
    assert before.count() == after.count() and after.filter("text like '%shared notice%'").count() == 0
    assert after.filter("n_chars <> char_length(text)").count() == 0
    before, after = kept["n-gram Jaccard join"]
    want = {i for i, n, c in brute.jaccard([(r["doc_id"], r["text"]) for r in before.collect()]) if i == c or not n}
    assert {r["doc_id"] for r in after.collect()} == want
    before, after = kept["benchmark decontamination"]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = {r[0] for r in brute.contamination([(r["doc_id"], r["text"]) for r in before.collect()], bench) if not r[-1]}
    assert {r["doc_id"] for r in after.collect()} == want and 13 not in want
    before, after = kept["best-fit packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, after.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_awkward_rows(spark, tmp_path):
    """A very long text, repeated rows, null ids, columns of clashing names; and no documents at all."""
    d = f"file://{tmp_path}"
    folder(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumnsRenamed({"lang": "_score", "source": "hit"})
    long = " ".join(f"word{i}" for i in range(60_000))
    more = [(950, long, "xx", "s", None), (950, long, "xx", "s", None), (None, "a text of a few words under null", None, None, None), (None, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = materialize(stage(spark, kept, d), f"awkward{k}")
        if k < 4:
            assert kept.columns == docs.columns
    held = kept.filter("doc_id = 950").collect()
    assert sum(r["length"] for r in held) > 60_000 and len({r["piece"] for r in held}) == len(held)
    none = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        none = materialize(stage(spark, none, d), f"none{k}")
    assert none.count() == 0
