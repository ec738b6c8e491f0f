"""Each registered query against its SQL, the libraries or brute force, on the smallest tables."""

from __future__ import annotations

import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.test_ops import ann_brute, secret_brute
from tests.test_queries import plain
from textloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(queries.ORACLES[name]).df())


def test_op1(spark, duck):
    data = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    got = {}
    for r in queries.op1_ann(spark, DATA).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r
    hit = 0
    for q, ranks in got.items():
        want = dict(ann_brute(data, q, len(data)))
        assert sorted(ranks) == list(range(1, min(20, len(want)) + 1)) and len({r["vec_id"] for r in ranks.values()}) == len(ranks)
        assert all(abs(r["score"] - want[r["vec_id"]]) < 1e-9 for r in ranks.values())
        hit += len({r["vec_id"] for r in ranks.values()} & set(list(want)[:20]))
    assert sorted(got) == sorted(i for i, _ in data if i % 20 == 0) and hit >= 0.9 * sum(map(len, got.values()))


def test_op2_and_op10(spark, duck):
    fold = lambda i, m: zlib.crc32(str(i).encode()) % m
    good = dict(duck.sql("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall())
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, DATA).collect()}
    assert all(r["held_out"] == (fold(i, 5) == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i in good if i in got and fold(i, 5) == 0]
    assert np.mean([got[i]["predicted"] == good[i] for i in held]) >= 0.8
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND regexp_matches(text, '\\p{L}')").fetchall())
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, DATA).collect()}
    assert all(r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert np.mean([got[i]["lang_pred"] == x for i, x in lang.items() if fold(i, 4) == 2]) >= 0.95


def test_op4(spark, docs):
    got = queries.op4_sharding(spark, DATA).toPandas()
    c = duckdb.connect()
    c.register("got", got)
    assert len(got) == len(docs) and all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in got[["doc_id", "size", "text_crc32"]].itertuples())
    load, slots = c.sql("SELECT list(b ORDER BY shard), bool_and(lo = 0 AND hi = n - 1 AND d = n) FROM (SELECT shard, sum(size) AS b, min(slot) AS lo, max(slot) AS hi, count(*) AS n, count(DISTINCT slot) AS d FROM got GROUP BY shard)").fetchall()[0]
    group: dict[str, int] = {}
    for t in docs.values():
        group[t] = group.get(t, 0) + len(t.encode()) + 1
    want = [0] * 8
    for n in sorted(group.values(), reverse=True):
        want[want.index(min(want))] += n
    assert slots and sorted(int(x) for x in load) == sorted(want)


def test_op5(spark, docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    got = queries.op5_token_counts(spark, DATA).collect()
    assert len(got) == len(docs) and all(r["n_tokens"] == len(m.encode(docs[r["doc_id"]])) and r["n_bytes"] == len(docs[r["doc_id"]].encode()) for r in got)


def test_op6(spark, docs):
    got = queries.op6_secrets(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(secret_brute(docs[r["doc_id"]]).encode()).hexdigest()


def test_op7(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    got = queries.op7_packing(spark, DATA).toPandas()
    total = 0
    for i, p in got.groupby("doc_id"):
        ids = np.array([*lib.encode(docs[i], add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        p = p.sort_values("piece")
        assert list(p.piece) == list(range(len(p))) and p.length.sum() == len(ids) and (p.length.iloc[1:] == 1024).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(p.start, p.length, p.ids_crc32, strict=True))
    for _, p in got.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert list(p.offset) == [0, *p.length.cumsum()[:-1]] and p.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-total // 1024) * 1.01 + 1
