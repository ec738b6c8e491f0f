"""Operators against brute force and against the libraries, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from textloom.llm import ann, common, decontaminate, jaccard_join, language_id, line_dedup, packing, quality, secrets, sharding, token_counts
from textloom.llm.queries import tokenizer_path
from textloom.shipping import ship

SCHEMA = "doc_id long, text string, k1 string, shard int, n_lines string"


def table(spark, texts, ids=None):
    ship(spark)
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def awkward():
    rng = random.Random(3)
    vocab = ["the", "The", "wörd", "Über", "x1", "a-b", "end.", "(see)", "日本", "ok"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    near = [" ".join([*b.split()[:-1], "changed"]) for b in base[:10]]
    lines = ["  Shared Line \t\nunique %d\n\nSHARED line\nÉtat" % i for i in range(12)] + ["état\nshared line"]
    return [None, "", " ", "\n", "one", "one two three", "ONE two Three", *base, *base[:5], *near, *lines, "\x0bshared line\x0c", "long " * 5000, "z" * 3000]


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def line_brute(docs):
    upper = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(upper)
    where = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        x = (t or "").split("\n")
        kept = [y for y in x if not key(y) or len(where[key(y)]) < 10]
        out.append((i, len(x), len(x) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark):
    t = awkward()
    df = table(spark, t)
    got = rows(line_dedup.line_report(df), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(line_brute(list(enumerate(t))), key=repr)
    kept = line_dedup.dedup_lines(df)
    assert kept.columns == df.columns and kept.count() == len(t)
    assert rows(kept, "doc_id", "k1", "n_lines") == rows(df, "doc_id", "k1", "n_lines")


def test_line_dedup_hot_key(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SKETCH_ONE_IN", 1)
    t = ["hot line\nown %d" % i for i in range(300)] + ["cold\nown"] * 3
    got = rows(line_dedup.line_report(table(spark, t)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(line_brute(list(enumerate(t))), key=repr)


def test_line_dedup_repeated_rows(spark):
    # rows equal in id and text are one document
    df = table(spark, ["same line"] * 12 + ["other"], [1] * 12 + [None])
    got = line_dedup.line_report(df).collect()
    assert len(got) == 13 and all(r["n_dropped"] == 0 for r in got)


def test_sharding(spark):
    t = awkward()
    got = sharding.shard_documents(table(spark, t, [*range(len(t) - 2), None, None]), 8).collect()
    assert len(got) == len(t)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    by_text = {}
    for r in got:
        if r["doc_id"] is not None:
            x = t[r["doc_id"]] or ""
            assert r["size"] == len(x.encode()) + 1 and r["text_crc32"] == zlib.crc32(x.encode())
            by_text.setdefault(x, set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())


def test_lpt_is_greedy():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 500, 20))
        counts = rng.integers(1, 300, len(sizes))
        got = sharding.lpt(sizes, counts, 8)
        assert (got.sum(1) == counts).all()
        load = [0] * 8
        for s, n in sorted(zip(sizes.tolist(), counts.tolist(), strict=True), reverse=True):
            for _ in range(n):
                load[load.index(min(load))] += s
        assert sorted((got * sizes[:, None]).sum(0).tolist()) == sorted(load)


def test_sharding_is_balanced(spark):
    """Shards' true bytes: the greedy rule over whole groups, largest first."""
    rng = random.Random(5)
    t = ["x" * rng.choice([3, 50, 9000, 20_000, 70_001]) + str(i % 40) for i in range(150)] + ["y" * 300_000] + ["copy"] * 60
    got = sharding.shard_documents(table(spark, t), 4).collect()
    size, home = {}, {}
    for r in got:
        x = t[r["doc_id"]]
        size[x] = size.get(x, 0) + r["size"]
        assert home.setdefault(x, r["shard"]) == r["shard"]
    load = [0] * 4
    for n in sorted(size.values(), reverse=True):
        load[load.index(min(load))] += n
    assert sorted(load) == sorted(sum(n for x, n in size.items() if home[x] == s) for s in range(4))


def secret_brute(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    s = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))


def test_secrets(spark):
    rng = random.Random(8)
    code = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    t = [None, "", "token = abc", "secret=token: abcdefgh", 'é API_KEY: "abc.def-123"', "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 11, "AKIA", "0" * 24, "f" * 23, "password=" + "a" * 30 + " Token:'zzzzzz'", "日本 " + code("0123456789abcdef", 40) + " x passwd:" + code(mixed, 20)]
    random_token, plain = code(mixed, 32), "the_request_handler_for_session_manager and internationalisation"
    t += ["see " + random_token + " there", plain, "hot " * 200 + "api-key=aaaaaaa apikey:bbbbbbb"]
    out = {r["doc_id"]: r for r in secrets.scan_secrets(table(spark, t)).collect()}
    for i, x in enumerate(t):
        want = secret_brute(x or "")
        assert out[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, want, out[i])
    assert out[12]["spans"] == f"markov:4:{4 + len(random_token)}"
    assert out[13]["n_markov"] == 0


def test_secret_models_on_samples_not_seen(spark):
    """Precision and recall of the Markov spans: fitted on half of the labelled samples, asked about the other half."""
    some = secrets.labelled_samples(spark, 20000).withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2)))
    ratios = secrets.fit_markov(some.filter("half = 0").drop("half"))
    asked = some.filter("half = 1 AND char_length(value) >= 16").select("random", secrets.random_looking(F.col("value"), ratios).alias("said"))
    n = {(r["random"], r["said"]): r["count"] for r in asked.groupBy("random", "said").count().collect()}
    hit, missed, false = n.get((1, True), 0), n.get((1, False), 0), n.get((0, True), 0)
    assert hit / (hit + missed) > 0.97 and hit / (hit + false) > 0.97


def test_secrets_long_text_and_clashing_names(spark):
    t = ["password=abcdefgh " * 3000 + "é" + "0123456789abcdef" * 2, None, "token: abcdef"]
    df = table(spark, t).withColumnsRenamed({"shard": "t", "n_lines": "spans"}).withColumn("kind", F.lit("x"))
    out = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    for i, x in enumerate(t):
        assert out[i]["base_sha256"] == hashlib.sha256(secret_brute(x or "").encode()).hexdigest()
    assert out[0]["n_assign"] == 3000 and out[0]["n_hex"] == 1


def test_token_counts(spark):
    import sentencepiece

    rng = random.Random(4)
    path = tokenizer_path("piece_bpe_32k.model")
    t = [*awkward(), "<s> </s> <unk> <0x0A>", "\x00x", "▁▁ a▁b", "a" * 4000, "é ﬁ 👩‍👩‍👧 " * 20]
    t += ["".join(rng.choice("ab  \n\té日👩01.▁<>sTh eandin") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(table(spark, t), path).collect()
    want = {i: len(m.encode(x or "")) for i, x in enumerate(t)}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) and r["n_bytes"] == len((t[r["doc_id"]] or "").encode()) for r in got)


@pytest.mark.parametrize("bits", [22, 10])
def test_token_counts_without_boundaries(monkeypatch, bits):
    """Stretches in which no boundary resets the transducer, and tables that fill inside a slice."""
    import sentencepiece

    rng = random.Random(6)
    path = tokenizer_path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    t = token_counts.Transducer(path)
    t.bits = bits
    t.reset()
    if bits < 20:
        monkeypatch.setattr(token_counts, "MAX_STATES", 300)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)), "a" * 30_000, "", "the" * 3000, " " * 4000, "=" * 5000 + "ab" * 5000, "x y" * 2000]
    data = [x.encode() for x in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    assert t.counts(np.frombuffer(b"".join(data), np.uint8), off).tolist() == [len(m.encode(x)) for x in texts]
    assert len(t.keys) == 1 << bits


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    t = [*awkward(), "a <|endoftext|> b", "  <|endoftext|>\n\n x", "word " * 3000]
    got = packing.pack(table(spark, t), path, 64).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, x in enumerate(t):
        ids = np.array([*lib.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        p = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in p] == list(range(len(p))) and sum(r["length"] for r in p) == len(ids)
        assert all(r["length"] == 64 for r in p[1:]) and (len(p) == 1) == (len(ids) <= 64)
        for r in p:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for p in by_seq.values():
        at = 0
        for r in sorted(p, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 1024])
    counts = {}
    for _ in range(rng.choice([3, 200, 5000])):
        x = rng.randint(1, capacity)
        counts[x] = counts.get(x, 0) + 1
    steps = packing.plan(counts, capacity)
    used = {}
    for parts, k in steps:
        assert sum(parts) <= capacity and k > 0
        for x in parts:
            used[x] = used.get(x, 0) + k
    assert used == counts


def best_fit(counts, capacity):
    """Sequences that best fit alone makes, largest first."""
    gaps = []
    for size in sorted((x for x, k in counts.items() for _ in range(k)), reverse=True):
        fit = min((g for g in gaps if g >= size), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - size)
    return len(gaps)


def test_packing_plan_fills_by_the_index():
    # lengths that only pairs and triples fill
    assert sorted(packing.plan({6: 100, 3: 100, 1: 100}, 10)) == [((6, 3, 1), 100)]
    rng = random.Random(2)
    counts = {}
    for _ in range(3000):
        x = rng.randint(180, 420)
        counts[x] = counts.get(x, 0) + 1
    steps = packing.plan(counts, 1024)
    exact = sum(k for p, k in steps if sum(p) == 1024)
    made = sum(k for _, k in steps)
    assert made <= best_fit(counts, 1024) and exact > 0.5 * made


def test_packing_long_runs():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib, encode = Tokenizer.from_file(path), packing.encoder(path)
    for t in (" " * 1_100_000, "\n" * 300_000 + "a", "a" * 300_000, "x" + " \n" * 200_000 + "y", "\u3000" * 200_000):
        assert encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_decontaminate(spark):
    t = [*awkward(), "Before the ITEM words one two three four five six seven eight nine ten after", "short-ITEM here", "Kurz"]
    items = [(1, "item words one two three four five six seven eight nine"), (2, "item words one two three four five six seven eight nine"), (3, "short item"), (4, None), (5, "--"), (6, "kurz"), (7, "Über x1 ok"), (None, "one")]
    b = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(brute.contamination(list(enumerate(t)), items), key=repr)
    assert rows(decontaminate.contamination_report(table(spark, t), b), *cols) == want
    # the same in blocks of the benchmark
    assert rows(decontaminate.contamination_report(table(spark, t), b, block_bytes=150), *cols) == want
    assert rows(decontaminate.contamination_report(table(spark, t), b.limit(0)), "doc_id", "n_hit") == sorted(((i, 0) for i in range(len(t))), key=repr)
    df = table(spark, t)
    clean = decontaminate.decontaminate(df, b)
    assert clean.columns == df.columns and clean.count() == sum(not x[-1] for x in want)
    cut = decontaminate.decontaminate(df, b, remove="spans")
    assert cut.count() == len(t)
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[len(t) - 2] == " here"


def test_decontaminate_names_that_clash(spark):
    t = ["one two three four five six seven eight nine ten eleven", "nothing here"]
    df = table(spark, t).withColumnsRenamed({"k1": "_from", "n_lines": "hit", "shard": "src"})
    b = spark.createDataFrame([(1, t[0])], "item_id long, text string")
    for kw in ({}, {"block_bytes": 1}):
        kept = decontaminate.decontaminate(df, b, **kw)
        assert kept.columns == df.columns and rows(kept, *df.columns) == rows(df.filter("doc_id = 1"), *df.columns)
        cut = {r["doc_id"]: r for r in decontaminate.decontaminate(df, b, remove="spans", **kw).collect()}
        assert cut[0]["text"] == "" and cut[1]["text"] == t[1] and cut[0]["_from"] == "x"


def test_decontaminate_in_blocks(spark):
    """Many items, some equal, over several blocks; a passage of several items."""
    rng = random.Random(11)
    w = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(w) for _ in range(rng.randint(0, 25)))) for i in range(40)]
    items += [(100 + i, items[i][1]) for i in range(5)] + [(None, items[7][1])]
    t = [" ".join([rng.choice(w), *(items[rng.randrange(40)][1].split()), "tail", *(items[rng.randrange(40)][1].split())]) for _ in range(30)] * 2
    b = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(brute.contamination(list(enumerate(t)), items), key=repr)
    for size in (1 << 20, 400):
        assert rows(decontaminate.contamination_report(table(spark, t), b, block_bytes=size), *cols) == want


def test_decontaminate_null_item_id(spark, tmp_path):
    import duckdb

    t = ["alpha beta gamma here", "delta epsilon", "alpha beta gamma delta epsilon", "nothing", None]
    items = [(None, "alpha beta gamma"), (None, "delta epsilon"), (3, "delta epsilon"), (None, None)]
    df, b = table(spark, t), spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    c = duckdb.connect()
    for name, x in (("documents", df), ("benchmark", b)):
        x.write.parquet(f"{tmp_path}/{name}")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = sorted(c.sql(decontaminate.ORACLE).fetchall(), key=repr)
    assert [r[2] for r in want] == [3, 2, 5, 0, 0]
    assert rows(decontaminate.contamination_report(df, b), *cols) == want
    assert rows(decontaminate.contamination_report(df, b, block_bytes=80), *cols) == want
    assert sorted(brute.contamination(list(enumerate(t)), items), key=repr) == want
    assert rows(decontaminate.decontaminate(df, b), "doc_id") == [(3,), (4,)]


def test_jaccard_join(spark, monkeypatch):
    rng = random.Random(6)
    t = awkward()
    words = [f"w{i}" for i in range(400)]
    for _ in range(6):  # groups around the threshold, sharing passages
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(12):
            x = list(base)
            for _ in range(rng.randint(0, 5)):
                x[rng.randrange(len(x))] = rng.choice(words)
            t.append(" ".join(x))
        t.append(" ".join(base[:60] + [rng.choice(words) for _ in range(60)]))
    cols = ["doc_id", "n_shingles", "component_id"]
    want = sorted(brute.jaccard(list(enumerate(t))), key=repr)
    assert rows(jaccard_join.jaccard_components(table(spark, t)), *cols) == want
    # the same through block products
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    assert rows(jaccard_join.jaccard_components(table(spark, t)), *cols) == want
    df = table(spark, t)
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id") == sorted(((i,) for i, n, c in want if i == c or not n), key=repr)


def test_jaccard_join_ids(spark):
    text = "one two three four five six seven"
    got = rows(jaccard_join.jaccard_components(table(spark, [text, text, text, "", ""], [None, 4, 4, None, 9])), "doc_id", "component_id")
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None), (9, 9)], key=repr)


def test_jaccard_join_nul(spark):
    # NUL is part of a word, alone too; it is not the letter a or A, nor a space
    t = ["\x00\x00", "\x00", "\x00", "a", "A b\x00c", "a b c", "a bac", "\x00 one two three four five", " ", ""]
    df = table(spark, t)
    want = sorted(brute.jaccard(list(enumerate(t))), key=repr)
    assert rows(jaccard_join.jaccard_components(df), "doc_id", "n_shingles", "component_id") == want
    assert rows(jaccard_join.one_of_each(df), "doc_id") == [(0,), (1,), (3,), (4,), (5,), (6,), (7,), (8,), (9,)]


def test_one_of_each_awkward_ids(spark):
    text = "one two three four five six seven"
    other = "eight nine ten eleven twelve thirteen"
    # null ids, one id for two texts, and rows repeated as a whole
    df = table(spark, [text, text, text, other, other, "alone under null, six words here", "", None], [None, 4, 4, 4, 2, None, None, 9])
    got = sorted(map(tuple, jaccard_join.one_of_each(df).select("doc_id", "text").collect()), key=repr)
    assert got == sorted([(4, text), (2, other), (None, "alone under null, six words here"), (None, ""), (9, None)], key=repr)


def test_jaccard_repeated_rows_make_one_set(spark, monkeypatch):
    """Rows of two near-equal texts, many times under null ids: one pair is verified, not all."""
    seen = []
    verify = jaccard_join.Join.verify
    monkeypatch.setattr(jaccard_join.Join, "verify", lambda self, pairs, sets: seen.append((pairs.count(), sets.count())) or verify(self, pairs, sets))
    one = " ".join(f"w{i}" for i in range(60))
    df = table(spark, [one] * 60 + [one + " more"] * 60, [None] * 120)
    got = jaccard_join.jaccard_components(df).collect()
    assert len(got) == 120 and {r["component_id"] for r in got} == {None}
    assert all(pairs <= 1 and sets <= 2 for pairs, sets in seen)


def test_sparse_products():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, rng.choice([20, 200, 2000]), rng.integers(0, 80))) for _ in range(rng.integers(1, 120))]
        one, two = np.arange(len(sets) // 2), np.arange(len(sets) // 2, len(sets))
        want = np.array([[len(np.intersect1d(sets[i], sets[j])) for j in two] for i in one]).reshape(len(one), len(two))
        assert (jaccard_join.overlaps(sets, one, two) == want).all()
        a, b = rng.integers(0, len(sets), 30), rng.integers(0, len(sets), 30)
        a, b = a[a != b], b[a != b]
        assert (jaccard_join.pair_overlaps(sets, a, b) == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]).all()


def test_words_in_pieces():
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcAB  \n\0x", np.uint8)
    for _ in range(200):
        data = letters[rng.integers(0, len(letters), rng.integers(1, 300))]
        off = np.concatenate([[0], np.sort(rng.integers(0, len(data) + 1, 4)), [len(data)]]).astype(np.int64)
        whole, parts = common.words(data, off, jaccard_join.WORD_LUT), common.words(data, off, jaccard_join.WORD_LUT, piece=int(rng.integers(1, 20)))
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(whole, parts, strict=True))


def test_block_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(10, 60))) for _ in range(40)]
    side = np.array([0] * 15 + [1] * 25)
    got = jaccard_join.block_links(np.arange(40), side, sets, 50)
    near = {(a, b) for a in range(15) for b in range(15, 40) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))}
    assert set(got) <= near

    def classes(edges):
        p = list(range(40))
        for _ in range(40):
            for a, b in edges:
                p[a] = p[b] = min(p[a], p[b])
        return p

    assert classes(got) == classes(near)


def test_ann(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:110] = x[100]
    data = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(1000, None, "c"), (1020, [0.0] * 16, "c"), (1040, [float("nan")] * 16, "c"), (1060, [1.0] * 15 + [None], "c"), (1080, [1.0, 2.0], "c"), (None, [1.0] * 16, "c"), (1100, [float("inf")] * 16, "c"), (1120, [], "c")]
    ship(spark)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, list string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, lists=8).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert sorted(got) == list(range(0, 900, 20))
    hit = 0
    y = x.astype(np.float64)
    for q, rs in got.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and q not in [r["vec_id"] for r in rs]
        assert all(abs(r["score"] - y[q] @ y[r["vec_id"]]) < 1e-9 for r in rs)
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        s = y @ y[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(900), -s))[:20].tolist()) & {r["vec_id"] for r in rs})
    assert hit >= 0.9 * 20 * len(got)
    few = ann.nearest(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]


def ann_brute(data, q, k):
    """(id, score) of the k best ids, each by its best row under any vector of query id ``q``."""
    mine = np.array([v for i, v in data if i == q], np.float64)
    best = {}
    for i, v in data:
        if i != q:
            best[i] = max(best.get(i, -np.inf), float((mine @ np.array(v, np.float64)).max()))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_ann_repeated_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES_A_BLOCK", 8)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).tolist()
    # query rows stored twice and 20 times, a query id of three vectors (one of them twice), a candidate stored three times
    data = [*enumerate(x), (20, x[20]), *[(40, x[40])] * 19, (60, x[1]), (60, x[2]), (60, x[2]), *[(7, x[7])] * 2]
    ship(spark)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % 20 == 0, lists=4, target=1.0, short=400).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r)
    for q in range(0, 300, 20):
        want = ann_brute(data, q, 20)
        assert [r["rank"] for r in got[q]] == list(range(1, 21))
        assert [r["vec_id"] for r in got[q]] == [i for i, _ in want]
        assert np.allclose([r["score"] for r in got[q]], [s for _, s in want])


def test_ann_short_lists(spark, monkeypatch):
    fitted = ann.Index.__init__

    def one_list(self, *a, **kw):
        fitted(self, *a, **kw)
        self.probe = 1

    monkeypatch.setattr(ann.Index, "__init__", one_list)
    x = np.random.default_rng(3).normal(size=(600, 8)).tolist()
    # the lists hold 8 rows or so; 30 rows of one id fill one list with rows that aren't candidates
    data = [*enumerate(x), *[(40, x[40])] * 29, (60, x[40])]
    ship(spark)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["rank"])
    assert {q: sorted(ranks) for q, ranks in got.items()} == {q: list(range(1, 21)) for q in range(0, 600, 20)}


@pytest.mark.parametrize("kind", ["plain", "clustered", "repeated"])
def test_ann_recall(spark, kind):
    rng = np.random.default_rng(8)
    if kind == "plain":
        x, ids = rng.normal(size=(2000, 24)), np.arange(2000)
    elif kind == "clustered":
        x, ids = rng.normal(size=(40, 24))[rng.integers(0, 40, 2000)] + rng.normal(0, 0.2, (2000, 24)), np.arange(2000)
    else:
        x, ids = np.tile(rng.normal(size=(100, 24)), (2, 1)), np.tile(np.arange(100), 2)
    ship(spark)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = 0
    for q, mine in got.items():
        assert len(mine) == len(set(mine)) == 20 and q not in mine
        hit += len({i for i, _ in ann_brute(list(zip(ids.tolist(), x, strict=True)), q, 20)} & set(mine))
    assert hit >= 0.95 * 20 * len(got)


@pytest.mark.parametrize("kind", ["some long", "scales", "queries apart", "tiny"])
def test_ann_odd_lengths(spark, kind, monkeypatch):
    """Few long vectors, clusters of unlike width, queries unlike the rows, squares below single precision."""
    monkeypatch.setattr(ann, "SAMPLE", 400)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32))
    if kind == "some long":
        x[rng.integers(4000, size=100)] *= 50
    elif kind == "scales":
        of = rng.integers(4, size=4000)
        x = rng.normal(size=(4, 32))[of] + x * np.array([1, 1e-2, 1e-4, 1e-6])[of, None]
    elif kind == "queries apart":
        x[::20] = 3 * np.abs(x[::20])
    else:
        x *= 1e-24
    ship(spark)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x[::20] @ x.T
    score[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    near = np.argsort(-score, 1, kind="stable")[:, :20]
    hit = sum(len(got[20 * i] & set(ids.tolist())) for i, ids in enumerate(near))
    assert hit >= 0.97 * 20 * 200, hit / 4000


def test_join_sample_memory():
    """A task counts shingles some at a time: its memory has a bound, however many rows it has."""
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(map(str, range(1000 * i, 1000 * i + 1000))) for i in range(3000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]
    del texts
    tracemalloc.start()
    try:
        got = list(jaccard_join._frequent(5)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in got) == 0
    assert peak < 115e6, peak


def test_packing_library_only_where_needed(monkeypatch):
    import tokenizers

    def never(path):
        raise AssertionError("loaded")

    monkeypatch.setattr(packing, "_KEPT", {})
    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_file": staticmethod(never)}))
    encode = packing.encoder(tokenizer_path("byte_bpe_50k.json"))
    assert len(encode("a few words")) > 0
    with pytest.raises(AssertionError, match="loaded"):
        encode(" " * (packing.LONG_RUN + 1))


def test_quality_long_text_and_clashing_names(spark):
    """A long text is scored in blocks of chunks as it would be whole; columns of any name pass through."""
    net = quality.Network(seed=1)
    rng = np.random.default_rng(2)
    net.filters = rng.normal(size=net.filters.shape).astype(np.float32)
    net.out[:] = rng.normal(size=net.out.shape)
    net.ready()
    texts = [rng.integers(32, 120, n).astype(np.uint8) for n in (0, 1, 257, quality.CHUNK * quality.BLOCK * 2 + 77, 513)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    whole = net.features(*quality.pad(np.concatenate(texts), off))[3]
    want = 1 / (1 + np.exp(-((whole - net.shift) @ net.out + net.bias[0])))
    assert np.allclose(net.score(np.concatenate(texts), off), want, atol=1e-4)
    df = table(spark, ["good words here", "bad ### words", None]).withColumnsRenamed({"k1": "_score", "n_lines": "_scored"})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and rows(kept, *df.columns) == rows(df, *df.columns)


def test_quality_learns_from_long_texts(spark):
    """Labelled texts longer than a segment take part, by their segments."""
    t = [("fine prose " if i % 2 else "### junk ") * 4000 for i in range(12)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(table(spark, t), labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_quality(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    t, y = [], []
    for i in range(400):
        good = i % 3 > 0
        t.append(" ".join(word() + ("" if good else "###") for _ in range(rng.randint(5, 120))))
        y.append(int(good))
    t += [None, "", "x"]
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)] + [(5, None, 0), (None, 1, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    df = table(spark, t)
    got = {r["doc_id"]: r for r in quality.quality_scores(df, labels).collect()}
    assert len(got) == len(t) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(len(t)) if got[i]["held_out"]][: len(held)] == held
    assert np.mean([got[i]["predicted"] == y[i] for i in held]) > 0.9
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    none = quality.quality_scores(df, labels.limit(0)).collect()
    assert all(r["score"] == pytest.approx(0.5) for r in none)


def test_quality_covers_every_window():
    net = quality.Network()
    net.filters = np.random.default_rng(0).normal(size=net.filters.shape).astype(np.float32)
    net.out[:] = 1
    text = [bytes(np.random.default_rng(k).integers(0, 256, n, dtype=np.uint8)) for k, n in enumerate([0, 1, 5, 6, 255, 256, 257, 2000])]
    data = np.frombuffer(b"".join(text), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in text])])
    slow = net.features(*quality.pad(data, off))[3]
    for k, x in enumerate(text):
        p = np.frombuffer(x + b"\0" * (quality.WIDTH - 1 + (not x)), np.uint8)
        value = np.array([sum(net.filters[j, p[i + j]] for j in range(quality.WIDTH)) for i in range(max(1, len(x)))])
        parts = np.array([value[i : i + quality.CHUNK].max(0) for i in range(0, len(value), quality.CHUNK)])
        assert np.allclose(slow[k], np.concatenate([parts.mean(0), parts.max(0)]), atol=1e-4)
    net.ready()
    assert np.allclose(net.features(*quality.pad(data, off))[3], slow, atol=1e-4)


def test_language_id(spark):
    rng = random.Random(10)
    syllables = {"aa": ["ba", "do", "ki"], "bb": ["sch", "ung", "ver"], "cc": ["ño", "ción", "el"]}
    t, lang = [], []
    for i in range(300):
        x = ["aa", "bb", "cc"][i % 3]
        t.append(" ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(rng.randint(2, 30))))
        lang.append(x if i % 7 else None)
    t += [None, "", "123 !?", "x"]
    lang += ["aa", None, "bb", None]
    ship(spark)
    df = spark.createDataFrame([(i, a, b, "z") for i, (a, b) in enumerate(zip(t, lang, strict=True))], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language_id.identify(df, language_id.train(df)).collect()}
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3
    assert all(got[i]["lang_pred"] == ["aa", "bb", "cc"][i % 3] for i in range(300))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.identify(df, language_id.train(df.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_language_id_long_texts(spark, monkeypatch):
    """A language all of whose texts are long is learned; pieces of a text give what the whole gives."""
    t = ["der hund und die katze laufen über die straße " * 2000, "the cat and the dog are running over the street " * 2000] * 3
    ship(spark)
    df = spark.createDataFrame([(i, x, ["de", "en"][i % 2]) for i, x in enumerate(t)], "doc_id long, text string, lang string")
    models = language_id.train(df)
    assert all(r["lang_pred"] == ["de", "en"][r["doc_id"] % 2] for r in language_id.identify(df, models).collect())
    data = [x.encode() for x in (t[0][:3000], "é" * 500, "a  b " * 300, "x", "1 2", "")]
    off = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    whole = models.entropy(np.frombuffer(b"".join(data), np.uint8), off)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(language_id, "PIECE", piece)
        parts = models.entropy(np.frombuffer(b"".join(data), np.uint8), off)
        assert all(np.allclose(x, y) for x, y in zip(whole, parts, strict=True))


def test_language_id_bound(spark):
    ship(spark)
    df = spark.range(language_id.LANGUAGES * 3).selectExpr("id AS doc_id", "'text' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError):
        language_id.train(df)


def test_kneser_ney_sums_to_one():
    m = language_id.Models(["a", "b"])
    texts = [("a", b"the cat sat on the mat that the rat sat at"), ("b", b"der hund und die katze und der hund")]
    m.fit(texts)
    letters = sorted(set("".join(t.decode() for _, t in texts)))
    for start in ("t", "th", "the", "de", "und"):
        for k in range(2):
            total = 0.0
            for c in letters:
                data = np.frombuffer((start + c).encode(), np.uint8)
                whole = m.entropy(data, np.array([0, len(data)]))
                # probability of the last letter: difference of totals (the space at the end is taken off)
                total += np.exp(-last_letter(m, start + c, k))
                assert whole[2][0] >= 1
            # unseen letters have the rest
            assert 0.5 < total < 1.0 + 1e-4


def last_letter(m, s, k):
    """Cost of the last letter of ``s`` under model ``k``, by the recursion itself."""
    cps = np.array([ord(c) for c in " " + s], np.uint32)
    cost = 0.0
    for n in range(min(m.order, len(cps)), 0, -1):
        at = m.grams[n - 1].find(language_id.hashes(cps, n)[-1:])[0]
        if at >= 0:
            return cost - float(m.logp[n - 1][at, k])
        if n == 1:
            return cost - float(m.floor[k])
        c = m.context[n - 1].find(language_id.hashes(cps[:-1], n - 1)[-1:])[0]
        if c >= 0:
            cost -= float(m.weight[n - 1][c, k])
    return cost


@pytest.mark.parametrize("name", ["lines", "shards", "tokens", "secrets", "pack", "bench", "join", "lang", "quality", "ann"])
def test_empty_tables(spark, name):
    ship(spark)
    df = table(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    got = {
        "lines": lambda: line_dedup.line_report(df),
        "shards": lambda: sharding.shard_documents(df),
        "tokens": lambda: token_counts.token_counts(df, tokenizer_path("piece_bpe_32k.model")),
        "secrets": lambda: secrets.scan_secrets(df),
        "pack": lambda: packing.pack(df, tokenizer_path("byte_bpe_50k.json")),
        "bench": lambda: decontaminate.contamination_report(df, bench),
        "join": lambda: jaccard_join.jaccard_components(df),
        "lang": lambda: language_id.identify(df, language_id.train(df.withColumn("lang", F.lit("x")))),
        "quality": lambda: quality.quality_scores(df, labels),
        "ann": lambda: ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0),
    }[name]()
    assert got.count() == 0 and got.columns
