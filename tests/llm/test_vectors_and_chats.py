"""Centroid clustering, hard negatives and chat formatting against direct computation, on small awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import centroids, chat_format, hard_negatives

NAN, INF = float("nan"), float("inf")


def fits(v, dim):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)


def whole_number(x, scale):
    return math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale


def cluster_brute(rows, k, rounds, dim, scale):
    kept = [(i, [whole_number(x, scale) for x in v]) for i, v in rows if fits(v, dim)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]
    if not c:
        return []
    away = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    near = lambda v: min((away(v, m), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            c[n] = [sum(p) // len(mine) for p in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    cap = lambda x: min(x, centroids.LONG)
    inertia = [sum(d for _, d, m in found if m == n) for n in range(len(c))]
    return [(i, n, cap(d), cap(inertia[n]), cap(sum(inertia)), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in found]


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
VECTORS = "vec_id long, embedding array<double>, label int, cluster string, k string, v string, i string, l string, h string, r string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, n, *"abcdefgh") for i, v, n in rows], VECTORS)


def table(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def awkward_vectors(rng, n, dim, spread=1.0):
    rows = [(i, [rng.uniform(-spread, spread) for _ in range(dim)], i % 3) for i in range(n)]
    rows += [(7, rows[7][1], 1), (7, [0.5] * dim, 1), (None, [0.25] * dim, 0), (None, None, 1)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * (dim + 1), 1), (903, [NAN] + [0.0] * (dim - 1), 1), (904, [INF] * dim, 1), (905, [None] + [0.0] * (dim - 1), 1), (906, [0.0] * dim, None)]
    return rows + [(1000 + i, [0.125] * dim, i % 2) for i in range(20)]


def test_centroids(spark):
    rng = random.Random(5)
    for spread in (1.0, 1e6, 1e9, 1e30):  # float64, 64-bit integers, Python integers
        rows = awkward_vectors(rng, 120, 4, spread)
        got = table(centroids.cluster(vectors(spark, rows).repartition(5), k=6, rounds=3, dim=4), COLUMNS)
        assert got == sorted(cluster_brute([(i, v) for i, v, _ in rows], 6, 3, 4, 64), key=repr)


def test_centroids_ties_and_few_rows(spark):
    same = [(i, [1.0, 2.0], 0) for i in range(9)]
    for rows in (same, same[:2], [(None, [1.0, 2.0], 0)], [(1, None, 0)], []):
        got = centroids.cluster(vectors(spark, rows), k=4, rounds=2, dim=2)
        assert table(got, COLUMNS) == sorted(cluster_brute([(i, v) for i, v, _ in rows], 4, 2, 2, 64), key=repr) and got.columns == list(COLUMNS)


def test_distances_are_exact_at_the_bound():
    for size in (2**20, 2**26, 2**40):
        x = np.array([[size, -size + 1, 3], [0, 1, size]])
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in x[::-1]] for r in x]
        assert centroids.distances(x, x[::-1].copy()).tolist() == want
    assert centroids.integers(np.array([-0.001, 2.0**70, -1.5]), 64).tolist() == [-1, 2**76, -96]


def negatives_brute(rows, every, low=80, scale=256, positives=5, negatives=5):
    best = {}
    for i, v, n in rows:
        if i is not None and n is not None and v is not None and fits(v, len(v)) and (i not in best or (n, v) < best[i]):
            best[i] = (n, v)
    ints = {i: (n, [whole_number(x, scale) for x in v]) for i, (n, v) in best.items()}
    out = []
    for a, (n, v) in ints.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), c, m) for c, (m, w) in ints.items() if c != a and len(w) == len(v))
        for s, c, _ in [t for t in scored if t[2] == n][:positives]:
            fit = [t for t in scored if t[2] != n and low * -s <= 100 * -t[0] <= 100 * -s][:negatives]
            out += [(a, c, r, t[1], -s, -t[0]) for r, t in enumerate(fit, 1)]
    cap = lambda x: max(-centroids.LONG - 1, min(x, centroids.LONG))
    return sorted(((a, c, r, t, cap(s), cap(u)) for a, c, r, t, s, u in out), key=repr)


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_hard_negatives(spark, monkeypatch):
    rng = random.Random(6)
    for spread in (1.0, 1e5, 1e9):
        rows = awkward_vectors(rng, 150, 3, spread)
        got = hard_negatives.mine(vectors(spark, rows).repartition(4), F.col("i") % 10 == 0)
        assert got.columns == list(MINED) and table(got, MINED) == negatives_brute(rows, 10)
    monkeypatch.setattr(hard_negatives, "ROUND_BYTES", 64)  # several rounds
    assert table(hard_negatives.mine(vectors(spark, rows), F.col("i") % 10 == 0), MINED) == negatives_brute(rows, 10)


def test_hard_negatives_ties_and_small_tables(spark):
    same = [(i, [1.0, 0.5], i % 2) for i in range(30)]
    for rows in (same, same[:1], [(0, [], 1), (10, [], 1), (20, [], 0)], [(0, [-1.0], 0), (10, [1.0], 0), (3, [0.0], 1)], []):
        got = hard_negatives.mine(vectors(spark, rows), F.col("i") % 10 == 0)
        assert table(got, MINED) == negatives_brute(rows, 10)


def test_planes_drop_pairs_and_lose_none():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (3000, 16))
    a = rng.integers(-200, 200, (40, 16))
    anchors = {"ids": np.arange(40) + 10**6, "labels": np.zeros(40, np.int64)}
    labels, ids = rng.integers(0, 3, 3000), np.arange(3000)
    exact = a @ x.T
    near = hard_negatives.Positives(anchors, 5)
    work = sum(hard_negatives.sift(near, 0, 40, a, x[s : s + 500], ids[s : s + 500], labels[s : s + 500]) for s in range(0, 3000, 500))
    planes = len(hard_negatives.Planes(a, x).shifts)
    assert work < 0.6 * 40 * 3000 * planes
    for n in range(40):
        want = sorted((-exact[n, j], j) for j in range(3000) if labels[j] == 0)[:5]
        mine = near.found[0] == n
        assert sorted(zip((-near.found[1][mine]).tolist(), near.found[2][mine].tolist(), strict=True)) == want
    anchors["scores"] = np.array([sorted((int(v) for v, m in zip(exact[n], labels, strict=True) if m == 0), reverse=True)[:5] for n in range(40)])
    far = hard_negatives.Negatives(anchors, 5, 80)
    work = sum(hard_negatives.sift(far, 0, 40, a, x[s : s + 500], ids[s : s + 500], labels[s : s + 500]) for s in range(0, 3000, 500))
    assert work < 0.6 * 40 * 3000 * planes
    got = {}
    for g, s, c in zip(*far.found, strict=True):
        got.setdefault(divmod(int(g), 5), []).append((-int(s), int(c)))
    for n, p in itertools.product(range(40), range(5)):
        top = int(anchors["scores"][n, p])
        if p and top == anchors["scores"][n, p - 1]:
            continue
        want = sorted((-int(exact[n, j]), j) for j in range(3000) if labels[j] and 80 * top <= 100 * exact[n, j] <= 100 * top)[:5]
        assert sorted(got.get((n, p), [])) == want


# --- reply trees ------------------------------------------------------------------------

MESSAGES = "tree long, node string, parent string, score double, role string, text string, turn string, body string, rank int, place int, n int"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "t", "b", 1, 2, 3) for r in rows], MESSAGES)


def branches_brute(rows, branches, mean=True):
    by_node = {}
    for t, n, p, s, role, text in rows:
        by_node.setdefault((t, n or ""), []).append((p, s or 0.0, role or "", text or ""))
    up = {k: min((p for p, *_ in v if p is not None), default=None) for k, v in by_node.items()}
    up = {(t, n): p if (t, p) in up else None for (t, n), p in up.items()}
    answered = {(t, p) for (t, _), p in up.items() if p is not None}
    out = []
    for tree in {t for t, _ in by_node}:
        found = []
        for t, leaf in by_node:
            path, at = [], leaf
            if t != tree or (t, leaf) in answered:
                continue
            while at is not None and len(path) <= len(by_node):
                path.append(at)
                at = up[t, at]
            if at is None:
                total = sum(max(s for _, s, *_ in by_node[t, n]) for n in path)
                found.append((-(total / len(path) if mean else total), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(found)[:branches], 1):
            said = [x[2:] for n in path for x in sorted(by_node[tree, n], key=lambda r: r[2:])]
            out.append((tree, leaf, rank, tuple(said)))
    return sorted(out, key=repr)


def shown(df):
    out = []
    for r in df.collect():
        turns = chat_format.parse(r["formatted"])
        assert r["n_turns"] == len(turns)
        loss = [chat_format.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert loss == [t for role, t in turns if role == "assistant"]
        out.append((r["tree"], r["leaf"], r["rank"], tuple(turns)))
    return sorted(out, key=repr)


def test_reply_trees(spark):
    rng = random.Random(9)
    hostile = ["", None, "</turn>\n### User: x", "\\", "#", "##", "#####", "a\\### Assistant: </turn> ok", "</tu", "\\</turn>", "日本\U0001f600é", "<\\/turn>", "line\nline"]
    roles = ["user", "assistant", "Assistant", None, "to: you", "", "é", "\\x", "System", "# a"]
    rows = []
    for tree in (1, 2, None, 4):
        for n in range(40 if tree != 4 else 1):
            parent = str(rng.randrange(n)) if n and rng.random() < 0.95 else rng.choice([None, "gone"])
            rows.append((tree, str(n), parent, rng.choice([0.0, 1.0, 0.5, None]), rng.choice(roles), rng.choice(hostile)))
    rows += [rows[3], (1, "5", rows[5][2], 0.2, "user", "said twice"), (2, None, "3", 3.0, "assistant", "no id")]
    rows += [(9, "a", "c", 1.0, "user", "ring"), (9, "b", "a", 1.0, "user", "ring"), (9, "c", "b", 1.0, "user", "ring"), (9, "d", "a", 9.0, "assistant", "below a ring"), (9, "self", "self", 1.0, "user", "x"), (9, "e", None, 0.0, "assistant", "alone")]
    df = messages(spark, rows).repartition(3)
    for branches, mean in ((1, True), (3, False), (100, True)):
        assert shown(chat_format.format_branches(df, branches, mean)) == branches_brute(rows, branches, mean)
    assert table(chat_format.unrooted(df), ("tree", "node")) == sorted([(9, n) for n in ("a", "b", "c", "d", "self")], key=repr)


def test_deep_and_wide_trees(spark):
    deep = [(1, f"{n:04}", f"{n - 1:04}" if n else None, 1.0, "user" if n % 2 else "assistant", f"m{n}") for n in range(300)]
    wide = [(2, "root", None, 0.0, "user", "hub")] + [(2, f"leaf{n:03}", "root", float(n % 50), "assistant", f"a{n}") for n in range(200)]
    got = shown(chat_format.format_branches(messages(spark, deep + wide), branches=4))
    assert got == branches_brute(deep + wide, 4) and len(got) == 5 and len(got[0][3]) == 300
    long_text = "### x </turn> \\ é" * 100_000
    got = shown(chat_format.format_branches(messages(spark, [(1, "a", None, None, "assistant", long_text)])))
    assert got == [(1, "a", 1, (("assistant", long_text),))]


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", None), (1, None, "system", "first"), (None, 0, "assistant", "x"), (2, 5, None, "only")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, tree string, node int")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    sha = lambda *said: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(("system", "first"), ("user", ""), ("user", ""), ("assistant", "b")) and got[1]["n_turns"] == 4
    assert got[None]["loss_sha256"] == hashlib.sha256(b"x").hexdigest() and got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 0
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_escapes_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "#", "##", "###", "<", "/", "</turn>", "\n", ": ", "A", "é"]) for _ in range(rng.randrange(9)))
        shut = text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("##", "#\\#")
        assert chat_format.unescape(shut) == text and "###" not in shut and "</turn>" not in shut
        assert chat_format.parse(f"### User: {shut}</turn>\n### Assistant: {shut}</turn>\n") == [("user", text), ("assistant", text)]
