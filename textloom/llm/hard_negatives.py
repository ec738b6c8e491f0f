"""Hard-negative mining by bit-sliced integer products.

A component x becomes floor(scale * x). A candidate's components are taken apart into
bit-planes of their two's complement; planes are multiplied with the anchors one after
the other, most significant first. After a plane, what the planes left could still add
to a score lies between (2^k - 1) times the sum of the anchor's negative components
and (2^k - 1) times that of its positive ones: the score's interval. A pair is dropped
once its interval shows that it cannot be asked for:

- positives: the upper end is below the least of the best lower ends found so far;
- negatives: the interval misses every range [low % of a positive's score, that
  score], or for each range it may still meet, enough rows surely in it are better.

While most pairs of a block stay, a plane is one BLAS product; once few do, it is a
product of the pairs that are left. After the last plane intervals are scores.

Anchors come in rounds of bounded size (``ROUND_BYTES``), each broadcast once for its
positives and once for its negatives; every round scans all candidates where they lie,
and a task hands over the best few rows of each anchor (and positive). So no label, and
no vector that many rows share, is a group of one task, and no pair of rows is ever
shuffled but those few. The work is anchors times rows, as the question demands.

Cases: rows with a null id, null label, null vector or a null or non-finite component
take no part; an id stands for one row: of several, the least by label, then vector; a
row is a candidate only of anchors of its own vector length; vectors without components
score 0; an anchor without another row of its label has no positives and no result, a
positive without rows in its range none either (a score below 0 has an empty range);
ties go to the smaller id; scores beyond a long are compared as they are (beyond 38
digits as the largest of 38) and given as the nearest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.centroids import LONG, integers, largest
from textloom.llm.common import discard, materialize
from textloom.shipping import ship

#: Anchors of a round: so many bytes of double-precision components.
ROUND_BYTES = 32 << 20
ANCHORS_A_TILE, ROWS_A_TILE = 512, 4096
#: Pairs are multiplied one by one once fewer than this share of a tile's are left.
SPARSE = 0.1
PAIRS_A_STEP = 1 << 16


def number_kind(a: np.ndarray, x: np.ndarray) -> type:
    """The number type in which all partial sums of products of ``a`` and ``x`` are exact."""
    reach = a.shape[1] * max(1, largest(a)) * 2 * max(1, largest(x))
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else object


class Planes:
    """Bit-planes of some rows, and the products of anchors with them."""

    def __init__(self, a: np.ndarray, x: np.ndarray) -> None:
        kind = number_kind(a, x)
        self.a = a.astype(kind)
        self.x = x
        bits = int(max(x.max(initial=0), -x.min(initial=0) - 1)).bit_length()
        self.weights = [-(1 << bits)] + [1 << k for k in range(bits - 1, -1, -1)]
        self.shifts = list(range(bits, -1, -1))
        self.up = np.where(self.a > 0, self.a, 0).sum(1)
        self.down = np.where(self.a < 0, self.a, 0).sum(1)
        self.kind = kind

    def plane(self, k: int, rows=slice(None)) -> np.ndarray:
        return ((self.x[rows] >> self.shifts[k]) & 1).astype(self.kind)

    def rest(self, k: int) -> int:
        """What the planes after the k-th can hold in each component."""
        return (1 << self.shifts[k]) - 1

    def dense(self, k: int) -> np.ndarray:
        return (self.a @ self.plane(k).T) * self.kind(self.weights[k]) if self.kind is not object else (self.a @ self.plane(k).T) * self.weights[k]

    def pairs(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), self.kind)
        for at in range(0, len(i), PAIRS_A_STEP):
            s = slice(at, at + PAIRS_A_STEP)
            out[s] = (self.a[i[s]] * self.plane(k, j[s])).sum(1) * self.weights[k]
        return out

    def bounds(self, k: int, score: np.ndarray, i: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of a dense block of scores, or of pairs whose anchors are ``i``."""
        down, up = (self.down[:, None], self.up[:, None]) if i is None else (self.down[i], self.up[i])
        return score + self.rest(k) * down, score + self.rest(k) * up


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the best ``most`` of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, _falling(score), group))
    g = group[order]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    return order[place < most]


def _falling(score: np.ndarray) -> np.ndarray:
    """A sort key that rises as scores fall."""
    if score.dtype != object:
        return -score
    distinct = sorted(set(score.tolist()), reverse=True)
    rank = {s: n for n, s in enumerate(distinct)}
    return np.array([rank[s] for s in score.tolist()], np.int64)


def nth_largest(group: np.ndarray, value: np.ndarray, n: int, groups: int, none) -> np.ndarray:
    """The n-th largest value of each group, ``none`` for smaller groups."""
    out = np.full(groups, none, value.dtype)
    order = np.lexsort((_falling(value), group))
    g = group[order]
    at = np.flatnonzero(np.arange(len(g)) - np.searchsorted(g, g) == n - 1)
    out[g[at]] = value[order[at]]
    return out


class Positives:
    """The best rows of the anchor's label; ``floor`` holds the least score that still counts, by anchor."""

    def __init__(self, anchors: dict, most: int) -> None:
        self.ids, self.labels, self.most = anchors["ids"], anchors["labels"], most
        n = len(self.ids)
        self.floor = np.full(n, -np.inf, object)
        self.found = (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64))

    def wanted(self, lo: int, hi: int, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return (self.labels[lo:hi, None] == labels[None, :]) & (self.ids[lo:hi, None] != ids[None, :])

    def open_dense(self, lo: int, hi: int, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        return high >= self.floor[lo:hi, None].astype(high.dtype)

    def open_pairs(self, lo: int, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        n = int(i.max()) + 1 if len(i) else 0
        floor = np.maximum(self.floor[lo : lo + n].astype(low.dtype), nth_largest(i, low, self.most, n, -np.inf))
        return high >= floor[i]

    def take(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        a, s, c = (np.concatenate(p) for p in zip(self.found, (anchor, score.astype(object), ids), strict=True))
        keep = best_of(a, plain(s), c, self.most)
        self.found = a[keep], s[keep], c[keep]
        self.floor = nth_largest(self.found[0], plain(self.found[1]), self.most, len(self.ids), -np.inf).astype(object)

    def table(self):
        import pyarrow as pa

        a, s, c = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a], pa.int64()), pa.array(c, pa.int64()), digits(s)], names=["anchor_id", "row_id", "score"])


def digits(score):
    """Scores as decimal numbers of 38 digits at most, for Spark."""
    import pyarrow as pa

    most = 10**38 - 1
    return pa.array([str(max(-most, min(most, int(v)))) for v in score], pa.string())


def plain(score: np.ndarray) -> np.ndarray:
    """Float64 where that holds all the integers exactly."""
    if score.dtype == object and all(abs(v) < 1 << 53 for v in score.tolist()):
        return score.astype(np.float64)
    return score


class Negatives:
    """Rows of another label within ``low`` % of a positive's score.

    ``scores``: (anchors, positives) of the positives' scores, best first; a missing one
    is -1, whose range is empty. Equal scores ask for the same rows: only the first asks.
    """

    def __init__(self, anchors: dict, most: int, low: int) -> None:
        self.ids, self.labels, self.most, self.low = anchors["ids"], anchors["labels"], most, low
        top = anchors["scores"]
        self.top = top
        self.asks = np.ones(top.shape, bool) & (top >= 0)
        self.asks[:, 1:] &= top[:, 1:] != top[:, :-1]
        bottom = -((-top * low) // 100)  # the least integer that is low % or more
        none = 1
        self.bottom = bottom
        self.least = np.where(self.asks, bottom, np.inf).min(1) if top.shape[1] else np.full(len(top), np.inf)
        self.most_of = np.where(self.asks, top, -none).max(1) if top.shape[1] else np.full(len(top), -none)
        self.floor = np.full(top.shape, -np.inf, object)
        self.found = (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64))

    def wanted(self, lo: int, hi: int, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return (self.labels[lo:hi, None] != labels[None, :]) & (self.most_of[lo:hi, None] >= 0)

    def open_dense(self, lo: int, hi: int, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        return (high >= self.least[lo:hi, None].astype(high.dtype)) & (low <= self.most_of[lo:hi, None].astype(low.dtype))

    def open_pairs(self, lo: int, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        n = int(i.max()) + 1 if len(i) else 0
        out = np.zeros(len(i), bool)
        for p in range(self.top.shape[1]):
            top, bottom, asks = self.top[lo : lo + n, p], self.bottom[lo : lo + n, p], self.asks[lo : lo + n, p]
            sure = asks[i] & (high <= top[i]) & (low >= bottom[i])
            floor = np.maximum(self.floor[lo : lo + n, p].astype(low.dtype), nth_largest(i[sure], low[sure], self.most, n, -np.inf))
            out |= asks[i] & (low <= top[i]) & (high >= bottom[i]) & (high >= floor[i])
        return out

    def take(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        width = self.top.shape[1]
        parts = [self.found]
        for p in range(width):
            meets = self.asks[anchor, p] & (score <= self.top[anchor, p]) & (score >= self.bottom[anchor, p])
            parts.append((anchor[meets] * width + p, score[meets].astype(object), ids[meets]))
        g, s, c = (np.concatenate(p) for p in zip(*parts, strict=True))
        keep = best_of(g, plain(s), c, self.most)
        self.found = g[keep], s[keep], c[keep]
        if width:
            self.floor = nth_largest(self.found[0], plain(self.found[1]), self.most, self.top.size, -np.inf).astype(object).reshape(self.top.shape)

    def table(self):
        import pyarrow as pa

        g, s, c = self.found
        a, p = np.divmod(g, max(1, self.top.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a], pa.int64()), digits(self.top[a, p]), pa.array(c, pa.int64()), digits(s)], names=["anchor_id", "positive_score", "row_id", "score"])


def sift(want, lo: int, hi: int, a: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> int:
    """Find what ``want`` asks of one tile (anchors lo to hi, some rows); the products done, in pairs and planes."""
    alive = want.wanted(lo, hi, ids, labels)
    if not alive.any():
        return 0
    planes = Planes(a, x)
    work, last = 0, len(planes.shifts) - 1
    i = j = score = None
    if alive.mean() < SPARSE:
        i, j = np.nonzero(alive)
        score = np.zeros(len(i), planes.kind)
    else:
        block = np.zeros(alive.shape, planes.kind)
    for k in range(last + 1):
        if i is None:
            block += planes.dense(k)
            work += block.size
            alive &= want.open_dense(lo, hi, *planes.bounds(k, block), alive)
            if k == last or alive.mean() < SPARSE:
                i, j = np.nonzero(alive)
                score = block[i, j]
        else:
            score = score + planes.pairs(k, i, j)
            work += len(i)
        if i is not None:
            keep = want.open_pairs(lo, i, *planes.bounds(k, score, i))
            i, j, score = i[keep], j[keep], score[keep]
            if not len(i):
                return work
    want.take(i + lo, score, ids[j])
    return work


def _scan(share, kind: str, most: int, low: int, scale: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        groups = {d: (g, Positives(g, most) if kind == "positives" else Negatives(g, most, low)) for d, g in share.value.items()}
        for batch in batches:
            length = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for d, (g, want) in groups.items():
                part = batch.filter(pa.array(length == d))
                for at in range(0, part.num_rows, ROWS_A_TILE):
                    rows = part.slice(at, ROWS_A_TILE)
                    x = integers(pc.cast(rows.column(2).flatten(), "float64").to_numpy(zero_copy_only=False).reshape(-1, d), scale) if d else np.zeros((rows.num_rows, 0), np.int64)
                    ids, labels = (rows.column(n).to_numpy(zero_copy_only=False) for n in (0, 1))
                    for lo in range(0, len(g["ids"]), ANCHORS_A_TILE):
                        a = g["x"][lo : lo + ANCHORS_A_TILE]
                        sift(want, lo, lo + len(a), a, x, ids, labels)
        for _, want in groups.values():
            yield want.table()

    return run


def _groups(anchors, scale: int) -> dict[int, dict]:
    """A round's anchors by vector length: ids, labels, integer components."""
    import pyarrow.compute as pc

    out = {}
    length = pc.list_value_length(anchors.column("v")).to_numpy(zero_copy_only=False)
    for d in np.unique(length):
        part = anchors.filter(length == d).combine_chunks()
        v = pc.cast(part.column("v").combine_chunks().flatten(), "float64").to_numpy(zero_copy_only=False).reshape(part.num_rows, int(d))
        out[int(d)] = {"ids": part.column("i").to_numpy(), "labels": part.column("l").to_numpy(), "x": integers(v, scale)}
    return out


def _first(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first ``most`` rows a key (Spark cuts to that many in each task before the shuffle); ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("score").cast("decimal(38,0)")), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def once(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """One row (i, l, v) an id, of the usable ones; an id with many rows is reduced in the tasks that read them."""
    v = F.col(vector_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), label.cast("long").alias("l"), v.alias("v"), good.alias("good"))
    rows = rows.filter(F.col("i").isNotNull() & F.col("l").isNotNull() & F.col("v").isNotNull() & F.coalesce("good", F.lit(False)))
    return rows.groupBy("i").agg(F.min(F.struct("l", "v")).alias("r")).select("i", "r.l", "r.v")


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """Per anchor, positive and rank: negative_id, positive_score, negative_score. ``anchors``: a condition on column ``i``, the id."""
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(once(vectors, id_col, vector_col, F.col("label") if label is None else label), "vectors")
    asked = rows.filter(anchors)
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    rounds = -(-size["n"] * 8 * max(1, size["d"] or 1) // ROUND_BYTES)
    out = []
    for r in range(rounds):
        mine = asked.filter(F.pmod(F.xxhash64("i"), F.lit(rounds)) == r).toArrow()  # a round's share, by hash
        groups = _groups(mine, scale)
        share = spark.sparkContext.broadcast(groups)
        near = rows.mapInArrow(_scan(share, "positives", positives, low, scale), "anchor_id long, row_id long, score string")
        near = materialize(_first(near, ["anchor_id"], positives), "positives")
        got = near.select("anchor_id", "rank", "score").toArrow()  # so many rows an anchor of the round
        place = {}
        for g in groups.values():
            g["scores"] = np.full((len(g["ids"]), positives), -1, object)
            place |= {int(i): (g, n) for n, i in enumerate(g["ids"])}
        for i, rank, score in zip(*(got.column(c).to_pylist() for c in ("anchor_id", "rank", "score")), strict=True):
            g, n = place[i]
            g["scores"][n, rank - 1] = int(score)
        for g in groups.values():
            if not any(abs(v) >= 1 << 46 for v in g["scores"].ravel()):
                g["scores"] = g["scores"].astype(np.int64)
        share.unpersist()
        share = spark.sparkContext.broadcast(groups)
        far = rows.mapInArrow(_scan(share, "negatives", negatives, low, scale), "anchor_id long, positive_score string, row_id long, score string")
        far = _first(far, ["anchor_id", "positive_score"], negatives).withColumnRenamed("score", "negative_score")
        long = lambda c: F.least(F.greatest(F.col(c).cast("decimal(38,0)"), F.lit(-LONG - 1)), F.lit(LONG)).cast("long").alias(c)
        near = near.select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
        done = near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), long("positive_score"), long("negative_score"))
        out.append(materialize(done, "negatives"))
        share.unpersist()
        discard(near)
    if not out:
        return spark.createDataFrame([], OUT)
    discard(rows)
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found


def shifted_label() -> Column:
    """The test tables' label, changed where the id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


ORACLE = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS row_id, a.label = c.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM kept AS a JOIN kept AS c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
near AS MATERIALIZED (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id) AS INTEGER) AS rank,
       row_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
