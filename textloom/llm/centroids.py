"""Centroid clustering: Lloyd's rounds over integer vectors, exact at any number of rows.

A component x becomes floor(scale * x). Squared distances come from the expansion
|x|^2 - 2 x.c + |c|^2, whose product is one float64 BLAS call for a block of rows.
All terms are integers; where the largest component seen bounds every partial sum
below 2^53, floating point is exact whatever the order of additions. Where it
doesn't, a block is done in 64-bit integers, and beyond 2^63 in Python's own.

A round is one scan of the given table: each task sums the vectors of each cluster
and hands over one row a cluster, RDD ``treeAggregate`` adds those up in two levels,
and the driver gets as many sums as clusters. Nothing is shuffled by cluster, so a
cluster that holds a third of all rows costs what any other does; nothing is written.

Cases: rows whose vector is null, of another length than ``dim`` or holds a null or
non-finite component take no part; rows with a null id cannot be first centroids but
are clustered (their id stays null); repeated rows count each; of vectors whose ids
hash alike (repeated ids) the one with smaller components goes first; with fewer
usable rows than ``k`` there are as many centroids as rows with an id, none without
such rows, and then nothing is returned; ties go to the smaller number; a centroid
without vectors stays; distances and sums beyond a long are given as the largest
long, though compared exactly; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.shipping import ship

ROWS_A_BLOCK = 8192
EXACT = 1 << 53
LONG = (1 << 63) - 1
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(v: Column, dim: int) -> Column:
    """Exactly ``dim`` components, none null or non-finite."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(good, F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where all fit with room to spare, else Python integers."""
    if not x.size or np.abs(x).max() < 2.0**61 / scale:
        return np.floor(x * scale).astype(np.int64)
    big = lambda v: math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale
    return np.frompyfunc(lambda v: big(float(v)), 1, 1)(x)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` from each row of ``c``."""
    reach = x.shape[1] * (largest(x) + largest(c)) ** 2
    if reach < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    if reach > LONG:
        x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and its distance."""
    d = distances(x, c)
    own = np.array([row.index(min(row)) for row in d.tolist()], np.int64) if d.dtype == object else d.argmin(1)
    return own, d[np.arange(len(d)), own]


def sums(x: np.ndarray) -> list[int]:
    """Sum of each component."""
    if x.dtype != object and len(x) * largest(x) > LONG:
        x = x.astype(object)
    return [int(v) for v in x.sum(0)]


def blocks(batch, dim: int, scale: int):
    """(ids, integer vectors) of the usable rows of a batch (id, vector), some rows at a time."""
    import pyarrow.compute as pc

    whole_length = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False)
    batch = batch.filter(whole_length)
    for at in range(0, batch.num_rows, ROWS_A_BLOCK):
        part = batch.slice(at, ROWS_A_BLOCK)
        x = pc.cast(part.column(1).flatten(), "float64").to_numpy(zero_copy_only=False).reshape(-1, dim)
        fit = np.isfinite(x).all(1)  # a null has become NaN
        if fit.any():
            yield part.column(0).filter(fit), integers(x[fit], scale)


def _sums(share, dim: int, scale: int):
    """One row a cluster: how many vectors, the sum of their components and of their distances, as decimal numbers of any length."""

    def run(batches):
        import pyarrow as pa

        c = np.array(share.value, object) if dim else np.zeros((len(share.value), 0), np.int64)
        c = c.astype(np.int64) if largest(c) < 1 << 61 else c
        total: dict[int, list[int]] = {}
        for batch in batches:
            for _, x in blocks(batch, dim, scale):
                own, d = assign(x, c)
                for k in np.unique(own):
                    at = own == k
                    one = [int(at.sum()), sum(d[at].tolist()), *sums(x[at])]
                    total[int(k)] = [a + b for a, b in zip(total[int(k)], one, strict=True)] if int(k) in total else one
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([[str(v) for v in t] for t in total.values()], pa.list_(pa.string()))], names=["k", "total"])

    return run


def _merge(a: dict, b: dict) -> dict:
    for k, t in b.items():
        a[k] = [x + y for x, y in zip(a[k], t, strict=True)] if k in a else t
    return a


def totals(rows: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> dict[int, list[int]]:
    """By cluster: [vectors, sum of distances, sums of components ...]; as many entries as centroids at most."""
    share = rows.sparkSession.sparkContext.broadcast(centroids)
    parts = rows.mapInArrow(_sums(share, dim, scale), "k int, total array<string>")
    add = lambda have, row: _merge(have, {row["k"]: [int(v) for v in row["total"]]})
    return parts.rdd.treeAggregate({}, add, _merge, depth=2)


def first_centroids(vectors: DataFrame, k: int, dim: int, scale: int, id_col: str, vector_col: str) -> list[list[int]]:
    """The k vectors of smallest hash of ``1:<id>``, in order of hash: each task hands over k rows at most."""
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v")).filter(F.col("i").isNotNull() & whole(F.col("v"), dim))
    hashed = rows.select(F.sha2(F.concat(F.lit("1:"), F.col("i").cast("string")), 256).alias("h"), "v")
    return [[int(x) for x in integers(np.array(r["v"], np.float64), scale)] for r in hashed.orderBy("h", "v").limit(k).collect()]


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> list[list[int]]:
    """Centroids after ``rounds`` rounds, as integer components."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    centroids = first_centroids(vectors, k, dim, scale, id_col, vector_col)
    for _ in range(rounds if centroids else 0):
        for i, (n, _, *total) in totals(rows, centroids, dim, scale).items():
            centroids[i] = [t // n for t in total]
    return centroids


def _label(share, dim: int, scale: int):
    def run(batches):
        import pyarrow as pa

        centroids, inertia, names = share.value
        c = np.array(centroids, object) if dim else np.zeros((len(centroids), 0), np.int64)
        c = c.astype(np.int64) if largest(c) < 1 << 61 else c
        long = lambda v: pa.array([min(int(x), LONG) for x in v], pa.int64())
        each, total = long(inertia), min(sum(inertia), LONG)
        for batch in batches:
            for ids, x in blocks(batch, dim, scale):
                own, d = assign(x, c)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), long(d), each.take(at), pa.array(np.full(len(own), total), pa.int64()), pa.array(names).take(at)], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable vector: its id, cluster, distance, the distances summed over its cluster and over all, and its centroid's digest."""
    spark = vectors.sparkSession
    centroids = fit(vectors, k, rounds, dim, scale, id_col, vector_col)
    if not centroids:
        return spark.createDataFrame([], OUT)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    found = totals(rows, centroids, dim, scale)
    inertia = [found.get(i, [0, 0])[1] for i in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return rows.mapInArrow(_label(spark.sparkContext.broadcast((centroids, inertia, names)), dim, scale), OUT)


def oracle(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """The same rows by SQL."""
    good = f"embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}"
    out = [
        f"WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {good})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))",
    ]
    squared = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT r, vec_id, v, k, d FROM (SELECT r, vec_id, v, k, CAST({squared} AS BIGINT) AS d, row_number() OVER (PARTITION BY r ORDER BY {squared}, k) AS place FROM kept, c{n}) WHERE place = 1)")
        if n < rounds:
            mean = f"SELECT k, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS c FROM (SELECT k, i, (sum(v[i]) - (((sum(v[i]) % count(*)) + count(*)) % count(*))) // count(*) AS floor_sum FROM a{n}, generate_series(1, {dim}) AS g(i) GROUP BY k, i) GROUP BY k"
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{n} AS o LEFT JOIN ({mean}) AS m USING (k))")
    last = f"SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} USING (k)"
    return ",\n".join(out) + "\n" + last


ORACLE = oracle()
