"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Of two numbers of lists, the square root of the number of vectors (16 at least,
``LISTS`` at most) and a quarter of it, that one is taken by which a query costs
less, as the sample shows: rows to look at, and ``PROBE`` rows for each list it is
sent to. Where vectors cluster, the work of a query so grows with the square root;
where they don't, most lists hold neighbours, and more lists would only be more
copies of the query. Coarse centroids and the codebooks of the residuals are
fitted on a bounded sample (16 vectors a list, ``SAMPLE`` at least, the least by a
hash of their id; a longer sample than 268 MB of double-precision numbers is cut to
that). Every vector is then indexed: its list, a byte for each slice of its residual,
and how far the coded vector is from it. A query goes to the lists whose centroids
have the largest inner product with it. How many lists is the fewest that reach
``target`` recall on the sample, and also for ``TRIED`` of the queries (the least by
a hash) whose neighbours among all rows are found by comparison with each of them:
a sample doesn't show a few long vectors, nor queries that lie apart from the rows.
A query whose lists hold fewer than ``k`` other ids goes to more.
In a list nothing is missed: a query's asymmetric distance tables and the distance
of the codes bound each product from both sides, and all rows that may be among the
``k`` best are ranked by inner products of the original vectors in double precision;
where the bounds leave more than ``short`` rows a query, a matrix product of the
block narrows them first.

Lists are dealt out in blocks of vectors and blocks of queries, so a list that
holds a third of all rows is many tasks; a task returns ``k`` rows a query.

Cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with a null id; vectors of different lengths have no inner
product, so those of another length than most take no part either; rows that share
a query's id are not its neighbours; an id is a neighbour once, by its best score,
however many rows it has, and rows of one query id are one query; ties go to the
smaller id; fewer candidates than ``k`` are all returned; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize

SAMPLE = 8192
LISTS = 16384
SAMPLE_BYTES = 1 << 28
#: Pairs of vectors multiplied at once.
PAIRS = 1 << 15
#: What sending a query to one more list costs, in rows compared.
PROBE = 400
#: Queries compared with every row, to see how many lists hold their neighbours.
TRIED = 256
SLICE = 4
CODES = 256
ROWS_A_BLOCK = 4096
QUERIES_A_BLOCK = 1024


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row; some 4 million distances at a time."""
    step = max(1, (1 << 22) // len(c))
    half = (c * c).sum(1)[None, :] / 2
    return np.concatenate([(half - x[i : i + step] @ c.T).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        order = np.argsort(a, kind="stable")
        total = np.zeros_like(c)
        total[n > 0] = np.add.reduceat(x[order], (np.cumsum(n) - n)[n > 0], axis=0)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None].astype(x.dtype), c)
    return c


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best ids of each row, best first, ties to the smaller id; an id counts by its best score."""
    order = np.lexsort((-score, ids, row))
    r, i = row[order], ids[order]
    order = order[np.append(True, (r[1:] != r[:-1]) | (i[1:] != i[:-1]))[: len(r)]]
    order = order[np.lexsort((ids[order], -score[order], row[order]))]
    r = row[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < k]


def _kth(score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row (a column), where columns from one of ``first`` to the next are one id."""
    each = np.maximum.reduceat(score, first, axis=1) if len(first) < score.shape[1] else score
    return np.partition(each, len(first) - k, 1)[:, len(first) - k, None] if len(first) > k else np.full((len(score), 1), -np.inf)


def _starts(ids: np.ndarray) -> np.ndarray:
    """Where each id of sorted ids begins."""
    return np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])


class Index:
    """Centroids, codebooks and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, lists: list[int], target: float, k: int, rows: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        # lengths of any order: squares stay within single precision
        unit = float(np.abs(sample).max(initial=0)) or 1.0
        sample = np.unique((sample / unit).astype(np.float32), axis=0)  # a copy of a vector says nothing new, and would be its own nearest neighbour
        best = np.inf
        for n in lists:
            centroids = kmeans(sample, max(1, min(n, len(sample) // 8 or 1)), 10, rng)
            own = _nearest(sample, centroids)
            # fewest lists that hold the share ``target`` of true neighbours in the sample, both of vectors
            # at random and of vectors from all lists alike, so that a crowded list doesn't speak for the others
            mix = rng.permutation(len(sample))
            by_list = mix[np.argsort(own[mix], kind="stable")]
            turn = np.arange(len(mix)) - np.searchsorted(own[by_list], own[by_list])
            probe = max(self.lists_for(sample, centroids, own, q, target, k) for q in (mix[:256], by_list[np.argsort(turn, kind="stable")[:512]]))
            cost = rows * probe / len(centroids) + PROBE * probe
            if cost < best:
                best, self.centroids, self.probe, nearest_list = cost, centroids, probe, own
        rest = sample - self.centroids[nearest_list]
        self.cuts = list(range(0, dim, SLICE)) + [dim]
        self.books = [kmeans(rest[:, a:b], CODES, 8, rng) * np.float64(unit) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.centroids = self.centroids * np.float64(unit)

    def lists_for(self, sample: np.ndarray, centroids: np.ndarray, own: np.ndarray, q: np.ndarray, target: float, k: int) -> int:
        score = sample[q] @ sample.T
        score[np.arange(len(q)), q] = -np.inf
        near = np.argpartition(-score, min(k, len(sample) - 1) - 1, 1)[:, : min(k, len(sample) - 1)] if len(sample) > 1 else np.zeros((len(q), 0), int)
        if not near.shape[1]:
            return len(centroids)
        place = np.argsort(np.argsort(-(sample[q] @ centroids.T), 1), 1)
        at = np.sort(np.take_along_axis(place, own[near], 1).ravel())
        return int(at[int(np.ceil(target * len(at))) - 1]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's list, codes, and distance from what list and codes stand for."""
        own = _nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = [_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]
        for a, b, book, code in zip(self.cuts, self.cuts[1:], self.books, codes, strict=False):
            rest[:, a:b] -= book[code]
        return own, np.stack(codes, 1).astype(np.uint8), np.sqrt((rest * rest).sum(1))

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists in the order in which each query goes to them."""
        return np.argsort(-(q @ self.centroids.T), 1, kind="stable")

    def probes(self, q: np.ndarray, sizes: np.ndarray, need: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, list): the nearest lists, ``probe`` of them or as many as hold ``need`` ids together."""
        order = self.order(q)
        short = np.cumsum(sizes[order], 1) < need
        n = np.minimum(np.maximum(probe, short.sum(1) + 1), order.shape[1])
        row, at = np.nonzero(np.arange(order.shape[1])[None, :] < n[:, None])
        return row, order[row, at]

    def search(self, own: int, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, codes: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int, short: int):
        """(query row, id, score): each query's k best ids in one block of list ``own``; candidates come in order of id."""
        first = _starts(ids)
        itself = q_ids[:, None] == ids[None, :]
        about = np.repeat((q @ self.centroids[own])[:, None], len(x), 1)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            about += (q[:, a:b] @ self.books[m].T)[:, codes[:, m]]
        about[itself] = -np.inf
        # a product is no farther from the tables' than the lengths of query and code error allow (and rounding)
        length, most = np.sqrt((q * q).sum(1))[:, None], np.sqrt((x * x).sum(1))
        round_off = 1e-12 * length * (most.max(initial=0) + np.abs(self.centroids[own]).sum())
        slack = length * far + round_off
        keep = ~(about + slack < _kth(about - slack, first, k))
        if keep.sum() > short * len(q):
            about = q @ x.T
            about[itself] = -np.inf
            keep &= ~(about < _kth(about, first, k) - 2 * round_off)
        row, at = np.nonzero(keep & ~itself)
        score = np.concatenate([np.zeros(0), *((x[at[i : i + PAIRS]] * q[row[i : i + PAIRS]]).sum(1) for i in range(0, len(row), PAIRS))])
        top = _best(row, ids[at], score, k)
        return row[top], ids[at][top], score[top]


def _matrix(arr, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column."""
    import pyarrow as pa

    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    return arr.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _encode(share, dim: int):
    def run(batches):
        import pyarrow as pa

        index = share.value
        for batch in batches:
            own, codes, far = index.encode(_matrix(batch.column(1), dim))
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.int32()), code, pa.array(far)], names=["vec_id", "v", "row", "list", "code", "far"])

    return run


def _compare(ids: np.ndarray, q: np.ndarray, k: int):
    """Per task: the k best ids of each of a few queries, by comparison with every row."""

    def run(batches):
        import pyarrow as pa

        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            own, lists = batch.column(0).to_numpy()[order], batch.column(2).to_numpy()[order]
            x = _matrix(batch.column(1), q.shape[1])[order]
            for i in range(0, len(own), ROWS_A_BLOCK):
                c = own[i : i + ROWS_A_BLOCK]
                score = q @ x[i : i + ROWS_A_BLOCK].T
                itself = ids[:, None] == c[None, :]
                score[itself] = -np.inf
                row, at = np.nonzero(~itself & ~(score < _kth(score, _starts(c), k)))
                best = [np.concatenate(p) for p in zip(best, (row, c[at], score[row, at], lists[i + at]), strict=True)]
                top = _best(*best[:3], k)
                best = [p[top] for p in best]
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in best], names=["q", "vec_id", "score", "list"])

    return run


def _probe(share, dim: int, sizes: np.ndarray, k: int, probe: int):
    def run(batches):
        import pyarrow as pa

        index = share.value
        for batch in batches:
            # the query's own id may lie in its lists and is no candidate
            row, lists = index.probes(_matrix(batch.column(1), dim), sizes, k + 1, probe)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lists, pa.int32())], names=["vec_id", "v", "list"])

    return run


def _search(share, dim: int, k: int, short: int):
    def run(queries, rows):
        import pyarrow as pa

        got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if queries.num_rows and rows.num_rows:
            index = share.value
            rows = rows.sort_by("vec_id").combine_chunks()
            ids, q_ids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            q, x, far = _matrix(queries.column("v"), dim), _matrix(rows.column("v"), dim), rows.column("far").to_numpy()
            parts = []
            for i in range(0, len(q), 256):
                r, c, s = index.search(rows.column("list")[0].as_py(), q[i : i + 256], q_ids[i : i + 256], x, codes, far, ids, k, short)
                parts.append((q_ids[i : i + 256][r], c, s))
            got = [np.concatenate(p) for p in zip(*parts, strict=True)]
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    return run


def tried(index: Index, rows: DataFrame, queries: DataFrame, target: float, k: int, dim: int) -> int:
    """The fewest lists that hold the share ``target`` of the true neighbours of ``TRIED`` queries."""
    few = queries.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(TRIED).toArrow()
    if not few.num_rows:
        return 1
    q = _matrix(few.column("v"), dim)
    near = rows.select("vec_id", "v", "list").mapInArrow(_compare(few.column("vec_id").to_numpy(), q, k), "q long, vec_id long, score double, list int")
    near = near.groupBy("q", "vec_id").agg(F.max(F.struct("score", "list")).alias("s"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s.score"), "vec_id"))).filter(F.col("rank") <= k)
    near = near.select("q", "s.list").toArrow()  # TRIED x k rows at most
    if not near.num_rows:
        return 1
    place = np.argsort(index.order(q), 1)
    at = np.sort(place[near.column("q").to_numpy(), near.column("list").to_numpy()])
    return int(at[int(np.ceil(target * len(at))) - 1]) + 1


def usable(v: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(whole, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, target: float = 0.98, short: int = 100) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score. ``queries``: a condition on ``vec_id`` that picks them."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    out = "query_id long, rank int, vec_id long, score double"
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], out)
    dim = size["d"]
    rows = rows.filter(F.size("v") == dim)
    root = max(16, min(LISTS, int(size["count"] ** 0.5)))
    options = [lists] if lists else sorted({max(16, root // 4), root})
    most = max(1, min(max(SAMPLE, 16 * options[-1]), SAMPLE_BYTES // (8 * dim)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").toArrow()
    share = spark.sparkContext.broadcast(Index(_matrix(sample.column("v"), dim), options, target, k, size["count"]))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    index = materialize(numbered.mapInArrow(_encode(share, dim), "vec_id long, v array<double>, row long, list int, code binary, far double"), "index")
    sizes = np.zeros(len(share.value.centroids), np.int64)
    for r in index.groupBy("list").agg(F.approx_count_distinct("vec_id", 0.02).alias("n")).collect():  # as many rows as lists
        sizes[r["list"]] = int(0.9 * r["n"])  # no more than there are
    once = rows.filter(queries).select("vec_id", "v").distinct()
    probe = max(share.value.probe, tried(share.value, index, once, target, k, dim))
    asked = materialize(once.mapInArrow(_probe(share, dim, sizes, k, probe), "vec_id long, v array<double>, list int"), "probes")
    # how many blocks of either side each list has: as many rows as lists
    n = index.groupBy("list").agg(F.ceil(F.count("*") / ROWS_A_BLOCK).alias("c")).join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES_A_BLOCK).alias("q")), "list")
    n = F.broadcast(n)
    # rows of one id are dealt to all blocks: queries by id and vector, candidates by row number
    mine = lambda c, *by: F.pmod(F.xxhash64(*by, F.lit(c)), F.col(c))
    left = asked.join(n, "list").withColumn("qb", mine("q", "vec_id", "v")).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).drop("c", "q")
    right = index.join(n, "list").withColumn("cb", mine("c", "row")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1))).drop("c", "q")
    by = ["list", "cb", "qb"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(share, dim, k, short), "query_id long, vec_id long, score double")
    # an id counts once, by its best score
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
