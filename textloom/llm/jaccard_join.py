"""N-gram Jaccard join: documents linked by the overlap of their word shingles.

The document by shingle incidence is never multiplied as a whole. Documents with
equal sets become one node. Bounds that follow from set sizes say which part of
the product can matter: two sets with a Jaccard similarity of t or more, put in
one order of shingles, share one among the first n - ceil(t n) + 1 of each (their
prefixes), differ in size by a factor of t at most, and share enough in the
prefixes that the rest can still reach ceil(t (n + m) / (1 + t)). The order puts
shingles that a sample of the documents shows to be frequent last, so prefixes
hold rare ones; the order is no more than an order, any gives the same links.

A column of the product (a prefix shingle) with its documents is treated thus:

1. Each document is paired with the column's first and with its predecessor: as
   many pairs as entries. Overlaps in the prefixes are counted, pairs below the
   bound go, the others are verified on whole sets. Links give components.
2. Columns whose documents are all in one component are done. In a column of at
   most ``SMALL`` documents the pairs across components are taken, as before.
3. Documents of larger columns form groups: those of one largest column, and each
   column whose documents differ in that. A group is dealt out in blocks; for each
   pair of blocks one task multiplies the two incidence matrices over prefix
   shingles and drops the pairs below the bounds, and those that an earlier group
   has. Few pairs left are verified as before. Where more are left than four times
   the documents, a second task multiplies the whole sets of those documents, and
   returns a spanning forest of the links, not the pairs.

So every pair that shares a prefix shingle is verified or already connected, and
no step emits the pairs of a large group. Links and labels stay distributed.
Shingles and sets are known by 64-bit hashes.

Cases: null, empty and wordless texts have an empty set and are linked with
nothing (component: their own id); fewer words than ``size`` make one shingle of
the whole sequence; equal rows are equal sets, so linked; null ids are members
without an id (a component of null ids only has a null id); an empty table gives
an empty result; other columns are ignored, or pass through ``one_of_each``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import ASCII_SPACE, arrow_bytes, byte_slices, discard, finish, materialize, release, row_key, sweep, tidy, windows, words
from textloom.llm.components import components

WORD_LUT = np.arange(256, dtype=np.uint8)
WORD_LUT[0x41:0x5B] += 32
WORD_LUT[[0x20, *range(0x09, 0x0E)]] = 0
WORD_LUT[0x00] = 0x41  # NUL is part of words; no byte counts as a capital otherwise

#: Documents in one of so many are looked at for frequent shingles; placing in the order only.
SAMPLE_ONE_IN = 8
#: Frequent shingles known to the order: the most frequent ones of the sample (12 bytes each).
FREQUENT = 200_000
#: Shingles that a task holds before it counts them (some 60 bytes each while it does).
HELD = 1_000_000
SMALL = 48
BLOCK = 1024
BLOOM_BITS = 27


def text_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    n = len(off) - 1
    _, _, doc, h = words(data, off, WORD_LUT)
    count = np.bincount(doc, minlength=n)
    end = np.cumsum(count)
    runs = windows(h, size)
    out = []
    for e, c in zip(end.tolist(), count.tolist(), strict=True):
        s = e - c
        out.append(np.unique(runs[s : e - size + 1]) if c >= size else windows(h[s:e], c))
    return out


def node_of(s: np.ndarray) -> int:
    """One 63-bit name for a set; 0 for the empty one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = finish(np.array([finish(s).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s))]))[0]
    return int(x >> np.uint64(1)) or 1


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def _frequent(size: int):
    """Per task: shingles of several distinct sets, with their number."""

    def run(batches):
        import pyarrow as pa

        seen, keys, n = set(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        held = []
        weight = 0

        def fold():
            nonlocal held, weight
            if held:
                u, c = np.unique(np.concatenate(held), return_counts=True)
                keys.append(u[c > 1])
                n.append(c[c > 1])
            held, weight = [], 0

        for batch in batches:
            data, off = arrow_bytes(batch.column(0))
            for i, j in byte_slices(off):
                for s in text_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size):
                    node = node_of(s)
                    if node and node not in seen:
                        seen.add(node)
                        held.append(s)
                        weight += len(s)
                if weight > HELD:
                    fold()
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(n))], names=["h", "n"])

    return tidy(run)


class Order:
    """A total order of shingles: a level (how frequent in the sample), then the hash.

    Keys are positive longs: 6 bits of level, 57 bits of hash.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        at = np.argsort(hashes)
        self.hashes = hashes[at]
        self.level = np.minimum(1 + np.log2(np.maximum(counts[at], 1)).astype(np.uint64) * np.uint64(2), np.uint64(62)).astype(np.uint64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        k = s >> np.uint64(7)
        if len(self.hashes):
            i = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
            k = k | (np.where(self.hashes[i] == s, self.level[i], np.uint64(0)) << np.uint64(57))
        return k


def _nodes(share, size: int, percent: int):
    """(id, text, k1, k2) -> id, node, n, k1, k2, and for a task's first row of each node the prefix (ordered keys)."""

    def run(batches):
        import pyarrow as pa

        order, seen = share.value, set()
        for batch in batches:
            data, off = arrow_bytes(batch.column(1))
            node, n, prefix = [], [], []
            for i, j in byte_slices(off):
                sets = text_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                keys = order.keys(np.concatenate(sets)) if sets else None
                at = 0
                for s in sets:
                    x = node_of(s)
                    node.append(x)
                    n.append(len(s))
                    mine, at = keys[at : at + len(s)], at + len(s)
                    if x and x not in seen:
                        seen.add(x)
                        p = len(s) - _ceil_div(percent * len(s), 100) + 1
                        prefix.append(np.sort(mine)[:p].view(np.int64))
                    else:
                        prefix.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), batch.column(2), batch.column(3)], names=["id", "node", "n", "prefix", "k1", "k2"])

    return tidy(run)


def _sets(share, size: int):
    """(hash of the id, text) -> node, h, s (its shingles); for the rows that the bitmap may hold."""

    def run(batches):
        import pyarrow as pa

        bitmap = share.value
        mask = 8 * len(bitmap) - 1
        for batch in batches:
            data, off = arrow_bytes(batch.column(1))
            h = batch.column(0).to_numpy()
            for i, j in byte_slices(off):
                node, own, found = [], [], []
                for x, s in zip(h[i:j].tolist(), text_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size), strict=True):
                    name = node_of(s)
                    b = (name ^ x) & mask
                    if name and bitmap[b >> 3] >> (b & 7) & 1:
                        node.append(name)
                        own.append(x)
                        found.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(own, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "h", "s"])

    return tidy(run)


def pair_overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of rows ``a`` with rows ``b`` of a sparse incidence matrix, one for each pair.

    The entries of both rows are laid under the pair's number and sorted; a column
    that both have stands twice, and a count of these by pair is the product.
    """
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    _, col = np.unique(flat, return_inverse=True)
    start = np.cumsum(n) - n
    rows = np.concatenate([a, b])
    pair = np.repeat(np.concatenate([np.arange(len(a)), np.arange(len(b))]), n[rows])
    at = np.arange(len(pair)) + np.repeat(start[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows])
    entry = pair * (int(col.max()) + 1 if len(col) else 1) + col[at]
    order = np.argsort(entry, kind="stable")
    twice = entry[order][1:] == entry[order][:-1]
    return np.bincount(pair[order][1:][twice], minlength=len(a))


def _verify(percent: int):
    """(a, b, sa, sb) -> the links among them, by sparse products over batches of pairs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sa, sb = ([x.values.to_numpy() for x in batch.column(i)] for i in (2, 3))
            n = np.array([[len(x), len(y)] for x, y in zip(sa, sb, strict=True)], np.int64).reshape(-1, 2)
            keep = []
            # pairs of some 200,000 entries at a time
            for i, j in byte_slices(np.concatenate([[0], np.cumsum(n.sum(1))]), 200_000):
                # a row that many pairs share is one row of the matrix
                nodes, row = np.unique(np.concatenate([a[i:j], b[i:j]]), return_inverse=True)
                sets: list = [None] * len(nodes)
                for r, x in zip(row.tolist(), sa[i:j] + sb[i:j], strict=True):
                    sets[r] = x
                common = pair_overlaps(sets, row[: j - i], row[j - i :])
                keep.append(i + np.flatnonzero(100 * common >= percent * (n[i:j].sum(1) - common)))
            at = pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return tidy(run)


#: Columns of a block with more rows than this are multiplied as dense slices, others entry by entry.
DENSE = 32


def overlaps(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``one`` with sets ``two``: the product of their sparse incidence matrices.

    Entries are sorted by column. A column of few rows adds one to each of its row
    pairs, counted by ``bincount``; columns of many rows are gathered into slices
    and multiplied.
    """
    out = np.zeros(len(one) * len(two), np.int64)
    flat = lambda rows: (np.concatenate([sets[r] for r in rows]) if len(rows) else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows]))
    (k1, r1), (k2, r2) = flat(one), flat(two)
    cols = np.intersect1d(k1, k2)
    if not len(cols):
        return out.reshape(len(one), len(two))

    def sorted_in(k, r):
        c = np.minimum(np.searchsorted(cols, k), len(cols) - 1)
        own = np.flatnonzero(cols[c] == k)
        own = own[np.argsort(c[own], kind="stable")]
        return c[own], r[own], np.bincount(c[own], minlength=len(cols))

    (c1, r1, n1), (c2, r2, n2) = sorted_in(k1, r1), sorted_in(k2, r2)
    begin2 = np.cumsum(n2) - n2
    thin = n1 * n2 <= DENSE * DENSE
    # each entry of side one meets the entries of side two in its column
    i = np.flatnonzero(thin[c1])
    for lo, hi in byte_slices(np.concatenate([[0], np.cumsum(n2[c1[i]])]), 1_000_000):
        x = i[lo:hi]
        times = n2[c1[x]]
        j = np.arange(times.sum()) + np.repeat(begin2[c1[x]] - (np.cumsum(times) - times), times)
        out += np.bincount(np.repeat(r1[x], times) * len(two) + r2[j], minlength=len(out))
    out = out.reshape(len(one), len(two))
    wide = np.flatnonzero(~thin)
    slot = np.full(len(cols), -1)
    for lo in range(0, len(wide), 1024):
        part = wide[lo : lo + 1024]
        slot[part] = np.arange(len(part))
        m1, m2 = np.zeros((len(one), len(part)), np.float32), np.zeros((len(two), len(part)), np.float32)
        for m, c, r in ((m1, c1, r1), (m2, c2, r2)):
            on = slot[c] >= 0
            m[r[on], slot[c[on]]] = 1
        out += (m1 @ m2.T).astype(np.int64)
        slot[part] = -1
    return out


def sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of either side; where all are on side 2, a block meets itself."""
    one = np.flatnonzero(side != 1)
    return one, one if (side == 2).all() else np.flatnonzero(side == 1)


def block_links(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between side 0 and side 1 (or inside, where all are on side 2)."""
    one, two = sides(side)
    n = np.array([len(s) for s in sets], np.int64)
    total = overlaps(sets, one, two)
    bound = 100 * total >= percent * (n[one][:, None] + n[two][None, :] - total)
    out = []
    place: dict[int, int] = {}

    def top(x):
        while place.get(x, x) != x:
            place[x] = place.get(place[x], place[x])
            x = place[x]
        return x

    for i, j in zip(*np.nonzero(bound), strict=True):
        a, b = int(nodes[one[i]]), int(nodes[two[j]])
        x, y = top(a), top(b)
        if x != y:
            place[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _lists(column) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in column.combine_chunks()] if len(column) else []


def _candidates(percent: int):
    """One pair of blocks: the pairs that the bounds leave, or, where these outnumber the documents, only the documents in them."""

    def run(table):
        import pyarrow as pa

        task, node, side, n, label, last, group = (table.column(c).to_numpy() for c in ("task", "node", "side", "n", "label", "last", "g"))
        one, two = sides(side)
        shared = overlaps(_lists(table.column("ks")), one, two)
        n1, n2 = n[one][:, None], n[two][None, :]
        first = np.where(last[one][:, None] <= last[two][None, :], n1, n2)
        rest = -(-percent * first // 100) - 1
        left = (shared > 0) & (label[one][:, None] != label[two][None, :]) & ((100 + percent) * (shared + rest) >= percent * (n1 + n2)) & (percent * np.maximum(n1, n2) <= 100 * np.minimum(n1, n2))
        if left.any():
            # a pair belongs to the first group that both are in
            before = [x[x < group[0]] for x in _lists(table.column("gs"))]
            left &= overlaps(before, one, two) == 0
        i, j = np.nonzero(np.triu(left) if one is two else left)
        if len(i) <= 4 * len(node):
            a, b, s = node[one[i]], node[two[j]], np.zeros(len(i), np.int64)
        else:
            rows = np.unique(np.concatenate([one[i], two[j]]))
            a, b, s = node[rows], np.zeros(len(rows), np.int64), side[rows]
        return pa.table({"task": pa.array(np.full(len(a), task[0] if len(task) else 0), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "side": pa.array(s, pa.int32())})

    return run


def _block(percent: int):
    def run(table):
        import pyarrow as pa

        got = block_links(table.column("node").to_numpy(), table.column("side").to_numpy(), _lists(table.column("s")), percent)
        release()
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    return run


class Join:
    """The join's state over one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> None:
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        self.text = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
        self.share = self.spark.sparkContext.broadcast
        sample = self.text.select("text").filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(SAMPLE_ONE_IN)) == 0)
        often = sample.mapInArrow(_frequent(size), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 3")
        often = often.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
        order = self.share(Order(often["h"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)))
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *row_key(F.col(id_col), F.col(text_col)))
        kind = rows.schema["id"].dataType.simpleString()
        self.nodes = materialize(rows.mapInArrow(_nodes(order, size, percent), f"id {kind}, node long, n int, prefix array<long>, k1 long, k2 int"), "nodes")

    def columns(self) -> DataFrame:
        """k, node, n, i of prefix entries whose column holds two nodes or more; ``r``: place in the column."""
        e = self.nodes.filter(F.col("prefix").isNotNull()).select("node", "n", F.posexplode("prefix").alias("i", "k"))
        w = Window.partitionBy("k").orderBy("n", "node")
        all_k = Window.partitionBy("k")
        e = e.withColumns({"before": F.lag("node").over(w), "lo": F.min("node").over(all_k), "hi": F.max("node").over(all_k)})
        return e.filter("lo <> hi AND NOT (before <=> node)").select("k", "node", "n", "i")

    def fits(self, p: str, q: str):
        """Bounds from sizes and places for two entries of a column: p has the smaller set."""
        n, m, i, j = (F.col(x).cast("long") for x in (f"{p}n", f"{q}n", f"{p}i", f"{q}i"))
        need = self.percent * (n + m)  # of (100 + percent) times the overlap
        return (self.percent * m <= 100 * n) & ((100 + self.percent) * F.least(n - i, m - j) >= need)

    def shared(self, col: DataFrame) -> DataFrame:
        """node, n, ks (its keys in columns of two nodes or more; no other counts towards an overlap), last (its prefix's last key), h (of the row that stands for it)."""
        own = self.nodes.filter("node <> 0").groupBy("node").agg(F.max(F.element_at("prefix", -1)).alias("last"), F.min(F.xxhash64("id")).alias("h"))
        keys = col.groupBy("node").agg(F.first("n").cast("long").alias("n"), F.collect_list("k").alias("ks"))
        return materialize(keys.join(own, "node"), "shared")

    def prune(self, pairs: DataFrame, shared: DataFrame) -> DataFrame:
        """Pairs (a, b) whose overlap in the prefixes leaves the needed overlap possible; with ha, hb."""
        x = shared.toDF("a", "na", "ka", "la", "ha")
        y = shared.toDF("b", "nb", "kb", "lb", "hb")
        both = pairs.join(x, "a").join(y, "b")
        common = F.size(F.array_intersect("ka", "kb")).cast("long")
        # beyond the earlier of the two prefixes' ends, that document has t n - 1 shingles left
        least = F.when(F.col("la") <= F.col("lb"), F.col("na")).otherwise(F.col("nb"))
        rest = F.ceil(self.percent * least / 100) - 1
        return both.filter((100 + self.percent) * (common + rest) >= self.percent * (F.col("na") + F.col("nb"))).select("a", "b", "ha", "hb")

    def sets(self, want: DataFrame) -> DataFrame:
        """node, h, s: whole sets of the rows in ``want`` (node, h), found through a bitmap; some others may be among them."""
        bits = min(max((8 * want.count()).bit_length(), 18), BLOOM_BITS)
        bit = F.col("node").bitwiseXOR(F.col("h")).bitwiseAND((1 << bits) - 1) + 1
        parts = want.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # 16 MB at most
        bitmap = np.zeros((1 << bits) // 8, np.uint8)
        for r in parts:
            bitmap[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        out = materialize(self.text.mapInArrow(_sets(self.share(bitmap), self.size), "node long, h long, s array<long>"), "sets")
        if out.groupBy("node", "h").count().filter("count > 1").isEmpty():
            return out
        # rows repeated under one id: one set for each
        once = materialize(out.dropDuplicates(["node", "h"]), "sets")
        discard(out)
        return once

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "ha", "sa"), ["a", "ha"]).join(sets.toDF("b", "hb", "sb"), ["b", "hb"])
        return both.select("a", "b", "sa", "sb").mapInArrow(_verify(self.percent), "a long, b long")

    def links(self) -> DataFrame:
        """Links (a, b) between nodes that connect exactly the components of all links."""
        col = materialize(self.columns(), "columns")
        shared = self.shared(col)
        sweep(self.spark)
        ends = lambda p: p.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ha").alias("h")), F.struct(F.col("b").alias("node"), F.col("hb").alias("h")))).alias("x")).select("x.*").distinct()
        w = Window.partitionBy("k").orderBy("n", "node")
        entry = F.struct("node", "n", "i")
        star = col.select("k", "node", "n", "i", F.lag(entry).over(w).alias("p"), F.first(entry).over(w).alias("f"))
        star = star.select("k", "node", "n", "i", *[F.col(f"{x}.{c}").alias(x + c) for x in "pf" for c in ("node", "n", "i")])
        pairs = star.filter(F.col("pnode").isNotNull() & self.fits("p", "")).select(F.col("pnode").alias("a"), F.col("node").alias("b"))
        pairs = pairs.union(star.filter((F.col("fnode") != F.col("node")) & self.fits("f", "")).select(F.col("fnode").alias("a"), F.col("node").alias("b")))
        pairs = materialize(self.prune(pairs.distinct(), shared), "near")
        sets = self.sets(ends(pairs))
        found = materialize(self.verify(pairs, sets), "links")
        discard(sets)
        # columns that still hold several components
        labels = components(found)
        mixed = col.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        by_k = Window.partitionBy("k")
        mixed = mixed.withColumns({"lo": F.min("label").over(by_k), "hi": F.max("label").over(by_k), "m": F.count("*").over(by_k)}).filter("lo <> hi")
        mixed = materialize(mixed.select("k", "node", "n", "i", "label", "m"), "mixed")
        discard(col)
        small, large = mixed.filter(F.col("m") <= SMALL), mixed.filter(F.col("m") > SMALL)
        # what stood before an entry in its column, SMALL at most
        row = F.struct("node", "n", "i", "label")
        earlier = small.withColumn("xs", F.collect_list(row).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("x", F.explode("xs"))
        earlier = earlier.filter("x.label <> label").select(F.col("x.node").alias("a"), F.col("x.n").alias("pn"), F.col("x.i").alias("pi"), F.col("node").alias("b"), "n", "i")
        more = earlier.filter(self.fits("p", "")).select("a", "b").distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        more = materialize(self.prune(more, shared), "near")
        facts = shared.select("node", "n", "ks", "last").join(large.select("node", "label").distinct(), "node")
        met = self.tasks(large).join(facts, "node")
        met = met.groupBy("task").applyInArrow(_candidates(self.percent), "task long, a long, b long, side int")
        met = materialize(met, "met")
        own = shared.select(F.col("node").alias("a"), F.col("h").alias("ha"))
        from_blocks = met.filter("b <> 0").select("a", "b").distinct().join(own, "a").join(own.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")
        more = more.union(from_blocks).distinct()
        dense = met.filter("b = 0").join(own, "a").select("task", F.col("a").alias("node"), F.col("ha").alias("h"), "side")
        want = materialize(ends(more).union(dense.select("node", "h")).distinct(), "wanted")
        if want.isEmpty():
            return found
        sets = self.sets(want)
        more = materialize(self.verify(more, sets), "links")
        full = dense.join(sets, ["node", "h"]).select("task", "node", "side", "s")
        last = materialize(full.groupBy("task").applyInArrow(_block(self.percent), "a long, b long"), "links")
        discard(sets, mixed, shared, met)
        return found.union(more).union(last)

    def tasks(self, large: DataFrame) -> DataFrame:
        """task, node, side, g, gs: the pairs of blocks that cover every pair of nodes that share a large column.

        A node's home is the largest column it is in. Nodes of one home are a
        group; a column whose nodes have several homes is a group of its own
        (columns of the same nodes once). Groups are dealt out in blocks, so rows
        are as many as entries, times the blocks of a group. ``gs``: the node's
        groups, by which a pair that is in several is taken once.
        """
        home = large.groupBy("node").agg(F.max_by("k", F.struct("m", "k")).alias("home"))
        col = materialize(large.select("k", "node").join(home, "node"), "homes")
        mark = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
        sig = col.groupBy("k").agg(F.min("home").alias("lo"), F.max("home").alias("hi"), F.count("*").alias("m"), mark(1).alias("s1"), mark(2).alias("s2"))
        many = materialize(sig.filter("lo <> hi"), "mixed")
        once = many.groupBy("m", "s1", "s2").agg(F.min("k").alias("k")).select("k")
        own = col.filter("k = home").join(many.select("k"), "k", "left_anti").select(F.col("k").alias("g"), "node")
        rows = own.union(col.join(once, "k", "left_semi").select(F.col("k").alias("g"), "node"))
        rows = materialize(rows, "groups")
        gs = rows.groupBy("node").agg(F.array_sort(F.collect_list("g")).alias("gs"))
        of = Window.partitionBy("g")
        rows = rows.withColumn("i", F.floor((F.row_number().over(of.orderBy("node")) - 1) / BLOCK)).withColumn("blocks", F.max("i").over(of))
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))))
        side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
        return rows.select(F.xxhash64("g", F.least("i", "j"), F.greatest("i", "j")).alias("task"), "node", side.alias("side"), "g").join(gs, "node")

    def members(self) -> DataFrame:
        """id, n, component, label (of the component; null without shingles), k1, k2 of every row."""
        labels = components(self.links())
        rows = self.nodes.select("id", "node", "n", "k1", "k2")
        least = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        least = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        top = least.groupBy("label").agg(F.min("least").alias("component"))
        top = materialize(least.join(top, "label").select("node", "label", "component", "copies"), "components")
        # nodes with more than 1/2000 of all rows: 2000 at most, broadcast so that they don't skew the join
        many = int(rows.count() / 2000) + 1
        hot = top.filter(F.col("copies") > many).select("node", "label", F.col("component").alias("hot"), F.lit(True).alias("is_hot"))
        out = rows.join(F.broadcast(hot), "node", "left")
        said = ["id", "n", "component", "label", "k1", "k2"]
        done = out.filter("is_hot OR n = 0").withColumn("component", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("hot"))).select(*said)
        rest = out.filter("is_hot IS NULL AND n > 0").drop("label").join(top.filter(F.col("copies") <= many).select("node", "label", "component"), "node").select(*said)
        return done.union(rest)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links)."""
    out = Join(docs, id_col, text_col, size, percent).members()
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: the row of the least id (a null id comes last; then by a hash of id and text).

    Of rows equal in id and text one stays. Texts without shingles all stay.
    """
    names = docs.columns
    key = row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("src"), *key, (F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(ASCII_SPACE)) == "").alias("bare"))
    found = Join(docs.select(id_col, text_col), id_col, text_col, size, percent).members().filter("n > 0")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("s")).select("s.k1", "s.k2")
    kept = rows.filter(~F.col("bare")).join(first, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    out = kept.select("src").union(rows.filter("bare").select("src"))
    return out.select(*[F.col(f"src.`{c}`").alias(c) for c in names])


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i : i + least(5, len(w)) - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r.b) FROM reach r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
