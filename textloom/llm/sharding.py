"""Sharding by longest processing time.

Documents of equal text form a group that stays together. Groups are taken from
the largest to the smallest, each to the shard with the least load, through a
heap. The law is ``bytes``: shard sizes as equal as the rule makes them.

Groups of one size are interchangeable, so the heap works on a table of
(size, number of groups), not on groups: the driver holds a row for each distinct
group size. Sizes are exact, and the table has a bound: ``d`` distinct sizes need
d (d + 1) / 2 bytes of text at least, so 100 TB have 14 million at most (a row is 16
bytes, and 8 for each shard). The plan goes back as a table that is joined, not broadcast. Inside a class,
shards take consecutive ranges of ranks; ranks are found per class and bucket, so
a class or a text that holds a third of all rows never lies in one task.

Cases: a null text has no bytes (size 1, checksum 0) and groups with the empty
text; equal rows are separate rows of one group, each with its own slot; groups of
equal size go to shards in order of bucket and digest, shards of equal load by
number; a text of any length is one row; null ids are allowed; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize

BUCKETS = 256


def lpt(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """How many groups of each class go to each shard.

    Classes are taken by size, largest first; each group goes to the least
    loaded shard (ties: the lower number). A long run of one size is first dealt
    out as far as the heap would in whole rounds, so the cost doesn't grow with
    the number of groups.
    """
    load = [0] * shards
    out = np.zeros((len(sizes), shards), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size, n = int(sizes[i]), int(counts[i])
        if n > 4 * shards:
            # levels the heap reaches: fill all shards to the same height
            low, high = min(load), max(load) + size * (n // shards + 1)
            while low < high:  # highest whole-round level that n groups can pay for
                mid = (low + high + 1) // 2
                if sum(max(0, (mid - x) // size) for x in load) <= n - shards:
                    low = mid
                else:
                    high = mid - 1
            for s in range(shards):
                k = max(0, (low - load[s]) // size)
                out[i, s] += k
                load[s] += k * size
                n -= k
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(n):
            x, s = heapq.heappop(heap)
            out[i, s] += 1
            load[s] = x + size
            heapq.heappush(heap, (load[s], s))
    return out


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.unhex(F.substring(F.sha2(t, 256), 1, 32)).alias("digest"),
        F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(BUCKETS)).cast("int").alias("spread"),
    )
    rows = materialize(rows, "sizes")
    # map-side sums: a text of very many copies reaches the shuffle once a task
    groups = rows.groupBy("digest").agg(F.sum("size").alias("total"), F.count("*").alias("copies"))
    groups = groups.select("digest", "copies", F.col("total").alias("class"), F.pmod(F.hash("digest"), F.lit(BUCKETS)).alias("bucket"))
    groups = materialize(groups, "groups")
    # (class, bucket): the rank of a bucket's first group in its class
    held = groups.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes, n = (c.to_numpy() for c in held.groupBy("class").agg(F.sum("n").alias("n")).toArrow().columns)
    upto = np.cumsum(lpt(sizes, n, shards), axis=1)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, upto.size + 1, shards), pa.int32()), pa.array(upto.ravel()))
    bounds = spark.createDataFrame(pa.table({"class": pa.array(sizes, pa.int64()), "upto": flat}))
    starts = starts.drop("n").join(bounds, "class")
    rank = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("digest")) - 1
    placed = groups.withColumn("r", rank).join(starts, ["class", "bucket"]).withColumn("r", F.col("r") + F.col("start"))
    placed = placed.select("digest", "copies", F.size(F.filter("upto", lambda x: x <= F.col("r"))).alias("shard"))
    placed = materialize(placed, "placed")
    # texts with more than 1/2000 of all rows: at most 2000 of them, so they are broadcast and don't skew the join
    many = int(rows.count() / 2000) + 1
    hot = placed.filter(F.col("copies") > many).select("digest", "shard")
    joined = rows.join(F.broadcast(hot), "digest", "left")
    rest = joined.filter(F.col("shard").isNull()).drop("shard").join(placed.filter(F.col("copies") <= many).select("digest", "shard"), "digest")
    all_rows = joined.filter(F.col("shard").isNotNull()).select(*rest.columns).union(rest)
    all_rows = materialize(all_rows, "sharded")
    # slots: rank inside (shard, spread) plus the rows of lower spreads
    n = all_rows.groupBy("shard", "spread").agg(F.count("*").alias("n"))
    n = n.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("spread").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    slot = F.row_number().over(Window.partitionBy("shard", "spread").orderBy("doc_id", "digest")) - 1
    out = all_rows.withColumn("r", slot).join(F.broadcast(n), ["shard", "spread"])  # shards x BUCKETS rows
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("r") + F.col("base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
