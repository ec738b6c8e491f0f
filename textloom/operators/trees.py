"""Trees as rows: pointers followed by doubling, so a chain of n links takes log n joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.scratch import materialize


def climb(nodes: DataFrame, node: str, up: str, gather: dict[str, Column], merge: dict[str, Callable[[Column, Column], Column]], grows: bool = False) -> DataFrame:
    """node, root, and what each node's way to its root gathers; nodes on or below a ring are left out.

    ``nodes``: node, up (null at a root, or the key of a node that is not there:
    then the node itself is the root). ``gather``: name -> a node's own part;
    ``merge``: name -> function of (lower part, upper part). Every way of n nodes
    ends after log2(n) doublings; what goes on is a ring. Parts that grow
    (``grows``, as lists do) are gathered when nodes of rings are known and gone.
    """
    names = list(gather)
    own = nodes.select(F.col(node).alias("node"), F.struct(F.col(up).alias("up"), *[c.alias(n) for n, c in gather.items()]).alias("s"))
    # a key given twice is one node: the one whose link and parts come first
    own = materialize(own.groupBy("node").agg(F.min("s").alias("s")).select("node", "s.*"), "nodes")
    # merged: written keys are small on disk and large in memory, so Spark might broadcast them
    if grows:
        own = materialize(own.join(climb(own, "node", "up", {}, {}).select("node").hint("merge"), "node", "left_semi"), "nodes")
    there = own.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    start = own.select("node", F.col("node").alias("root"), *names, "up")
    ended = "node", "root", *names
    # nodes at their end are set aside, so no task gets all of them for their common null
    done = [materialize(start.filter("up IS NULL").unionByName(start.filter("up IS NOT NULL").join(there.hint("merge"), "up", "left_anti")).select(*ended), "climb")]
    now = materialize(start.join(there.hint("merge"), "up", "left_semi").select(*ended, "up"), "climb")
    left = own.count().bit_length() + 1
    while left and not now.isEmpty():
        above = reduce(DataFrame.unionByName, done).withColumn("up", F.lit(None).cast(now.schema["up"].dataType)).unionByName(now)
        above = above.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("high"), *[F.col(n).alias(f"_{n}") for n in names])
        parts = [merge[n](F.col(n), F.col(f"_{n}")).alias(n) for n in names]
        went = materialize(now.join(above.hint("merge"), "up").select("node", F.col("high").alias("root"), *parts, F.col("next").alias("up")), "climb")
        done.append(went.filter("up IS NULL").drop("up"))
        now = went.filter("up IS NOT NULL")
        left -= 1
    return reduce(DataFrame.unionByName, done)


def sibling_places(nodes: DataFrame) -> DataFrame:
    """node, parent, place (from 0): from ``first`` (a parent's first child) and ``next`` links. ``nodes``: node, first, next.

    Nodes of a ring of siblings have no place; nodes that no list holds are roots
    (parent null).
    """
    before = nodes.filter("next IS NOT NULL").groupBy(F.col("next").alias("node")).agg(F.min("node").alias("before"))
    links = nodes.select("node").join(before, "node", "left")
    ranked = climb(links, "node", "before", {"place": F.lit(0) + F.col("before").isNotNull().cast("int")}, {"place": lambda low, high: low + high})
    head = nodes.filter("first IS NOT NULL").groupBy(F.col("first").alias("root")).agg(F.min("node").alias("parent"))
    return ranked.join(head, "root", "left").select("node", "parent", "place")


def outline(nodes: DataFrame) -> DataFrame:
    """Outline entries in reading order: node, root, depth (from 1), path (places from the top). ``nodes``: node, first, next; null keys of roots' parents."""
    placed = sibling_places(nodes)
    key = F.array("place")
    ways = climb(placed, "node", "parent", {"path": key}, {"path": lambda low, high: F.concat(high, low)}, grows=True)
    return ways.select("node", "root", F.size("path").alias("depth"), "path")


def nearest_above(nodes: DataFrame, value: str) -> DataFrame:
    """node, value: a node's own value, else that of its nearest ancestor that has one. ``nodes``: node, parent, and the value."""
    out = climb(nodes, "node", "parent", {value: F.col(value)}, {value: lambda low, high: F.coalesce(low, high)})
    return out.select("node", value)


def resolve_roles(names: DataFrame, roles: DataFrame, standard: list[str]) -> DataFrame:
    """doc, name, role: the role map is followed to a standard type, an unmapped name, or the name at which a cycle closes.

    ``names``: doc, name. ``roles``: doc, name, target. A document's map is one
    small value; standard types are looked up before it.
    """
    maps = roles.groupBy("doc", "name").agg(F.min("target").alias("target")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("name", "target"))).alias("m"))
    known = F.array(*[F.lit(s) for s in standard])
    end = lambda s: F.array_contains(known, s["now"]) | F.try_element_at("m", s["now"]).isNull() | F.array_contains(s["seen"], s["now"])
    start = F.struct(F.col("name").alias("now"), F.expr("cast(array() as array<string>)").alias("seen"))
    step = lambda s, _: F.when(end(s), s).otherwise(F.struct(F.try_element_at("m", s["now"]).alias("now"), F.concat(s["seen"], F.array(s["now"])).alias("seen")))
    walked = F.aggregate(F.sequence(F.lit(0), F.size("m")), start, step, lambda s: s["now"])
    return names.join(maps, "doc", "left").select("doc", "name", F.when(F.col("m").isNull(), F.col("name")).otherwise(walked).alias("role"))


def tree_entries(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Entries of a name or number tree in the order of its leaves: key, value, first of equal keys. ``leaves``: leaf, entries (array of key, value)."""
    rows = leaves.select(*order, F.posexplode("entries").alias("pos", "e")).select(*order, "pos", "e.key", "e.value")
    return rows.groupBy("key").agg(F.min_by("value", F.struct(*order, "pos")).alias("value"))


def tree_lookup(wanted: DataFrame, leaves: DataFrame) -> DataFrame:
    """key, value: the first entry of the key in a leaf whose bounds (``lo``, ``hi``; null: none) admit it. ``leaves``: leaf, lo, hi, entries."""
    rows = leaves.select("leaf", "lo", "hi", F.posexplode("entries").alias("pos", "e")).select("leaf", "lo", "hi", "pos", "e.key", "e.value")
    inside = F.coalesce((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")), F.lit(True))
    hit = rows.filter(inside).groupBy("key").agg(F.min_by("value", F.struct("leaf", "pos")).alias("value"))
    return wanted.select("key").join(hit, "key", "left")


#: Letters of page label styles (fixed values).
LABEL_STYLES = {"D": "D", "r": "r", "R": "R", "a": "a", "A": "A"}


def page_labels(entries: DataFrame) -> DataFrame:
    """start_index, style, prefix, start of a number tree's label dictionaries: an unknown style is none, a missing start 1.

    ``entries``: key, value (map<string,string>; null values are left out).
    """
    v = F.col("value")
    style = F.when(v["S"].isin(list(LABEL_STYLES)), v["S"]).otherwise("none")
    return entries.filter(v.isNotNull()).select(F.col("key").alias("start_index"), style.alias("style"), F.coalesce(v["P"], F.lit("")).alias("prefix"), F.coalesce(v["St"].try_cast("long"), F.lit(1)).alias("start"))


def page_tree_issues(nodes: DataFrame) -> DataFrame:
    """node, issue: what is wrong in a page tree. ``nodes``: node, parent, kind (Pages, Page), count (of a Pages node).

    Issues: a kind that is neither, a parent that is no Pages node, a node on or
    below a ring of parents, a count that is not the number of pages below.
    """
    up = nodes.select(F.col("node").alias("parent"), F.col("kind").alias("parent_kind"))
    held = nodes.join(up, "parent", "left")
    bad_kind = held.filter(~F.coalesce(F.col("kind").isin("Pages", "Page"), F.lit(False))).select("node", F.lit("kind").alias("issue"))
    no_parent = held.filter(F.col("parent").isNotNull() & ~F.col("parent_kind").eqNullSafe(F.lit("Pages"))).select("node", F.lit("parent").alias("issue"))
    ways = materialize(climb(nodes, "node", "parent", {"way": F.array("node")}, {"way": lambda low, high: F.concat(high, low)}, grows=True), "ways")
    ring = nodes.select("node").join(ways.select("node"), "node", "left_anti").select("node", F.lit("ring").alias("issue"))
    leaves = ways.join(nodes.filter("kind = 'Page'").select("node"), "node").select(F.explode("way").alias("node")).groupBy("node").agg(F.count("*").alias("pages"))
    counts = nodes.filter("kind = 'Pages'").join(leaves, "node", "left").join(ways.select("node"), "node")
    wrong = counts.filter(~F.col("count").eqNullSafe(F.coalesce("pages", F.lit(0)))).select("node", F.lit("count").alias("issue"))
    return bad_kind.union(no_parent).union(ring).union(wrong)


def chain_verdicts(certs: DataFrame, anchors: DataFrame, at: Column) -> DataFrame:
    """cert, verdict: the chain of issuers from a certificate to an anchor: valid, expired, untrusted or ring.

    ``certs``: cert, issuer (null or itself: self-issued), not_before, not_after.
    ``anchors``: cert.
    """
    ok = (F.col("not_before") <= at) & (at <= F.col("not_after"))
    rows = certs.select("cert", F.when(F.col("issuer") != F.col("cert"), F.col("issuer")).alias("issuer"), ok.alias("ok"))
    ways = climb(rows, "cert", "issuer", {"ok": F.col("ok")}, {"ok": lambda low, high: low & high})
    trusted = anchors.select(F.col("cert").alias("root"), F.lit(True).alias("trusted"))
    said = ways.join(trusted, "root", "left").select(F.col("node").alias("cert"), F.when(F.col("trusted").isNull(), "untrusted").when(F.col("ok"), "valid").otherwise("expired").alias("verdict"))
    return certs.select("cert").join(said, "cert", "left").select("cert", F.coalesce("verdict", F.lit("ring")).alias("verdict"))


def reading_order(ways: DataFrame, by: str) -> DataFrame:
    """``ways`` (with ``by`` and path) with ``ordinal``, the place of a node in its tree's reading order."""
    return ways.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy("path")) - 1)
