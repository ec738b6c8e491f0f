"""General graphs as rows: what roots reach, and chains of revisions merged newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.scratch import discard, materialize

#: After so many steps the tables of the steps become one, so that plans stay short.
STEPS_A_TABLE = 12


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, steps: every node that a path from a root reaches, and the least number of edges to it.

    ``edges``: src, dst. ``roots``: node. Each step joins the nodes found last, and
    no others, with the edges and keeps those not found before; so an edge is used
    once, and rings end. A hub is a hot key of one side of a join, which Spark
    splits. There are as many steps as the longest of the shortest paths has edges.

    Null nodes and edges with a null end are left out; edges or roots given twice
    are one; a root without edges reaches itself; no roots, no rows.
    """
    links = materialize(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links")
    new = materialize(roots.select("node").filter("node IS NOT NULL").distinct().withColumn("steps", F.lit(0)), "reached")
    parts, steps = [new], 0
    while not new.isEmpty():
        steps += 1
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        ahead = new.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node")).distinct()
        new = materialize(ahead.join(found.select("node"), "node", "left_anti").withColumn("steps", F.lit(steps)), "reached")
        if len(parts) == STEPS_A_TABLE:
            whole = materialize(found, "reached")
            discard(*parts)
            parts = [whole]
        parts.append(new)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (with a column node) that no root reaches; a null node is reached by none."""
    return nodes.join(reachable(edges, roots).select("node"), "node", "left_anti")


def live_objects(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """file, number, generation, offset: the objects of files that were changed by appending.

    ``sections``: file, section, prev (the section before; null: none), newest
    (boolean: where reading begins). ``entries``: file, section, place (in the
    section), number, generation, offset, free. Sections are followed from the
    newest; of a number's entries the last of the newest section holds, and where
    that one is free the object is gone, whatever older sections say.

    A chain that comes back to a section ends there; sections that no chain reaches
    say nothing; a ``prev`` that is not there ends the chain.
    """
    at = lambda name: F.when(F.col(name).isNotNull(), F.struct("file", F.col(name).alias("section")))
    order = reachable(sections.select(at("section").alias("src"), at("prev").alias("dst")), sections.filter("newest").select(at("section").alias("node")))
    placed = entries.join(order.select("node.file", "node.section", "steps"), ["file", "section"])
    newest = F.min_by(F.struct("free", "generation", "offset"), F.struct("steps", -F.col("place"), "offset", "generation", "free"))
    return placed.groupBy("file", "number").agg(newest.alias("e")).filter(~F.coalesce("e.free", F.lit(False))).select("file", "number", "e.generation", "e.offset")


def packed_rows(data: Column, widths: list[int]) -> Column:
    """An array of arrays: the big-endian fields of a binary column, so many bytes each; a field without bytes is null, a rest shorter than a row is left out.

    Fields have 7 bytes at most (a long). Null data give null.
    """
    if any(w < 0 or w > 7 for w in widths):
        raise ValueError("fields have 0 to 7 bytes")
    size = sum(widths)
    if not size:
        raise ValueError("a row has no bytes")
    starts = [sum(widths[:i]) for i in range(len(widths))]
    digits = F.hex(data)

    def field(row: Column, at: int, width: int) -> Column:
        if not width:
            return F.lit(None).cast("long")
        return F.conv(F.substring(digits, 2 * (row * size + at) + 1, F.lit(2 * width)), 16, 10).cast("long")

    count = F.floor(F.length(data) / size).cast("int")
    rows = F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: i < count)
    return F.when(data.isNotNull(), F.transform(rows, lambda i: F.array(*[field(i, a, w) for a, w in zip(starts, widths, strict=True)])))
