"""Page ranges and table models."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TERM = re.compile(r"^(\d+)?\s*(-)?\s*(\d+)?$")


def page_range(spec: str, pages: Column) -> Column:
    """The pages that a specification like ``1-3, 7, 9-`` names, sorted and distinct (array<long>).

    An empty, malformed or reversed term is a ValueError. Rows whose pages do not
    reach a bound get the part that exists.
    """
    parts = []
    for term in spec.split(","):
        m = _TERM.match(term.strip())
        if not m or not (m[1] or m[3]) or (m[1] and m[3] and not m[2]):
            raise ValueError(f"bad term: {term!r}")
        low = int(m[1]) if m[1] else 1
        high = int(m[3]) if m[3] else None if m[2] else low
        if low < 1 or (high is not None and high < low):
            raise ValueError(f"bad range: {term!r}")
        end = pages if high is None else F.least(F.lit(high), pages)
        none = F.expr("cast(array() as array<bigint>)")
        parts.append(F.when(end >= low, F.sequence(F.lit(low).cast("long"), end.cast("long"))).otherwise(none))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def delimiter_row(line: Column) -> Column:
    """The alignments of a table's delimiter row (array of left, right, center, none); null if it is none."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    kind = F.transform(cells, lambda x: F.when(x.rlike(r"^:-+:$"), "center").when(x.rlike(r"^:-+$"), "left").when(x.rlike(r"^-+:$"), "right").when(x.rlike(r"^-+$"), "none"))
    return F.when(F.forall(kind, lambda x: x.isNotNull()) & line.contains("|"), kind)


def body_row(line: Column, columns: Column) -> Column:
    """A row's cells, padded with empty ones or cut to the number of columns; escaped pipes stay in their cell."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), columns)), F.lit(1), columns)


def default_scope(row: Column, col: Column) -> Column:
    """A header cell's scope from its place."""
    return F.when((row == 0) & (col == 0), "Both").when(row == 0, "Column").when(col == 0, "Row").otherwise("Both")


def column_cuts(fragments: DataFrame, least: float = 6.0) -> DataFrame:
    """Gaps of at least ``least`` that no fragment of a table covers: table_id, cut_from, cut_to.

    ``fragments``: table_id, x0, x1. A gap opens where everything before has ended.
    """
    w = Window.partitionBy("table_id").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    out = fragments.withColumn("reach", F.max("x1").over(w)).filter(F.col("x0") - F.col("reach") >= least)
    return out.select("table_id", F.col("reach").alias("cut_from"), F.col("x0").alias("cut_to"))


def stitch(tables: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Tables on consecutive pages with the same columns as one chain: doc_id, table_id, page, chain, repeats_header.

    ``tables``: doc_id, table_id, page, edges (array<double>), and ``header`` (the
    first row's texts) if rows are to be joined. One table a page: a chain goes on
    while the page follows and every edge lies within the tolerance. A table whose
    header repeats that of its chain's first table loses that row
    (``repeats_header``).
    """
    w = Window.partitionBy("doc_id").orderBy("page", "table_id")
    same = (F.col("page") == F.lag("page").over(w) + 1) & (F.size("edges") == F.size(F.lag("edges").over(w))) & F.forall(F.zip_with("edges", F.lag("edges").over(w), lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    out = tables.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("_new").over(w)).drop("_new", "edges")
    if "header" not in tables.columns:
        return out
    lead = Window.partitionBy("doc_id", "chain").orderBy("page", "table_id")
    out = out.withColumn("_h", F.transform("header", lambda t: F.trim(t)))
    return out.withColumn("repeats_header", (F.row_number().over(lead) > 1) & F.col("_h").eqNullSafe(F.first("_h").over(lead))).drop("_h", "header")


def stitched_rows(chains: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of chains numbered anew: doc_id, chain, row, table_id, cells. ``rows``: doc_id, table_id, row, cells."""
    held = rows.join(chains, ["doc_id", "table_id"]).filter(~(F.coalesce("repeats_header", F.lit(False)) & (F.col("row") == 0)))
    w = Window.partitionBy("doc_id", "chain").orderBy("page", "table_id", "row")
    return held.select("doc_id", "chain", (F.row_number().over(w) - 1).alias("row"), "table_id", "cells")


def grid_issue(rows: list[list[tuple[int, int]]]) -> str | None:
    """The first irregularity of a table given as rows of (row span, column span); null if it is a grid."""
    if not rows:
        return None
    width = sum(c for _, c in rows[0])
    taken: dict[tuple[int, int], bool] = {}
    for i, row in enumerate(rows):
        at = 0
        for down, across in row:
            while taken.get((i, at)):
                at += 1
            if at + across > width:
                return f"row {i} is wider than {width} columns"
            if i + down > len(rows):
                return f"row {i}: a cell spans beyond the last row"
            for a in range(i, i + down):
                for b in range(at, at + across):
                    if taken.get((a, b)):
                        return f"row {i}: cells overlap"
                    taken[a, b] = True
            at += across
        reached = sum(1 for c in range(width) if taken.get((i, c)))
        if reached == 0:
            return f"row {i} is empty"
        if reached < width:
            return f"row {i} reaches {reached} of {width} columns"
    return None


def to_markdown(cells: Column, header: bool = True) -> Column:
    """A table (array of rows of texts) as Markdown; without a header the header row is blank."""
    from textloom.functions.text import escape_table_cell

    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(escape_table_cell(c), F.lit("\n"), F.lit("<br/>"))), " | "), F.lit(" |"))
    n = F.size(F.get(cells, F.lit(0)))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    lines = F.transform(cells, row)
    if header:
        parts = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines)))
    else:
        parts = F.concat(F.array(row(F.array_repeat(F.lit(""), n)), rule), lines)
    return F.when(F.size(cells) > 0, F.array_join(parts, "\n")).otherwise("")
