"""Placed text: lines, page text, rules, cells and tables from fragments and strokes.

A fragment is a row (page, frag, x0, y0, x1, y1, size, text) with y upwards. Work is
dealt out by page, the unit that layout is defined on; folds that depend on a
group's first member run over one page's rows, all else is joins and windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import fold_digits
from textloom.functions.values import groups_by_place

#: Rules closer than this are one rule.
SNAP = 2.0
#: Narrowest gap between columns.
COLUMN_GAP = 6
#: Share of rows that every column of a table without rules must fill.
FILLED = 0.5


def _per_group(df: DataFrame, by: list[str], order: list[str], add: str, fold) -> DataFrame:
    """``df`` with a column ``add`` (DDL) that ``fold(table)`` makes of a group's rows in order."""
    name, kind = add.split()
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(add).fields])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c.lstrip("-"), "descending" if c[0] == "-" else "ascending") for c in order])
        return table.append_column(name, pa.array(fold(table), pa.int32() if kind == "int" else pa.int64()))

    return df.groupBy(*by).applyInArrow(run, schema)


def group_lines(frags: DataFrame) -> DataFrame:
    """``frags`` with ``line``, from 0 at the top: a fragment begins a line when it is off the line's first one by more than half its size (2 at least)."""

    def fold(table: pa.Table) -> list[int]:
        out, anchor = [], None
        for y, size in zip(table.column("y0").to_pylist(), table.column("size").to_pylist(), strict=True):
            if anchor is None or abs(y - anchor) > max(2.0, 0.5 * size):
                anchor = y
                out.append(out[-1] + 1 if out else 0)
            else:
                out.append(out[-1])
        return out

    return _per_group(frags, ["page"], ["-y0", "x0", "frag"], "line int", fold)


def page_text(lines: DataFrame) -> DataFrame:
    """page, text: lines joined by line ends; a space where the gap to the fragment before is over a quarter of the size."""
    w = Window.partitionBy("page", "line").orderBy("x0", "frag")
    gap = F.col("x0") - F.lag("x1").over(w)
    piece = F.concat(F.when(gap > 0.25 * F.col("size"), " ").otherwise(""), F.col("text"))
    ordered = lambda c, *by: F.array_sort(F.collect_list(F.struct(*by, F.col(c).alias("t"))))
    rows = lines.withColumn("t", piece).groupBy("page", "line").agg(ordered("t", "x0", "frag").alias("s"))
    rows = rows.select("page", "line", F.rtrim(F.array_join(F.transform("s", lambda x: x["t"]), "")).alias("t"))
    return rows.groupBy("page").agg(ordered("t", "line").alias("s")).select("page", F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("text"))


def collinear(rules: list[tuple[float, float, float]], snap: float = SNAP) -> list[list[float]]:
    """Rules (pos, lo, hi) of one axis with those that touch as one (see ``cluster_rules``)."""
    got: list[list[float]] = []
    for pos, lo, hi in sorted(rules):
        if got and pos - got[-1][0] <= snap and lo <= got[-1][2] + snap:
            before = got[-1]
            got[-1] = [(before[0] + pos) / 2, min(before[1], lo), max(before[2], hi)]
        else:
            got.append([pos, lo, hi])
    return got


def cluster_rules(rules: DataFrame, snap: float = SNAP) -> DataFrame:
    """Collinear rules that touch as one: page, axis, pos, lo, hi. ``rules``: page, axis, pos, lo, hi.

    In order of place a rule joins the last one if it lies within ``snap`` of it and
    their spans touch; the place is then the middle of both.
    """

    def run(table: pa.Table) -> pa.Table:
        got = collinear(list(zip(*(table.column(c).to_pylist() for c in ("pos", "lo", "hi")), strict=True)), snap)
        keep = table.select(["page", "axis"]).take(pa.array(np.zeros(len(got), np.int64)))
        for i, c in enumerate(("pos", "lo", "hi")):
            keep = keep.append_column(c, pa.array([g[i] for g in got], pa.float64()))
        return keep

    page = rules.schema["page"].dataType.simpleString()
    return rules.select("page", "axis", *[F.col(c).cast("double").alias(c) for c in ("pos", "lo", "hi")]).groupBy("page", "axis").applyInArrow(run, f"page {page}, axis string, pos double, lo double, hi double")


def edge_at(sides: DataFrame, edges: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """side_id, edge: the first stroke (by ``ordinal``) within the tolerance of a side that spans it whole.

    ``sides``: page, side_id, pos, lo, hi. ``edges``: page, edge, ordinal, pos, lo,
    hi. Places are rounded to steps of the tolerance; a stroke is looked for in the
    steps beside its own, so the join is on equal keys.
    """
    step = lambda c: F.floor(F.col(c) / tolerance)
    s = sides.withColumn("_k", step("pos"))
    e = edges.select("page", "edge", "ordinal", *[F.col(c).alias(f"e{c}") for c in ("pos", "lo", "hi")]).withColumn("_k", F.explode(F.sequence(step("epos") - 1, step("epos") + 1)))
    spans = (F.abs(F.col("epos") - F.col("pos")) <= tolerance) & (F.col("elo") <= F.col("lo") + tolerance) & (F.col("ehi") >= F.col("hi") - tolerance)
    first = s.join(e, ["page", "_k"]).filter(spans).groupBy("page", "side_id").agg(F.min_by("edge", "ordinal").alias("edge"))
    return sides.select("page", "side_id").join(first, ["page", "side_id"], "left")


def grid_cells(across: list[list[bool]], down: list[list[bool]]) -> list[tuple[int, int, int, int]]:
    """(row, column, row span, column span) of the cells of a grid of separators.

    ``across[r][c]``: a stroke between columns c and c + 1 of row r; ``down[c][r]``:
    one between rows r and r + 1 of column c. From the top left a cell takes the
    columns that nothing divides in its first row, then the rows below as long as
    nothing divides any of these columns.
    """
    rows, cols = len(across), len(down)
    free = np.ones((rows, cols), bool)
    out = []
    for r, c in np.ndindex(rows, cols):
        if not free[r, c]:
            continue
        wide = next((k for k in range(1, cols - c) if not free[r, c + k] or across[r][c + k - 1]), cols - c)
        tall = next((k for k in range(1, rows - r) if any(down[i][r + k - 1] or not free[r + k, i] for i in range(c, c + wide))), rows - r)
        free[r : r + tall, c : c + wide] = False
        out.append((r, c, tall, wide))
    return out


def cell_text(frags: DataFrame, cells: DataFrame) -> DataFrame:
    """page, cell, text: a cell's fragments (by their middle) from the top, then from the left, joined by spaces.

    ``frags``: page, frag, x0, y0, x1, y1, text. ``cells``: page, cell, x0, y0, x1,
    y1. Both are few on a page, and the page is the key of the join.
    """
    f = frags.select("page", "frag", "text", "x0", "y0", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    c = cells.select("page", "cell", *[F.col(k).alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")])
    inside = (F.col("mx") >= F.col("cx0")) & (F.col("mx") <= F.col("cx1")) & (F.col("my") >= F.col("cy0")) & (F.col("my") <= F.col("cy1"))
    held = c.join(f, "page").filter(inside).groupBy("page", "cell").agg(F.array_sort(F.collect_list(F.struct((-F.col("y0")).alias("y"), "x0", "frag", "text"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    return cells.select("page", "cell").join(held.select("page", "cell", text.alias("text")), ["page", "cell"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def whitespace_columns(lines: DataFrame) -> DataFrame:
    """Tables without rules: page, n_rows, cuts (array<double>), accepted.

    ``lines``: fragments with their line. Columns are parted by gaps that no line
    covers, in whole units from the left edge, ``COLUMN_GAP`` wide at least and as
    far from either edge; a table needs two lines, two columns, and text of at
    least half of its rows in each column.
    """
    box = lines.groupBy("page").agg((F.min("x0") - 1).alias("left"), (F.max("x1") + 1).alias("right"), F.count_distinct("line").alias("n_rows"))
    spans = lines.join(box, "page").select("page", "left", "right", F.floor(F.col("x0") - F.col("left")).alias("a"), F.ceil(F.col("x1") - F.col("left")).alias("b")).distinct()
    before = Window.partitionBy("page").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.withColumn("reach", F.max("b").over(before)).filter(F.col("a") > F.col("reach") + 1)
    start, end = F.col("left") + F.col("reach") + 1, F.col("left") + F.col("a")
    gaps = gaps.filter((start > F.col("left") + COLUMN_GAP) & (end < F.col("right") - COLUMN_GAP) & (end - start >= COLUMN_GAP))
    inner = gaps.groupBy("page").agg(F.array_sort(F.collect_set((start + end) / 2)).alias("inner"))
    none = F.expr("cast(array() as array<double>)")
    table = box.join(inner, "page", "left").select("page", "n_rows", F.concat(F.array("left"), F.coalesce("inner", none), F.array("right")).alias("cuts"))
    middle = (F.col("x0") + F.col("x1")) / 2
    column = F.size(F.filter("cuts", lambda c: c <= middle)) - 1
    filled = lines.join(table, "page").select("page", "line", column.alias("column")).distinct().groupBy("page", "column").agg(F.count("*").alias("n")).groupBy("page").agg(F.min("n").alias("least"), F.count("*").alias("columns"))
    ok = (F.col("n_rows") >= 2) & (F.size("cuts") >= 3) & (F.col("columns") == F.size("cuts") - 1) & (F.col("least") >= F.ceil(F.col("n_rows") * FILLED))
    return table.join(filled, "page").select("page", "n_rows", "cuts", ok.alias("accepted"))


def watermarks(lines: DataFrame, pages: DataFrame, tolerance: float = 2.0, least: int | None = None) -> DataFrame:
    """Lines that repeat at one place: doc, text, first_page, pages, occurrences; digits folded, on half of a document's pages (two at least).

    ``lines``: doc, page, ordinal, x0, y0, x1, y1, text. ``pages``: doc, n_pages. A
    line belongs to the first group of its text whose first box has every edge
    within the tolerance; such groups are sought among one document's lines of one
    text.
    """

    def fold(table: pa.Table) -> list[int]:
        boxes = list(zip(*(table.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")), strict=True))
        out = [0] * len(boxes)
        for k, members in enumerate(groups_by_place(boxes, tolerance)):
            for i in members:
                out[i] = k
        return out

    keyed = lines.withColumn("key", fold_digits(F.col("text")))
    placed = _per_group(keyed, ["doc", "key"], ["page", "ordinal"], "place int", fold)
    per = placed.groupBy("doc", "key", "place").agg(F.min_by("text", F.struct("page", "ordinal")).alias("text"), F.min("page").alias("first_page"), F.count_distinct("page").alias("pages"), F.count("*").alias("occurrences"))
    enough = F.lit(least) if least else F.greatest(F.lit(2), F.ceil(F.col("n_pages") / 2))
    return per.join(pages, "doc").filter(F.col("pages") >= enough).select("doc", "text", "first_page", "pages", "occurrences")


def structured(lines: DataFrame, size: Column | None = None) -> DataFrame:
    """Lines as rows: page, line, x0, y0, x1, y1 (their box), size (the largest), text (see ``page_text``)."""
    box = lines.groupBy("page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size" if size is None else size).alias("size"))
    one = lines.withColumn("page", F.struct("page", "line"))
    text = page_text(one.withColumn("line", F.lit(0))).select("page.page", "page.line", "text")
    return box.join(text, ["page", "line"])
