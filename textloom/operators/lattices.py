"""Tables from strokes alone: rules that cross make a lattice, a lattice is a table, tables lie in cells of others.

Strokes become rules by columns; a page's rules are then one Arrow group, where
collinear ones become one (``layout.collinear``), in numpy. Which rules cross is asked of rules
sorted by place, so each rule looks only at those within its span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.layout import SNAP, collinear, grid_cells
from textloom.scratch import materialize

# Fixed values, in points: how far a stroke may lean, how short a rule may be, and
# the part of a table that a rule spans if it is of the table and not of one cell.
LEAN = 0.6
SHORTEST = 3.0
WHOLE = 0.9


def rules(strokes: DataFrame) -> DataFrame:
    """page, axis (h, v), pos, lo, hi: strokes along an axis.

    ``strokes``: page, x0, y0, x1, y1. Leaning and shorter strokes, and strokes with a
    null or non-finite end, are none.
    """
    ends = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    x0, y0, x1, y1 = ends
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    fine = F.lit(True)
    for e in ends:
        fine = fine & ~F.isnan(e) & (F.abs(e) < float("inf"))
    axis = F.when((dy <= LEAN) & (dx >= SHORTEST), "h").when((dx <= LEAN) & (dy >= SHORTEST), "v")
    flat = F.col("axis") == "h"
    drawn = strokes.filter(fine).select("page", axis.alias("axis"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).filter("axis IS NOT NULL")
    middle, lo, hi = (F.when(flat, a).otherwise(b) for a, b in (((F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2), (F.least("x0", "x1"), F.least("y0", "y1")), (F.greatest("x0", "x1"), F.greatest("y0", "y1"))))
    return drawn.select("page", "axis", middle.alias("pos"), lo.alias("lo"), hi.alias("hi"))


def components(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A number for each rule of ``h``, then of ``v`` (rows of pos, lo, hi), the same for rules that crossings connect."""
    up = list(range(len(h) + len(v)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    order = np.argsort(h[:, 0], kind="stable")
    places = h[order, 0]
    for j, (x, lo, hi) in enumerate(v):
        near = order[np.searchsorted(places, lo - SNAP) : np.searchsorted(places, hi + SNAP, "right")]
        for i in near[(h[near, 1] - SNAP <= x) & (x <= h[near, 2] + SNAP)]:
            up[top(int(i))] = top(len(h) + j)
    return np.array([top(i) for i in range(len(up))], np.int64)


def _cuts(places: np.ndarray) -> np.ndarray:
    """The different places, those within ``SNAP`` of the last one kept left out."""
    out: list[float] = []
    for p in np.sort(places):
        if not out or p - out[-1] > SNAP:
            out.append(float(p))
    return np.array(out)


def _spanned(lines: np.ndarray, pos: float, lo: float, hi: float) -> bool:
    return bool(((np.abs(lines[:, 0] - pos) <= SNAP) & (lines[:, 1] <= lo + SNAP) & (lines[:, 2] >= hi - SNAP)).any())


class Grid:
    """The cells of rules: ``n_rows``, ``n_cols``, cells (row, col, tall, wide, x0, y0, x1, y1), row 0 at the top."""

    def __init__(self, h: np.ndarray, v: np.ndarray) -> None:
        x, y = _cuts(v[:, 0]), -_cuts(-h[:, 0])
        self.n_rows, self.n_cols, self.cells = len(y) - 1, len(x) - 1, []
        if self.n_rows < 1 or self.n_cols < 1:
            self.n_rows = self.n_cols = 0
            return
        self.box = (x[0], y[-1], x[-1], y[0])
        across = [[_spanned(v, x[c + 1], y[r + 1], y[r]) for c in range(self.n_cols - 1)] for r in range(self.n_rows)]
        down = [[_spanned(h, y[r + 1], x[c], x[c + 1]) for r in range(self.n_rows - 1)] for c in range(self.n_cols)]
        self.cells = [(r, c, t, w, x[c], y[r + t], x[c + w], y[r]) for r, c, t, w in grid_cells(across, down)]


def _box(h: np.ndarray, v: np.ndarray) -> tuple[float, float, float, float]:
    x, y = np.concatenate([h[:, 1], h[:, 2], v[:, 0]]), np.concatenate([h[:, 0], v[:, 1], v[:, 2]])
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())


def _within(inner, outer) -> bool:
    return inner[0] >= outer[0] - SNAP and inner[1] >= outer[1] - SNAP and inner[2] <= outer[2] + SNAP and inner[3] <= outer[3] + SNAP


def _held(lines: np.ndarray, place: tuple[float, float], span: tuple[float, float]) -> np.ndarray:
    return (lines[:, 0] >= place[0] - SNAP) & (lines[:, 0] <= place[1] + SNAP) & (lines[:, 1] >= span[0] - SNAP) & (lines[:, 2] <= span[1] + SNAP)


def nested(h: np.ndarray, v: np.ndarray, name: str = "") -> list[tuple[str, Grid]]:
    """The table of rules, then those in its cells, each with its name: the outer one's, ``/``, row, ``,``, column.

    Rules that span the table make a coarse grid; if those inside of one coarse cell
    make two rows and two columns, by themselves or with the cell's edges, they are a
    table of their own there, else they divide the outer table.
    """
    out, stack = [], [(h, v, name)]
    while stack:
        h, v, name = stack.pop()
        x0, y0, x1, y1 = _box(h, v)
        wide, tall = h[:, 2] - h[:, 1] >= WHOLE * (x1 - x0), v[:, 2] - v[:, 1] >= WHOLE * (y1 - y0)
        own_h, own_v, inner = np.ones(len(h), bool), np.ones(len(v), bool), []
        if not (wide.all() and tall.all()):
            for _, _, _, _, a, b, c, d in Grid(h[wide], v[tall]).cells:
                in_h, in_v = ~wide & _held(h, (b, d), (a, c)), ~tall & _held(v, (a, c), (b, d))
                if not in_h.any() and not in_v.any():
                    continue
                part = h[in_h], v[in_v]
                grid = Grid(*part)
                if min(grid.n_rows, grid.n_cols) < 2:
                    part = np.vstack([part[0], [(d, a, c), (b, a, c)]]), np.vstack([part[1], [(a, b, d), (c, b, d)]])
                    grid = Grid(*part)
                if min(grid.n_rows, grid.n_cols) >= 2:
                    inner.append((*part, grid.box))
                    own_h, own_v = own_h & ~in_h, own_v & ~in_v
        grid = Grid(h[own_h], v[own_v])
        if not grid.cells:
            continue
        out.append((name, grid))
        for part_h, part_v, (a, b, c, d) in reversed(inner):
            x, y = (a + c) / 2, (b + d) / 2
            held = [(r, k) for r, k, _, _, p, q, s, t in grid.cells if p <= x <= s and q <= y <= t]
            # a part as large as what it was taken from would come back for ever
            if held and len(part_h) + len(part_v) < len(h) + len(v):
                stack.append((part_h, part_v, f"{name}/{held[0][0]},{held[0][1]}"))
    return out


def page_tables(h: np.ndarray, v: np.ndarray) -> list[tuple[str, Grid]]:
    """The tables of a page, outer ones numbered from 0 from the top, then from the left.

    A lattice inside the box of a larger one belongs to that one. An outer table has
    two places of rules in either direction and more than one cell.
    """
    if not len(h) or not len(v):
        return []
    group = components(h, v)
    parts = [(h[group[: len(h)] == g], v[group[len(h) :] == g]) for g in np.unique(group)]
    boxes = [_box(*p) for p in parts]
    area = [(b[2] - b[0]) * (b[3] - b[1]) for b in boxes]
    order, outer = sorted(range(len(parts)), key=lambda i: -area[i]), []
    for i in order:
        # of boxes that hold this one the largest stands for all
        held = next((o for o in outer if area[o[0]] > area[i] and _within(boxes[i], boxes[o[0]])), None)
        if held:
            held.append(i)
        else:
            outer.append([i])
    tops = []
    for members in outer:
        hs, vs = (np.vstack([parts[i][k] for i in members]) for k in (0, 1))
        if len(_cuts(hs[:, 0])) < 2 or len(_cuts(vs[:, 0])) < 2:
            continue
        got = nested(hs, vs)
        if got and got[0][1].n_rows * got[0][1].n_cols > 1:
            tops.append(got)
    tops.sort(key=lambda g: (-g[0][1].box[3], g[0][1].box[0]))
    return [(f"{n}{name}", grid) for n, got in enumerate(tops) for name, grid in got]


def table_cells(strokes: DataFrame) -> DataFrame:
    """page, table, depth, row, col, tall, wide, x0, y0, x1, y1: the cells of all tables that strokes draw.

    ``table``: number on the page, for a table in a cell then the names of the cells
    (``0/2,1``); ``depth``: how many cells it lies in. Pages without tables have no
    rows. A page's rules are in one task.
    """

    def run(table: pa.Table) -> pa.Table:
        lines, axes = list(zip(*(table.column(c).to_pylist() for c in ("pos", "lo", "hi")), strict=True)), table.column("axis").to_pylist()
        h, v = (np.array(collinear([r for r, a in zip(lines, axes, strict=True) if a == axis]), float).reshape(-1, 3) for axis in "hv")
        rows = [(name, name.count("/"), *cell) for name, grid in page_tables(h, v) for cell in grid.cells]
        out = table.select(["page"]).take(pa.array(np.zeros(len(rows), np.int64)))
        for i, (c, kind) in enumerate(_CELL.items()):
            out = out.append_column(c, pa.array([r[i] for r in rows], kind))
        return out

    drawn = rules(strokes)
    page = drawn.schema["page"].dataType.simpleString()
    names = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double"}
    return drawn.groupBy("page").applyInArrow(run, ", ".join([f"page {page}", *[f"{c} {names[k]}" for c, k in _CELL.items()]]))


_CELL = {"table": pa.string(), "depth": pa.int32(), **dict.fromkeys(("row", "col", "tall", "wide"), pa.int32()), **dict.fromkeys(("x0", "y0", "x1", "y1"), pa.float64())}


def ruled_tables(strokes: DataFrame, frags: DataFrame) -> DataFrame:
    """page, table, depth, row, col, tall, wide, text: tables with what stands in their cells.

    ``frags``: page, frag, x0, y0, x1, y1, text. A fragment belongs to the innermost
    cell that holds its middle (on an edge, to the first); a cell's fragments are
    read from the top, then from the left, with spaces between. An empty cell has an
    empty text, a null text is empty.
    """
    cells = materialize(table_cells(strokes), "cells")  # read twice
    middle = frags.select("page", "frag", "text", "x0", "y0", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    place = F.struct("table", "row", "col")
    boxes = cells.select("page", "depth", place.alias("place"), *[F.col(c).alias(f"c{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = (F.col("mx") >= F.col("cx0")) & (F.col("mx") <= F.col("cx1")) & (F.col("my") >= F.col("cy0")) & (F.col("my") <= F.col("cy1"))
    # merged: Spark's estimates know nothing of exploded rows, so it would broadcast them
    one = middle.join(boxes.hint("merge"), "page").filter(inside).groupBy("page", "frag").agg(F.min(F.struct((-F.col("depth")).alias("d"), "place", "y0", "x0", "text")).alias("s"))
    texts = one.groupBy("page", F.col("s.place.table").alias("table"), F.col("s.place.row").alias("row"), F.col("s.place.col").alias("col")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("s.y0")).alias("y"), F.col("s.x0").alias("x"), "frag", F.coalesce("s.text", F.lit("")).alias("text")))).alias("f")
    )
    out = cells.join(texts.hint("merge"), ["page", "table", "row", "col"], "left")
    return out.select("page", "table", "depth", "row", "col", "tall", "wide", F.coalesce(F.array_join(F.transform("f", lambda x: x["text"]), " "), F.lit("")).alias("text"))
