"""Row-set algebra and keyed look-ups: page sets, upserts, names, limits, substitution, tolerance matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.ranking import global_row_number


def merge(docs: list[DataFrame]) -> DataFrame:
    """Pages of several documents one after another, numbered anew: source, page, new_page. Inputs: page (from 1).

    Numbers come from ranges of pages, so no task sees all pages of a document.
    """
    rows = reduce(DataFrame.unionByName, [d.select("page").withColumn("source", F.lit(i)) for i, d in enumerate(docs)])
    return global_row_number(rows, "source", "page", name="new_page").select("source", "page", "new_page")


def insert(pages: DataFrame, at: int, new: DataFrame) -> DataFrame:
    """Pages (page) with ``new`` (page) put in before page ``at``: source (0 old, 1 new), page, new_page."""
    n = new.agg(F.count("*").alias("n"))  # one row
    old = pages.select("page").crossJoin(F.broadcast(n)).select(F.lit(0).alias("source"), "page", (F.col("page") + F.when(F.col("page") >= at, F.col("n")).otherwise(0)).alias("new_page"))
    more = global_row_number(new.select("page"), "page", name="new_page").select(F.lit(1).alias("source"), "page", (F.col("new_page") + at - 1).alias("new_page"))
    return old.unionByName(more)


def extract(pages: DataFrame, wanted: list[int]) -> DataFrame:
    """The given pages in the given order, with new_page; a page may be named twice, one that is not there is left out."""
    order = pages.sparkSession.createDataFrame([(p, i + 1) for i, p in enumerate(wanted)], "page long, new_page long")
    return pages.join(F.broadcast(order), "page")


def remove(pages: DataFrame, gone: list[int]) -> DataFrame:
    """Pages without the given ones, numbered anew: page, new_page.

    A page moves up by the number of removed pages before it.
    """
    drop = sorted(set(gone))
    before = F.size(F.filter(F.array(*[F.lit(p) for p in drop]), lambda p: p < F.col("page")))
    return pages.filter(~F.col("page").isin(drop)).withColumn("new_page", (F.col("page") - before).cast("long"))


def split(pages: DataFrame, size: int) -> DataFrame:
    """Parts of ``size`` pages: page, part, new_page."""
    k = F.col("page") - 1
    return pages.withColumn("part", F.floor(k / size) + 1).withColumn("new_page", k % size + 1)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with rows of ``changes`` in place of those of equal keys, and the others added; column ``change`` says which."""
    b = base.select(*keys, F.struct(*[c for c in base.columns if c not in keys]).alias("b"))
    c = changes.select(*keys, F.struct(*[x for x in base.columns if x not in keys]).alias("c"))
    out = b.join(c, keys, "full")
    kind = F.when(F.col("c").isNull(), "kept").when(F.col("b").isNull(), "added").otherwise("replaced")
    return out.select(*keys, F.coalesce("c", "b").alias("r"), kind.alias("change")).select(*keys, "r.*", "change")


def resolve_names(wanted: DataFrame, first: DataFrame, then: DataFrame) -> DataFrame:
    """name, target: from the first table, else from the second, else null. Of equal names the least target counts."""
    one = lambda df, c: df.groupBy("name").agg(F.min("target").alias(c))
    return wanted.join(one(first, "t1"), "name", "left").join(one(then, "t2"), "name", "left").select("name", F.coalesce("t1", "t2").alias("target"))


def first_of_each(rows: DataFrame, payload: Column, order: str) -> DataFrame:
    """The first row of each payload."""
    return rows.groupBy(F.sha2(payload, 256).alias("_k")).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def over_limits(rows: DataFrame, limits: dict[str, tuple[Column, int | None]], key: str) -> DataFrame:
    """key, limit, value: one row for each bound that a row passes. Reaching a bound is allowed; None is no bound."""
    tests = [F.when(value > bound, F.struct(F.lit(name).alias("limit"), value.cast("long").alias("value"))) for name, (value, bound) in limits.items() if bound is not None]
    out = rows.select(key, F.explode(F.array_compact(F.array(*tests))).alias("x"))
    return out.select(key, "x.limit", "x.value")


def substitute(wanted: DataFrame, faces: DataFrame) -> DataFrame:
    """name, face: of the faces of a family the nearest in weight, upright before slanted where asked, ties by name.

    ``wanted``: name, family, weight. ``faces``: face, family, weight. Families are compared without case and white space.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), r"[\s_-]+", "")
    w = wanted.select("name", plain(F.col("family")).alias("k"), F.col("weight").alias("ww"))
    f = faces.select("face", plain(F.col("family")).alias("k"), F.col("weight").alias("fw"))
    best = w.join(f, "k").groupBy("name").agg(F.min(F.struct(F.abs(F.col("ww") - F.col("fw")).alias("d"), "face")).alias("s"))
    return w.join(best, "name", "left").select("name", F.col("s.face").alias("face"))


def fill_under(cells: DataFrame, fills: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """cell_id, color: the last fill whose four edges each lie within the tolerance of the cell's.

    Both sides are rounded to a grid of the tolerance; a fill is looked for in the
    neighbouring steps of one corner, so the join is on equal keys.
    """
    edges = ("x0", "y0", "x1", "y1")
    step = lambda c: F.floor(F.col(c) / tolerance)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    c = cells.select("cell_id", *edges, step("x0").alias("i"), step("y0").alias("j"))
    f = fills.select("color", "position", *[F.col(e).alias(f"f{e}") for e in edges]).withColumn("di", F.explode(near)).withColumn("dj", F.explode(near))
    f = f.withColumns({"i": F.floor(F.col("fx0") / tolerance) + F.col("di"), "j": F.floor(F.col("fy0") / tolerance) + F.col("dj")}).drop("di", "dj")
    close = reduce(lambda a, b: a & b, [F.abs(F.col(e) - F.col(f"f{e}")) <= tolerance for e in edges])
    hit = c.join(f, ["i", "j"]).filter(close).groupBy("cell_id").agg(F.max_by("color", "position").alias("color"))
    return cells.select("cell_id").join(hit, "cell_id", "left")


def dominant(rows: DataFrame, group: str, value: str, weight: str, order: str) -> DataFrame:
    """group, dominant: the value of the greatest weight, ties to the one seen first, then to the larger."""
    h = rows.groupBy(group, value).agg(F.sum(weight).alias("w"), F.min(order).alias("o"))
    return h.groupBy(group).agg(F.max_by(value, F.struct("w", (-F.col("o")).alias("o"), value)).alias("dominant"))


def evaluate_rules(values: DataFrame, rules: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """field, status: ``rejected`` by the first rule (in order) that fails, ``unrecognised`` for a rule without a check, else ``ok``.

    ``values``: field, value. ``rules``: field, position, rule. ``checks``: rule -> condition on ``value``.
    """
    ok = F.lit(None).cast("boolean")
    for name, condition in checks.items():
        ok = F.when(F.col("rule") == name, condition).otherwise(ok)
    verdict = F.when(F.col("rule").isNull(), "ok").when(~F.col("rule").isin(list(checks)), "unrecognised").when(F.coalesce(ok, F.lit(False)), "ok").otherwise("rejected")
    out = values.join(rules, "field", "left").select("field", F.coalesce("position", F.lit(0)).alias("p"), verdict.alias("v"))
    bad = F.min(F.when(F.col("v") != "ok", F.struct(F.when(F.col("v") == "rejected", 0).otherwise(1).alias("c"), "p", "v")))
    return out.groupBy("field").agg(bad.alias("b")).select("field", F.coalesce("b.v", F.lit("ok")).alias("status"))
