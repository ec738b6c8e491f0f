"""Join-shaped operators: deltas, newest versions, as-of labels, bindings, imports, overlap, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.numbers import numeral
from textloom.plans.ranking import running_sum


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change: added, freed or replaced; equal rows are left out. Rows are compared by all other columns."""
    side = lambda df, name: df.select(F.col(key).alias("key"), F.struct(*[c for c in df.columns if c != key]).alias(name))
    both = side(old, "o").join(side(new, "n"), "key", "full")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "freed").when(~F.col("o").eqNullSafe(F.col("n")), "replaced")
    return both.select(F.col("key").alias(key), kind.alias("change")).filter(F.col("change").isNotNull())


def newest_wins(rows: DataFrame, key: str, version: list[str], tombstone: Column) -> DataFrame:
    """The newest row of each key; a key whose newest row is a tombstone is gone.

    An aggregate, not a window: a hot key is reduced before the shuffle.
    """
    top = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*version)).alias("r")).select("r.*")
    return top.filter(~F.coalesce(tombstone, F.lit(False)))


def budget_prefix(rows: DataFrame, group: str, order: str, size: Column, limit: int) -> DataFrame:
    """Rows of each group, in order, as long as their sizes fit into ``limit`` together; with the running sum ``used``."""
    return running_sum(rows, [group], [order], size, "used").filter(F.col("used") <= limit)


def label_asof(rows: DataFrame, index: Column, ranges: DataFrame, key: str | None = None) -> DataFrame:
    """``rows`` with the label of the last range that starts at or before the index.

    ``ranges``: start_index, style, prefix, start, and the document ``key`` if
    there is one. A document's ranges (fewer than its pages) meet its rows as one
    sorted array, so no join is by inequality.
    """
    packed = F.array_sort(F.collect_list(F.struct("start_index", "style", "prefix", "start"))).alias("_ranges")
    held = ranges.groupBy(*[key] if key else []).agg(packed)
    out = rows.join(held, key, "left") if key else rows.crossJoin(F.broadcast(held))  # one row
    out = out.withColumn("_r", F.try_element_at(F.filter("_ranges", lambda r: r["start_index"] <= index), F.lit(-1)))
    text = F.concat(F.coalesce("_r.prefix", F.lit("")), numeral(F.col("_r.style"), F.coalesce("_r.start", F.lit(1)) + index - F.col("_r.start_index")))
    return out.withColumn("label", F.when(F.col("_r").isNull(), (index + 1).cast("string")).otherwise(text)).drop("_r", "_ranges")


def bind_fields(fields: DataFrame, data: DataFrame) -> DataFrame:
    """field, value: the datum on the field's own path; for ``global`` fields else the first of its name; ``none`` gives null.

    ``fields``: field, name, path, match. ``data``: path, name, pos, value.
    """
    first = data.groupBy("name").agg(F.min_by("value", "pos").alias("by_name"))
    out = fields.join(data.groupBy("path").agg(F.min_by("value", "pos").alias("by_path")), "path", "left").join(first, "name", "left")
    value = F.when(F.col("match") == "none", None).when(F.col("match") == "global", F.coalesce("by_path", "by_name")).otherwise(F.col("by_path"))
    return out.select("field", value.alias("value"))


def import_report(entries: DataFrame, fields: DataFrame, has_form: Column | None = None) -> DataFrame:
    """name, status: imported, or the first reason against it.

    ``entries``: name, value. ``fields``: name, kind, settable, and ``choices``
    (array) where only listed values may be set. ``has_form``: a condition without
    columns; false refuses every entry.
    """
    out = entries.join(fields, "name", "left")
    number = F.col("value").try_cast("double")
    listed = F.lit(True) if "choices" not in fields.columns else F.col("choices").isNull() | F.array_contains("choices", F.col("value"))
    status = (
        F.when(~(F.lit(True) if has_form is None else has_form), "no form")
        .when(F.col("kind").isNull(), "no such field")
        .when(~F.col("settable"), "not settable")
        .when((F.col("kind") == "number") & F.col("value").isNotNull() & number.isNull(), "type mismatch")
        .when(~F.coalesce(listed, F.lit(True)), "not a choice")
        .otherwise("imported")
    )
    return out.select("name", status.alias("status"))


def sync_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """field, action: write, delete, skip; equal fields are left out. Both sides: field, value, readable."""
    s = source.select("field", F.col("value").alias("sv"), F.col("readable").alias("sr"))
    t = target.select("field", F.col("value").alias("tv"))
    both = s.join(t, "field", "full")
    action = F.when(F.col("sr") == F.lit(False), "skip").when(F.col("sv").isNull() & F.col("tv").isNotNull(), "delete").when(F.col("sv").isNotNull() & ~F.col("sv").eqNullSafe(F.col("tv")), "write")
    return both.select("field", action.alias("action")).filter(F.col("action").isNotNull())


def uncovered(boxes: DataFrame, regions: DataFrame, cell: float) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1) that meet no region (x0, y0, x1, y1).

    Both are dealt into grid cells of side ``cell``, so the join is on equal cells.
    """

    def cells(df: DataFrame, *keep: str) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        return df.select(*keep, "x0", "y0", "x1", "y1", F.explode(span("x0", "x1")).alias("cx")).withColumn("cy", F.explode(span("y0", "y1")))

    r = cells(regions).select("cx", "cy", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = cells(boxes, "id").join(r, ["cx", "cy"]).filter("x0 < rx1 AND rx0 < x1 AND y0 < ry1 AND ry0 < y1").select("id").distinct()
    return boxes.join(hit, "id", "left_anti")


def usage_report(items: DataFrame, uses: DataFrame, key: str, value: str) -> DataFrame:
    """All items with how often and how highly they are used; items never used are reported with 0 and incomplete."""
    u = uses.groupBy(key).agg(F.count("*").alias("uses"), F.max(value).alias("highest"))
    return items.select(key).join(u, key, "left").select(key, F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("highest", F.lit(0)).alias("highest"), F.col("uses").isNotNull().alias("complete"))


def prune_unused(resources: DataFrame, uses: DataFrame, veto: DataFrame) -> DataFrame:
    """Resources that nobody names; none at all if any row of ``veto`` is true (column ``veto``)."""
    if veto.agg(F.coalesce(F.bool_or("veto"), F.lit(False))).first()[0]:
        return resources.limit(0)
    return resources.join(uses, resources.columns[0], "left_anti")


def issue_report(rows: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """rule, severity, issues (rows that break the rule), passes (no issue, or a warning only).

    One pass over the rows: a rule is a sum, not a scan.
    """
    sums = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, (_, ok) in rules.items()])
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.col(n).alias("issues")) for n, (s, _) in rules.items()])).alias("x")).select("x.*")
    return out.withColumn("passes", (F.col("severity") != "error") | (F.col("issues") == 0))


def heading_ranks(rows: DataFrame, size: str, weight: str) -> DataFrame:
    """Sizes with their weight: the heaviest is the body; larger ones are headings 1 to 6 from the largest. size, weight, rank (0: body, null: smaller)."""
    h = rows.groupBy(F.col(size).alias("size")).agg(F.sum(weight).alias("weight"))
    body = h.agg(F.max_by("size", F.struct("weight", (-F.col("size")).alias("s"))).alias("b")).first()["b"]
    top = Window.orderBy(F.desc("size"))  # over the distinct sizes larger than the body's
    larger = h.filter(F.col("size") > F.lit(body)).withColumn("rank", F.least(F.dense_rank().over(top), F.lit(6)))
    rest = h.filter(F.col("size") <= F.lit(body)).withColumn("rank", F.when(F.col("size") == F.lit(body), 0))
    return larger.union(rest)


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, median: the element at floor(n / 2) of the sorted values, never between two.

    That is the first value that more than half of the values don't exceed; values
    are counted map-side.
    """
    return rows.groupBy(group).agg(F.expr(f"percentile_disc(0.500000000001D) WITHIN GROUP (ORDER BY `{value}`)").alias("median"))


def modal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, mode: the most frequent value, ties to the larger."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.max_by(value, F.struct("n", value)).alias("mode"))


def chapters(rows: DataFrame, group: str, order: str, level: str) -> DataFrame:
    """``rows`` with ``chapter``: how many headings of the shallowest level of their group came up to here."""
    w = Window.partitionBy(group).orderBy(order)
    top = F.min(level).over(Window.partitionBy(group))
    return rows.withColumn("_top", top).withColumn("chapter", F.sum(F.when(F.col(level) == F.col("_top"), 1).otherwise(0)).over(w)).drop("_top")
