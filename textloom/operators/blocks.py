"""Lines of placed text as headings, paragraphs, list items and code: what a line is depends on those around it.

All of it is windows over one page's lines in order: what stands before and behind is
``lag`` and ``lead``; a list that is open is a running minimum since its last item.

``lines``: doc, page, line (in reading order), x0, x1, y0 (its base, upwards), size,
text, bold, mono. Nulls in text are empty, in bold and mono false; a line with a null
place or size is left out. A page is a window's group, which spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import marker

# How much larger a heading's size is, how wide a gap parts blocks (in
# sizes), what part of the widest line a heading takes at most, and its gap in leadings.
LARGER = 0.5
GAP = 1.5
NARROW = 0.6
LEAD = 1.2


def _page():
    return Window.partitionBy("doc", "page").orderBy("line")


def _block():
    return Window.partitionBy("doc", "page", "block")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _tolerance() -> Column:
    return F.greatest(F.lit(3.0), 0.5 * F.col("_body"))


def text_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` with ``block``, numbered from 0 on each page: another one begins behind a gap or where the size changes."""
    fine = lines.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("x0", "x1", "y0", "size")))
    fine = fine.withColumns({"text": F.coalesce("text", F.lit("")), "bold": _true(F.col("bold")), "mono": _true(F.col("mono"))})
    page = _page()
    before, size = F.lag("y0").over(page), F.lag("size").over(page)
    begins = _true((before - F.col("y0") > GAP * F.greatest("size", size)) | (before < F.col("y0")) | (F.abs(size - F.col("size")) > LARGER))
    return fine.withColumn("_begins", begins.cast("int")).withColumn("block", F.sum("_begins").over(page)).drop("_begins")


def _sizes(lines: DataFrame) -> DataFrame:
    """doc, _body (the size of most characters, ties to the larger), _larger (sizes above it, the largest first)."""
    n = lines.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("n"))
    per = n.groupBy("doc").agg(F.max_by("size", F.struct("n", "size")).alias("_body"), F.sort_array(F.collect_set("size"), False).alias("all"))
    return per.select("doc", "_body", F.filter("all", lambda s: s > F.col("_body") + LARGER).alias("_larger"))


def classify(lines: DataFrame) -> DataFrame:
    """``lines`` with block, kind (code, item, continuation, heading, text), level and length (of an item's marker).

    An item is a line with a marker beside another one, or over a line that stands
    where its own words begin; ``level`` is its depth: the places of a block's
    markers, those within the tolerance as one. Lines below an item that stand where
    its words begin go on with it until one doesn't. A heading is larger than the
    body (level: rank of its size), or a short line with a gap above and body text
    below that starts where it does, if it is bold, in capitals, or ends without a
    stop; such a heading is one level below the larger ones. No level exceeds 6.
    """
    page, order = _page(), _block().orderBy("line")
    held = text_blocks(lines)
    held = held.join(_sizes(held), "doc").withColumn("_m", F.when(~F.col("mono"), marker(F.col("text"))))
    share = F.col("_m.length") / F.greatest(F.length("text"), F.lit(1))
    held = held.withColumns({"_marked": F.col("_m.length").isNotNull(), "_body_x": F.col("x0") + (F.col("x1") - F.col("x0")) * share})
    under = ~F.lead("mono").over(order) & (F.abs(F.lead("x0").over(order) - F.col("_body_x")) <= _tolerance())
    beside = _true(F.lag("_marked").over(order)) | _true(F.lead("_marked").over(order)) | _true(under)
    held = held.withColumn("_item", F.col("_marked") & beside)

    places = F.sort_array(F.collect_set(F.when(F.col("_item"), F.col("x0"))).over(_block()))
    steps = F.aggregate(places, F.array().cast("array<double>"), lambda got, x: F.when((F.size(got) == 0) | (x - F.element_at(got, -1) > _tolerance()), F.concat(got, F.array(x.cast("double")))).otherwise(got))
    held = held.withColumn("_steps", F.when(F.col("_item"), steps))
    depth = F.greatest(F.size(F.filter("_steps", lambda b: F.col("x0") >= b - _tolerance())) - 1, F.lit(0))

    opens = F.col("_item") | F.col("mono")
    held = held.withColumn("_part", F.sum(opens.cast("int")).over(order))
    part = Window.partitionBy("doc", "page", "block", "_part").orderBy("line")
    held = held.withColumns({"_open": F.first("_item").over(part), "_at": F.first("_body_x").over(part)})
    held = held.withColumn("_aligned", opens | _true(F.abs(F.col("x0") - F.col("_at")) <= _tolerance()))
    goes_on = ~opens & F.col("_open") & F.min("_aligned").over(part)

    gaps = held.select("doc", "page", (F.lag("y0").over(order) - F.col("y0")).alias("g")).filter("g > 0").groupBy("doc", "page").agg(F.expr("percentile_disc(0.500000000001D) WITHIN GROUP (ORDER BY g)").alias("_leading"))
    wide = F.max(F.col("x1") - F.col("x0")).over(Window.partitionBy("doc", "page"))
    held = held.withColumns({"_goes_on": goes_on, "_wide": wide, "_above": F.lag("y0").over(page), "_next_x": F.lead("x0").over(page), "_next_size": F.lead("size").over(page)}).join(gaps, ["doc", "page"], "left")
    leading = F.coalesce("_leading", F.col("_body") * LEAD)
    words = F.btrim("text")
    alone = (F.col("x1") - F.col("x0") < NARROW * F.col("_wide")) & F.coalesce(F.col("_above") - F.col("y0") >= LEAD * leading, F.lit(True))
    alone = alone & _true((F.abs(F.col("_next_x") - F.col("x0")) <= _tolerance()) & (F.col("_next_size") <= F.col("_body") + LARGER))
    letters = F.length(F.regexp_replace(words, r"\P{L}", ""))
    loud = F.col("bold") | ((letters >= 2) & (words == F.upper(words))) | ~words.rlike(r"[.,]$")
    larger = F.col("size") > F.col("_body") + LARGER
    kind = F.when(F.col("mono"), "code").when(F.col("_item"), "item").when(F.col("_goes_on"), "continuation").when(larger | (alone & loud), "heading").otherwise("text")
    rank = F.when(larger, F.array_position("_larger", F.col("size"))).otherwise(F.size("_larger") + 1)
    held = held.withColumn("kind", kind)
    level = F.when(F.col("kind") == "item", depth).when(F.col("kind") == "heading", F.least(rank, F.lit(6))).otherwise(0).cast("int")
    names = [c for c in lines.columns if c not in ("block", "kind", "level", "length")]
    return held.select(*[F.col(f"`{c}`") for c in names], "block", "kind", level.alias("level"), F.when(F.col("_item"), F.col("_m.length")).otherwise(0).alias("length"))


def document_blocks(lines: DataFrame) -> DataFrame:
    """doc, ordinal (from 0), kind (code, item, heading, paragraph), level, n_lines, text: blocks as the exports take them.

    Lines of one kind and level in one block are one, an item takes the lines that go
    on with it and loses its marker; lines are joined by spaces, those of code by line
    ends. An item's level is its indentation.
    """
    c = classify(lines)
    key = F.struct("page", "block", "kind", "level")
    w = Window.partitionBy("doc").orderBy("page", "line")
    same = (F.col("kind") == "continuation") | _true((F.col("kind") != "item") & (F.lag(key).over(w) == key))
    c = c.withColumn("_begins", (~same).cast("int")).withColumn("ordinal", F.sum("_begins").over(w) - 1)
    piece = F.btrim(F.expr("substring(text, length + 1)"))
    said = F.when(F.col("kind") == "code", F.col("text")).otherwise(piece)
    out = c.groupBy("doc", "ordinal").agg(
        F.min_by(F.struct("kind", "level"), F.struct("page", "line")).alias("k"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("page", "line", said.alias("text")))).alias("s")
    )
    texts = F.transform("s", lambda x: x["text"])
    joined = F.when(F.col("k.kind") == "code", F.array_join(texts, "\n")).otherwise(F.array_join(texts, " "))
    kind = F.when(F.col("k.kind") == "text", "paragraph").otherwise(F.col("k.kind"))
    level = F.when(kind == "item", F.col("k.level") * 2).otherwise(F.col("k.level")).cast("int")
    return out.select("doc", F.col("ordinal").cast("int").alias("ordinal"), kind.alias("kind"), level.alias("level"), "n_lines", joined.alias("text"))
