"""Rules over document features: header links, visibility, forms, types, removals. Rows in, findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import word_pattern
from textloom.operators.tables import default_scope

#: Structure types of the older and the newer namespace (fixed values).
STANDARD_TYPES = "Document Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody Table TR TH TD THead TBody TFoot Span Quote Note Reference BibEntry Code Link Annot Ruby RB RT RP Warichu WT WP Figure Formula Form".split()
NEWER_TYPES = "Document Part Div Caption Sect NonStruct H P L LI Lbl LBody Table TR TH TD THead TBody TFoot Span Link Annot Figure Formula Form Ruby RB RT RP Warichu WT WP DocumentFragment Aside Title FENote Sub Em Strong Artifact".split()
OLDER_NS, NEWER_NS, MATH_NS = "http://iso.org/pdf/ssn", "http://iso.org/pdf2/ssn", "http://www.w3.org/1998/Math/MathML"

#: Elements that are drawn in part (fixed values); mathematics is left out whole.
DEGRADED_ELEMENTS = ["video", "audio", "canvas", "textarea", "button"]

#: Form fields whose value can be set (fixed values).
SETTABLE = ["text", "checkbox", "radio", "choice"]

#: Keys of an annotation that carry text, in the order they are searched (fixed values).
TEXT_KEYS = ["Contents", "RC", "T", "Subj"]


def is_standard_type(name: Column, namespace: Column) -> Column:
    """Whether a structure type is a standard one of its namespace; none stated is the older; of mathematics all are; of others none."""
    newer = name.isin(NEWER_TYPES) | name.rlike("^H[1-9][0-9]*$")
    return F.when(namespace.isNull() | (namespace == OLDER_NS), name.isin(STANDARD_TYPES)).when(namespace == NEWER_NS, newer).otherwise(namespace == MATH_NS)


def element_policy(name: Column, namespace: Column) -> Column:
    """How an element's content is treated: suppress, degraded, or null (rendered)."""
    return F.when(namespace == "math", "suppress").when(name.isin(DEGRADED_ELEMENTS), "degraded")


def header_gaps(cells: DataFrame) -> DataFrame:
    """table, row, col, unknown: the first data cell of each table that no header is linked with, and the header ids it names in vain.

    ``cells``: table, row, col, row_span, col_span, is_header, scope, id, headers
    (array<string>). A cell is linked by the ids it names, if all are declared, or
    by the nearest run of headers above it (scope Column or Both) or to its left
    (Row or Both), in any column or row it covers. Irregular tables, tables whose
    headers all state a scope, and the corner cell are passed over.
    """
    slots = cells.withColumn("r", F.explode(F.expr("sequence(row, row + row_span - 1)"))).withColumn("c", F.explode(F.expr("sequence(col, col + col_span - 1)")))
    size = slots.groupBy("table").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count("*").alias("n"), F.count_distinct("r", "c").alias("places"))
    heads = cells.filter("is_header").groupBy("table").agg(F.bool_and(F.col("scope").isNotNull()).alias("scoped"), F.collect_set(F.when(F.col("id") != "", F.col("id"))).alias("ids"))
    # Spark's estimates know nothing of exploded rows, so they would be broadcast
    gate = size.filter("n = places AND n = rows * cols").join(heads.hint("merge"), "table", "left").filter(~F.coalesce("scoped", F.lit(True))).select("table", "ids")
    slots = slots.join(gate.hint("merge"), "table").withColumn("s", F.coalesce("scope", default_scope(F.col("r"), F.col("c"))))

    def near(by: list[str], along: str, want: str) -> tuple[Column, Column]:
        """The number of the run of headers last begun before or at a slot; whether the slot is a header of the wanted scope."""
        order = Window.partitionBy("table", *by).orderBy(along)
        begins = F.col("is_header") & ~F.coalesce(F.lag("is_header").over(order), F.lit(False))
        return F.sum(begins.cast("int")).over(order), F.col("is_header") & F.col("s").isin("Both", want)

    run_up, up = near(["c"], "r", "Column")
    run_left, left = near(["r"], "c", "Row")
    slots = slots.withColumns({"run_up": run_up, "up": up, "run_left": run_left, "left": left})
    slots = slots.withColumns({
        "by_column": (F.col("run_up") > 0) & F.bool_or("up").over(Window.partitionBy("table", "c", "run_up")) & (F.col("r") == F.col("row")),
        "by_row": (F.col("run_left") > 0) & F.bool_or("left").over(Window.partitionBy("table", "r", "run_left")) & (F.col("c") == F.col("col")),
    })
    unknown = F.array_except(F.coalesce("headers", F.expr("cast(array() as array<string>)")), "ids")
    linked = F.bool_or(F.col("by_column") | F.col("by_row")) | F.bool_or((F.size(F.coalesce("headers", F.expr("cast(array() as array<string>)"))) > 0) & (F.size(unknown) == 0))
    data = slots.filter("NOT is_header AND NOT (row = 0 AND col = 0)").groupBy("table", "row", "col").agg(linked.alias("linked"), F.first(unknown).alias("unknown"))
    first = data.filter("NOT linked").groupBy("table").agg(F.min(F.struct("row", "col", "unknown")).alias("s"))
    return first.select("table", "s.row", "s.col", "s.unknown")


def visible(items: DataFrame, layers: DataFrame, members: DataFrame) -> DataFrame:
    """item, visible: an item in a group is visible as the group's policy says of its layers; else as its layer is; without either always.

    ``items``: item, layer, group. ``layers``: layer, shown (null: no state, shown).
    ``members``: group, policy (AllOn, AnyOn, AnyOff, AllOff; null: AnyOn), layer. A
    group without layers is visible.
    """
    state = layers.select("layer", F.coalesce("shown", F.lit(True)).alias("on"))
    on = members.join(state, "layer", "left").withColumn("on", F.coalesce("on", F.lit(True))).groupBy("group").agg(F.first("policy", True).alias("policy"), F.bool_and("on").alias("all_on"), F.bool_or("on").alias("any_on"))
    by_group = F.when(F.col("policy") == "AllOn", F.col("all_on")).when(F.col("policy") == "AnyOff", ~F.col("all_on")).when(F.col("policy") == "AllOff", ~F.col("any_on")).otherwise(F.col("any_on"))
    out = items.join(on.select("group", by_group.alias("by_group")), "group", "left").join(state.withColumnRenamed("on", "by_layer"), "layer", "left")
    return out.select("item", F.coalesce("by_group", "by_layer", F.lit(True)).alias("visible"))


def collect_form(fields: DataFrame, include_empty: bool = False) -> DataFrame:
    """name, kind, values of the fields that can be set; without those that hold nothing or ``Off``, unless asked for.

    ``fields``: name, kind, values (array<string>), checked (of a checkbox), on
    (its state's name).
    """
    box = F.when(F.col("kind") == "checkbox", F.array(F.when(F.coalesce("checked", F.lit(False)), F.coalesce("on", F.lit("Yes"))).otherwise("Off"))).otherwise(F.coalesce("values", F.expr("cast(array() as array<string>)")))
    out = fields.filter(F.col("kind").isin(SETTABLE)).select("name", "kind", box.alias("values"))
    empty = F.forall("values", lambda v: v.isNull() | (v == "") | (v == "Off"))
    return out if include_empty else out.filter(~empty)


def normalize_options(options: Column) -> Column:
    """Options (array of export, display) with the export for a missing display; null if an export is empty or occurs twice."""
    full = F.transform(options, lambda o: F.struct(o["export"].alias("export"), F.coalesce(o["display"], o["export"]).alias("display")))
    names = F.transform(options, lambda o: o["export"])
    ok = F.forall(names, lambda n: n.isNotNull() & (n != "")) & (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(ok, full)


def type_mismatches(properties: DataFrame, own: DataFrame, main: DataFrame, predefined: DataFrame, valid: Column) -> DataFrame:
    """doc, ns, name, type: properties whose value doesn't fit the type that the document, the main packet or the table declares, in this order.

    ``properties``: doc, ns, name, value. ``own``: doc, ns, name, type. ``main`` and
    ``predefined``: ns, name, type. ``valid``: a condition on ``value`` and ``type``.
    """
    out = properties.join(own.withColumnRenamed("type", "t1"), ["doc", "ns", "name"], "left").join(main.withColumnRenamed("type", "t2"), ["ns", "name"], "left").join(predefined.withColumnRenamed("type", "t3"), ["ns", "name"], "left")
    out = out.withColumn("type", F.coalesce("t1", "t2", "t3")).filter(F.col("type").isNotNull())
    return out.filter(~F.coalesce(valid, F.lit(False))).select("doc", "ns", "name", "type")


def sanitize(objects: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays, a report): objects of the given categories go; documents that are signed are left alone.

    ``objects``: doc, object, category, parent. Popups go and stay with their
    parent. The report has doc, category, removed (0 where there was nothing) for
    every asked category of a document, and ``refused`` for signed ones.
    """
    signed = objects.filter("category = 'signature'").select("doc").distinct().withColumn("signed", F.lit(True))
    parent = objects.select("doc", F.col("object").alias("parent"), F.col("category").alias("parent_category"))
    held = objects.join(signed, "doc", "left").join(parent, ["doc", "parent"], "left")
    kind = F.when(F.col("category") == "popup", F.coalesce("parent_category", F.lit("annotation"))).otherwise(F.col("category"))
    held = held.withColumn("gone", F.col("signed").isNull() & kind.isin(categories)).withColumn("kind", kind)
    docs = objects.select("doc").distinct().join(signed, "doc", "left")
    asked = docs.select("doc", F.coalesce("signed", F.lit(False)).alias("refused"), F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    removed = held.filter("gone").groupBy("doc", F.col("kind").alias("category")).agg(F.count("*").alias("removed"))
    report = asked.join(removed, ["doc", "category"], "left").select("doc", "category", "refused", F.coalesce("removed", F.lit(0)).alias("removed"))
    return held.filter("NOT gone").select(*objects.columns), report


#: Changes that each level of a certified document admits (fixed values).
ADMITTED = {1: [], 2: ["form", "signature"], 3: ["form", "signature", "annotation"]}


def change_verdicts(levels: DataFrame, changes: DataFrame) -> DataFrame:
    """doc, verdict: allowed or refused, by the level (1 to 3; null: not certified, all is allowed). ``levels``: doc, level. ``changes``: doc, kind."""
    ok = F.lit(False)
    for level, kinds in ADMITTED.items():
        ok = F.when(F.col("level") == level, F.col("kind").isin(kinds) if kinds else F.lit(False)).otherwise(ok)
    worst = levels.join(changes, "doc").groupBy("doc").agg(F.bool_and(F.col("level").isNull() | ok).alias("ok"))
    return levels.select("doc").join(worst, "doc", "left").select("doc", F.when(F.coalesce("ok", F.lit(True)), "allowed").otherwise("refused").alias("verdict"))


def search_carried_text(annotations: DataFrame, find: str) -> DataFrame:
    """annot, key, start, end: places of a literal in the texts that annotations carry, hidden ones too. ``annotations``: annot, texts (map)."""
    rows = annotations.select("annot", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(i).alias("o")) for i, k in enumerate(TEXT_KEYS)])).alias("k"), "texts")
    rows = rows.select("annot", "k.key", F.try_element_at("texts", "k.key").alias("value")).filter("value <> ''")
    # the lengths of what stands between the places, and a running sum over them
    p = word_pattern(find)
    gaps = rows.filter(F.col("value").contains(find)).select("annot", "key", F.posexplode(F.transform(F.split("value", p), F.char_length)).alias("i", "gap"), F.size(F.split("value", p)).alias("n"))
    upto = Window.partitionBy("annot", "key").orderBy("i")
    start = F.sum("gap").over(upto) + F.col("i") * len(find)
    return gaps.withColumn("start", start).filter("i < n - 1").select("annot", "key", "start", (F.col("start") + len(find)).alias("end"))


def distinct_glyphs(glyphs: DataFrame) -> DataFrame:
    """Each glyph that is shown once: font, code, mode, mcid, artifact (missing marks: -1, false)."""
    return glyphs.select("font", "code", F.coalesce("mode", F.lit(0)).alias("mode"), F.coalesce("mcid", F.lit(-1)).alias("mcid"), F.coalesce("artifact", F.lit(False)).alias("artifact")).distinct()


def glyph_usage(fonts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """font, codes (sorted), complete: the codes each font is used for; fonts that nothing reaches have none and are not complete."""
    used = glyphs.groupBy("font").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return fonts.select("font").join(used, "font", "left").select("font", F.coalesce("codes", F.expr("cast(array() as array<bigint>)")).alias("codes"), F.col("codes").isNotNull().alias("complete"))


def page_features(items: DataFrame, features: dict[str, Column]) -> DataFrame:
    """page and how often each feature occurs on it, in one pass."""
    return items.groupBy("page").agg(*[F.count_if(c).alias(n) for n, c in features.items()])


def pair_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """page, old, new: pages of two documents side by side; a page that one side lacks is blank (null). Both: page, content."""
    return old.select("page", F.col("content").alias("old")).join(new.select("page", F.col("content").alias("new")), "page", "full")


def resolve_run(direct: Column, char: list[Column], para: list[Column], default: Column, toggle: bool) -> Column:
    """A run's property from its layers, nearest first. A toggle that isn't set directly is on if just one of its two style chains has it on."""
    if not toggle:
        return F.coalesce(direct, *char, *para, default)
    c, p = F.coalesce(*char, F.lit(None)), F.coalesce(*para, F.lit(None))
    styled = F.when(c.isNull() & p.isNull(), F.coalesce(default, F.lit(False))).otherwise(F.coalesce(p, F.lit(False)) != F.coalesce(c, F.lit(False)))
    return F.coalesce(direct, styled)


def prune_keys(entries: Column, drop: list[str]) -> Column:
    """A map without the given keys."""
    return F.map_filter(entries, lambda k, _: ~k.isin(drop))


def canonical(entries: Column) -> Column:
    """A map as text that doesn't depend on the order of its keys, and that no other map has.

    Blanks, equal signs and backslashes of keys and values are escaped; a null value
    has no equal sign, an empty one nothing after it.
    """
    plain = lambda c: F.regexp_replace(c, r"([\\ =])", r"\\$1")
    keys = F.array_sort(F.map_keys(entries))
    value = lambda k: plain(F.try_element_at(entries, k))
    return F.array_join(F.transform(keys, lambda k: F.concat(plain(k), F.coalesce(F.concat(F.lit("="), value(k)), F.lit("")))), " ")


def content_key(payload: Column, context: Column | None = None) -> Column:
    """The digest of a payload, and of what says how it is read, parted by a zero byte."""
    data = payload.cast("binary")
    return F.sha2(data if context is None else F.concat(context.cast("binary"), F.lit(b"\x00"), data), 256)


def with_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is not blank; an error when there is none."""
    out = rows.filter(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) != "")
    if out.isEmpty():
        raise ValueError("no row has any text")
    return out
