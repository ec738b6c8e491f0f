"""Computed styles of elements: a cascade inside each row, then inheritance by doubling.

Which rules reach an element is known from ``selectors`` (running aggregates over
pre-order intervals), as one list of rule numbers in its row. The winner of each
property is a maximum over (tier, specificity, order) in that row, so the cascade
shuffles nothing. What an element takes from above goes up the tree in log(depth)
joins: a font size as a factor on the size above, a weight as a table from the weight
above, the rest as the nearest value that stands on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import selectors
from textloom.operators.trees import climb
from textloom.scratch import materialize

# Initial values of the properties that are computed.
INHERITED = {
    "color": "#000000", "font-family": "serif", "font-style": "normal", "line-height": "normal", "text-align": "start", "text-indent": "0px",
    "white-space": "normal", "list-style-type": "disc", "list-style-position": "outside", "border-collapse": "separate", "border-spacing": "0px",
}
OWN = {
    "background-color": "transparent", "text-decoration": "none", "vertical-align": "baseline", "display": "inline", "float": "none", "clear": "none", "width": "auto", "height": "auto",
    **{f"{box}-{side}": "0px" for box in ("margin", "padding") for side in ("top", "right", "bottom", "left")},
    **{f"border-{side}-color": "currentcolor" for side in ("top", "right", "bottom", "left")},
}
SIZE = 16.0
SIZES = {"xx-small": 9.0, "x-small": 10.0, "small": 13.0, "medium": 16.0, "large": 18.0, "x-large": 24.0, "xx-large": 32.0}
STEP = 1.2
UNITS = {"px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "q": 2.4 / 2.54}
WEIGHT = 400
#: Weights below each of these, and above them all: what a bolder and a lighter text has.
WEIGHT_BOUNDS = (100, 350, 550, 750, 900)
BOLDER = (400, 400, 700, 900, 900, None)
LIGHTER = (None, 100, 100, 400, 700, 700)

#: Tiers of declarations, weakest first: of the program, of a sheet, of an element, then the important ones.
PROGRAM, AUTHOR, ELEMENT, AUTHOR_IMPORTANT, ELEMENT_IMPORTANT, PROGRAM_IMPORTANT = range(1, 7)

_BOXES = {"margin": "margin-{}", "padding": "padding-{}", "border-color": "border-{}-color"}
_SIDES = ("top", "right", "bottom", "left")
_COMMENT = re.compile(r"(?s)/\*.*?\*/")


@dataclass
class Rule:
    """Selectors of one specificity (parsed) with their declarations: (property, value, important)."""

    alternatives: list
    specificity: tuple[int, int, int]
    order: int
    program: bool
    declarations: list[tuple[str, str, bool]]


def declarations(text: str | None) -> list[tuple[str, str, bool]]:
    """(property, value, important) of a block; values of four sides become the sides' own, what cannot be read is left out."""
    out = []
    for part in re.findall(r"""(?:[^;"']|"[^"]*"|'[^']*')+""", _COMMENT.sub(" ", text or "")):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), " ".join(value.split())
        important = re.search(r"! ?important$", value, re.IGNORECASE)
        if important:
            value = value[: important.start()].rstrip()
        if not colon or not name or not value:
            continue
        if name not in _BOXES:
            out.append((name, value, bool(important)))
            continue
        top, *rest = value.split(" ")
        if len(rest) <= 3:
            right = rest[0] if rest else top
            bottom, left = rest[1] if len(rest) > 1 else top, rest[2] if len(rest) > 2 else right
            out += [(_BOXES[name].format(side), v, bool(important)) for side, v in zip(_SIDES, (top, right, bottom, left), strict=True)]
    return out


def specificity(steps: list) -> tuple[int, int, int]:
    """(ids, classes and the like, names) of one parsed alternative; ``:is``, ``:not`` and ``:has`` count as the greatest of theirs, ``:where`` not at all."""
    a = b = c = 0
    for _, tests in steps:
        for kind, what in tests:
            if kind == "id":
                a += 1
            elif kind == "name":
                c += what != "*"
            elif kind in ("not", "is", "has"):
                x, y, z = max(specificity(s) for s in what)
                a, b, c = a + x, b + y, c + z
            elif kind != "where":
                b += 1
    return a, b, c


def _without_at_rules(css: str) -> str:
    """The rules outside of blocks of ``@`` rules."""
    out, at = [], 0
    for m in re.finditer("@", css):
        if m.start() < at:
            continue
        out.append(css[at : m.start()])
        depth, at = 0, len(css)
        for p in re.finditer(r"[{};]", css[m.start() :]):
            depth += {"{": 1, "}": -1, ";": 0}[p[0]]
            if depth <= 0:
                at = m.start() + p.end()
                break
    return "".join([*out, css[at:]])


def sheet(css: str, program: bool = False, first: int = 0) -> list[Rule]:
    """The rules of a style sheet; alternatives of one specificity are one rule.

    A list with a part that cannot be read says nothing, as does a block behind
    ``@``. ``program``: of the program that shows pages, weaker than the author's.
    ``first``: the number of rules of the sheets before this one.
    """
    out: list[Rule] = []
    for prelude, block in re.findall(r"([^{}]*)\{([^{}]*)\}", _without_at_rules(_COMMENT.sub(" ", css))):
        try:
            parsed = selectors.parse(prelude)
        except ValueError:
            continue
        said, by = declarations(block), {}
        for steps in parsed:
            by.setdefault(specificity(steps), []).append(steps)
        out += [Rule(steps, key, first + len(out) + i, program, said) for i, (key, steps) in enumerate(by.items())]
    return out


# --- values ---------------------------------------------------------------------------------------

# Names of colours, and the words that a property takes.
COLORS = {
    "black": "#000000", "silver": "#c0c0c0", "gray": "#808080", "white": "#ffffff", "maroon": "#800000", "red": "#ff0000", "purple": "#800080", "fuchsia": "#ff00ff", "green": "#008000",
    "lime": "#00ff00", "olive": "#808000", "yellow": "#ffff00", "navy": "#000080", "blue": "#0000ff", "teal": "#008080", "aqua": "#00ffff", "orange": "#ffa500", "transparent": "transparent",
}
WORDS = {
    "font-style": "normal italic oblique", "text-align": "start end left right center justify", "white-space": "normal pre nowrap pre-wrap pre-line",
    "list-style-type": "disc circle square decimal lower-alpha upper-alpha lower-roman upper-roman none", "list-style-position": "inside outside", "border-collapse": "separate collapse",
    "text-decoration": "none underline overline line-through", "vertical-align": "baseline sub super top middle bottom text-top text-bottom",
    "display": "inline block inline-block list-item none table table-row-group table-header-group table-footer-group table-row table-cell table-caption",
    "float": "none left right", "clear": "none left right both",
}
_LENGTH = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))([a-z]*|%)$"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _measure(value: Column) -> Column:
    """number and unit of a length; null number for anything else."""
    return F.struct(F.regexp_extract(value, _LENGTH, 1).try_cast("double").alias("number"), F.regexp_extract(value, _LENGTH, 2).alias("unit"))


def _pixels(m: Column, size: Column, root: Column) -> Column:
    """Pixels of a measure; ``em`` and ``rem`` by the sizes given, ``ex`` half an ``em``; a bare number is a length if it is 0."""
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.when(m["unit"] == "", F.when(m["number"] == 0, 0.0)).when(m["unit"] == "em", m["number"] * size).when(m["unit"] == "ex", m["number"] * size / 2).when(m["unit"] == "rem", m["number"] * root).otherwise(m["number"] * F.try_element_at(units, m["unit"]))


_RGB = r"^rgb\( ?([0-9]{1,3}) ?, ?([0-9]{1,3}) ?, ?([0-9]{1,3}) ?\)$"


def color(value: Column) -> Column:
    """A colour as #rrggbb, or ``transparent``; null for anything else."""
    byte = lambda i: F.lpad(F.lower(F.hex(F.least(F.regexp_extract(value, _RGB, i).try_cast("long"), F.lit(255)))), 2, "0")
    named = F.create_map(*[F.lit(x) for pair in COLORS.items() for x in pair])
    return F.when(value.rlike("^#[0-9a-f]{6}$"), value).when(value.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(value, "([0-9a-f])", "$1$1")).when(value.rlike(_RGB), F.concat(F.lit("#"), byte(1), byte(2), byte(3))).otherwise(F.try_element_at(named, value))


def _px(value: Column) -> Column:
    return F.concat(F.round(value, 6).cast("string"), F.lit("px"))


def _kind(name: str) -> str:
    if name in WORDS:
        return "words"
    if name.endswith("color"):
        return "color"
    return {"font-family": "any", "line-height": "line", "border-spacing": "gap"}.get(name, "share" if name.startswith(("padding", "text-indent")) else "auto")


def _value(raw: Column, kind: Column, words: Column, signed: Column, size: Column, root: Column, shade: Column) -> Column:
    """The computed value of a property of a kind, null where the words are not its own."""
    v = F.lower(raw)

    def measured(m: Column) -> Column:
        fine = signed | (m["number"] >= 0)
        px, share = F.when(fine, _pixels(m, size, root)), F.when(fine & (m["unit"] == "%"), m["number"])
        line = F.when(v == "normal", v).when(m["unit"] == "", F.when(fine, m["number"].cast("string"))).otherwise(F.coalesce(_px(px), _px(share / 100 * size)))
        length = F.coalesce(_px(px), F.when(kind != "gap", F.concat(share.cast("string"), F.lit("%"))), F.when((kind == "auto") & (v == "auto"), v))
        return F.when(kind == "line", line).otherwise(length)

    tint = F.when(v == "currentcolor", shade).otherwise(color(v))
    return F.when(kind == "words", F.when(F.array_contains(words, v), v)).when(kind == "any", raw).when(kind == "color", tint).otherwise(_let(_measure(v), measured))


# --- cascade and inheritance ----------------------------------------------------------------------

_SAID = "array<struct<name:string,tier:int,a:int,b:int,c:int,place:int,value:string>>"
_KEYWORDS = ("inherit", "initial", "unset", "revert")


def _declared(rules: list[Rule]) -> Column:
    """The declarations that reach an element: those of its rules, then of its own attribute."""
    nothing = F.array().cast(_SAID)
    parts = []
    for k, r in enumerate(rules):
        normal, important = (PROGRAM, PROGRAM_IMPORTANT) if r.program else (AUTHOR, AUTHOR_IMPORTANT)
        a, b, c = r.specificity
        rows = [F.struct(*[F.lit(x) for x in (p, important if i else normal, a, b, c, r.order * 1000 + n, v)]) for n, (p, v, i) in enumerate(r.declarations)]
        if rows:
            parts.append(F.when(F.array_contains("_rules", k), F.array(*rows).cast(_SAID)).otherwise(nothing))
    own = F.transform("_own", lambda d, n: F.struct(d["name"], F.when(d["important"], ELEMENT_IMPORTANT).otherwise(ELEMENT), F.lit(0), F.lit(0), F.lit(0), n, d["value"])).cast(_SAID)
    return F.concat(*parts, F.coalesce(own, nothing))


def _winner(name: Column, most: int = PROGRAM_IMPORTANT) -> Column:
    held = F.filter("_said", lambda d: (d["name"] == name) & (d["tier"] <= most))
    return F.array_max(F.transform(held, lambda d: F.struct(d["tier"], d["a"], d["b"], d["c"], d["place"], d["value"])))["value"]


def _raws(names: list[str]) -> Column:
    """The winning words of properties, ``revert`` gone back to the program's own; null: nothing, or ``unset``."""

    def one(name: Column) -> Column:
        back = _let(_winner(name, PROGRAM), lambda b: F.when(~F.lower(b).isin(*_KEYWORDS), b))
        return _let(_winner(name), lambda w: F.when(F.lower(w) == "revert", back).when(F.lower(w) != "unset", w))

    return F.transform(F.array(*[F.lit(n) for n in names]), one)


def _attribute_declarations(nodes: DataFrame) -> Column:
    @F.pandas_udf("array<struct<name:string,value:string,important:boolean>>")
    def read(styles):
        import pandas as pd

        return pd.Series([None if s is None else [dict(zip(("name", "value", "important"), d, strict=True)) for d in declarations(s)] for s in styles])

    return read(F.col("attrs")["style"])


def _size(raw: Column, root: Column) -> Column:
    """A font size: pixels, or null and a factor on the size above."""

    def read(m: Column) -> Column:
        words = F.create_map(*[F.lit(x) for pair in {**SIZES, "initial": SIZE}.items() for x in pair])
        relative = m["unit"].isin("em", "ex", "%")
        px = F.coalesce(F.try_element_at(words, raw), F.when(~relative & (m["number"] >= 0), _pixels(m, F.lit(SIZE), root)))
        factor = F.when(raw == "smaller", 1 / STEP).when(raw == "larger", STEP).when(relative & (m["number"] >= 0), m["number"] / F.when(m["unit"] == "em", 1.0).when(m["unit"] == "ex", 2.0).otherwise(100.0))
        return F.struct(px.alias("px"), F.coalesce(factor, F.lit(1.0)).alias("factor"))

    return _let(_measure(raw), read)


def _weight(raw: Column) -> Column:
    """A weight for each class of the weight above; null: the same."""
    table = lambda ws: F.array(*[F.lit(w).cast("int") for w in ws])
    number = F.when(raw.rlike("^[0-9]+([.][0-9]*)?$"), raw.try_cast("double"))
    one = F.when(raw.isin("normal", "initial"), WEIGHT).when(raw == "bold", 700).when(number.between(1, 1000), number.cast("int"))
    return F.when(raw == "bolder", table(BOLDER)).when(raw == "lighter", table(LIGHTER)).otherwise(F.array_repeat(one, len(BOLDER)))


def _weight_through(low: Column, high: Column) -> Column:
    kind = lambda w: sum((F.when(w >= b, 1).otherwise(0) for b in WEIGHT_BOUNDS), F.lit(0))
    return F.transform(high, lambda w, i: F.coalesce(F.get(low, F.when(w.isNull(), i).otherwise(kind(w))), w))


def computed(nodes: DataFrame, rules: list[Rule], page: str = "page") -> DataFrame:
    """page, node, font_size, font_weight, style (map of the other properties): what each element shows.

    ``nodes``: as for ``selectors.select``; ``style`` in attrs holds an element's own
    declarations. Tiers go from the program's sheet over the author's and the
    element's own to the important ones, the author's first. ``inherit``,
    ``initial``, ``unset`` and ``revert`` are taken as they stand. Lengths are in
    pixels, shares stay shares, a line height without unit stays a number; ``em`` is
    the size above for a font size and the element's own for the rest, ``rem`` the
    first element's. Words that a property doesn't know count as none.

    Not read: variables, ``calc``, other shorthands than margin, padding and
    border-color, colour names beyond ``COLORS``. Null attributes are none; elements
    on a ring of parents have no style; a number given twice on a page is one
    element; an empty table gives no rows.
    """
    key, names = F.struct(page, "node"), [*INHERITED, *OWN]
    held = selectors.matched(nodes, [r.alternatives for r in rules], "_rules", page).withColumn("_own", _attribute_declarations(nodes))
    held = held.select(page, "node", "parent", _declared(rules).alias("_said"))
    up = F.when(F.col("parent").isNotNull(), F.struct(page, F.col("parent").alias("node")))
    held = materialize(held.select(page, "node", key.alias("_key"), up.alias("_up"), F.transform(_raws(["font-size", "font-weight", "color"]), F.lower).alias("_first"), _raws(names).alias("_raws")), "styles")
    size, weight, shade = (F.col("_first")[i] for i in range(3))
    top = _let(_size(size, F.lit(SIZE)), lambda z: F.coalesce(z["px"], z["factor"] * SIZE))
    held = held.withColumn("_root", F.first(top).over(selectors.in_order(page)))

    nearest = lambda low, high: F.coalesce(low, high)
    grown = lambda low, high: F.struct(F.coalesce(low["px"], high["px"] * low["factor"]).alias("px"), (low["factor"] * high["factor"]).alias("factor"))
    parts = {"size": _size(size, F.col("_root")), "weight": _weight(weight), "shade": F.when(shade == "initial", INHERITED["color"]).otherwise(color(shade))}
    above = climb(held, "_key", "_up", parts, {"size": grown, "weight": _weight_through, "shade": nearest})
    start = sum(WEIGHT >= b for b in WEIGHT_BOUNDS)
    above = above.select(
        F.col("node").alias("_key"), (F.col("root") == F.col("node")).alias("_top"), F.coalesce("size.px", F.col("size.factor") * SIZE).alias("font_size"),
        F.coalesce(F.get("weight", F.lit(start)), F.lit(WEIGHT)).alias("font_weight"), F.coalesce("shade", F.lit(INHERITED["color"])).alias("_shade"),
    )
    known = F.array(*[F.struct(
        F.lit(n).alias("name"), F.lit(_kind(n)).alias("kind"), F.lit(initial).alias("initial"), F.lit(n in OWN).alias("own"), F.lit(n.startswith(("margin", "text-indent"))).alias("signed"),
        F.array(*[F.lit(w) for w in WORDS.get(n, "").split()]).cast("array<string>").alias("words")) for n, initial in (INHERITED | OWN).items()])

    def given_value(raw: Column, p: Column) -> Column:
        start_value = F.when(p["initial"] == "currentcolor", F.col("_shade")).otherwise(p["initial"])
        word = F.coalesce(F.lower(raw), F.lit(""))
        got = F.when(word == "initial", start_value).when(word != "inherit", _value(raw, p["kind"], p["words"], p["signed"], F.col("font_size"), F.col("_root"), F.col("_shade")))
        got = F.when(p["name"] == "color", F.col("_shade")).otherwise(got)
        return F.when(F.col("_top") | (p["own"] & (word != "inherit")), F.coalesce(got, start_value)).otherwise(got)

    values = F.zip_with("_raws", known, given_value)
    both = held.dropDuplicates(["_key"]).join(above.hint("merge"), "_key")
    given = materialize(both.select("_key", "_up", "font_size", "font_weight", values.alias("_given")), "styles")
    filled = climb(given, "_key", "_up", {"given": F.col("_given")}, {"given": lambda low, high: F.zip_with(low, high, nearest)})
    style = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), "given")
    return given.select(F.col("_key").alias("node"), "font_size", "font_weight").join(filled.hint("merge"), "node").select(F.col(f"node.{page}").alias(page), "node.node", "font_size", "font_weight", style.alias("style"))


#: What a program shows without any sheet (fixed values, in part).
PROGRAM_SHEET = """
address, article, aside, blockquote, body, dd, div, dl, dt, figure, footer, form, h1, h2, h3, h4, h5, h6, header, hr, html, main, nav, ol, p, pre, section, ul { display: block }
li { display: list-item }
head, base, link, meta, script, style, title, template { display: none }
table { display: table; border-collapse: separate; text-indent: 0px } tr { display: table-row } td, th { display: table-cell } caption { display: table-caption }
thead { display: table-header-group } tbody { display: table-row-group } tfoot { display: table-footer-group }
body { margin: 8px } p, dl, pre { margin: 1em 0px } ol, ul { margin: 1em 0px; padding-left: 40px } ol { list-style-type: decimal } blockquote, figure { margin: 1em 40px } dd { margin-left: 40px }
h1 { font-size: 2em; margin: 0.67em 0px } h2 { font-size: 1.5em; margin: 0.83em 0px } h3 { font-size: 1.17em; margin: 1em 0px } h4 { margin: 1.33em 0px }
h5 { font-size: 0.83em; margin: 1.67em 0px } h6 { font-size: 0.67em; margin: 2.33em 0px } h1, h2, h3, h4, h5, h6, th { font-weight: bold } b, strong { font-weight: bolder }
i, em, cite, var, dfn, address { font-style: italic } u, ins { text-decoration: underline } s, del { text-decoration: line-through } small, sub, sup { font-size: smaller }
sub { vertical-align: sub } sup { vertical-align: super } pre { white-space: pre } pre, code, kbd, samp { font-family: monospace } th, caption { text-align: center }
"""
