"""Selectors over a table of elements: combinators are running aggregates over pre-order intervals.

An element's descendants are the elements whose numbers lie above its own and not
above its ``last``. So "has an ancestor that matches A" says: the greatest ``last`` of
the matching elements before it is not below its own number, one running maximum; and
``:has`` is the same from the other end. Siblings are windows over one parent, children
an equi-join with it. No pair of elements is ever made, so a page of n elements costs
n log n for each combinator, however often its parts match.

``nodes``: ``page``, node (numbers in document order), parent, last, name, attrs
(map of lower-case names). A null name or map matches no test that asks for it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""\s*(?P<comma>,)\s*|\s*(?P<close>\))|\s*(?P<comb>[>+~])\s*|(?P<space>\s+)|(?P<name>\*|[\w-]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*(?P<fold>[iI])?\s*)?\]
    |:(?P<call>not|is|where|has)\(\s*|:(?P<nth>nth-child|nth-last-child)\(\s*(?P<formula>[^)]*?)\s*\)|:(?P<plain>first-child|last-child|only-child|root)\b""",
    re.VERBOSE,
)


def parse(selector: str) -> list[list[tuple[str, list]]]:
    """Alternatives of steps (combinator, tests); the first combinator of ``:has`` may be any, elsewhere it is ' '."""
    out, at = _alternatives(selector.strip(), 0, False)
    if at != len(selector.strip()):
        raise ValueError(f"unexpected ')' in selector {selector!r}")
    return out


def _alternatives(s: str, at: int, inside: bool):
    out, steps, tests, comb = [], [], [], " "

    def close():
        if not tests:
            raise ValueError(f"empty part in selector {s!r}")
        steps.append((comb, list(tests)))
        tests.clear()

    while at < len(s):
        m = _TOKEN.match(s, at)
        if not m:
            raise ValueError(f"cannot read selector {s!r} at {at}")
        at = m.end()
        g = m.groupdict()
        if g["comma"] or g["close"]:
            close()
            out.append(list(steps))
            steps, comb = [], " "
            if g["close"]:
                if not inside:
                    return out, m.start()
                return out, at
        elif g["comb"] or g["space"]:
            if tests:
                close()
            elif steps or not inside:
                raise ValueError(f"two combinators in selector {s!r}")
            comb = g["comb"] or " "
        elif g["call"]:
            inner, at = _alternatives(s, at, True)
            tests.append((g["call"], inner))
        elif g["nth"]:
            tests.append((g["nth"], _formula(g["formula"])))
        elif g["plain"]:
            tests.append((g["plain"], None))
        elif g["attr"]:
            value = next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), None)
            tests.append(("attr", (g["attr"].lower(), g["op"], value, bool(g["fold"]))))
        else:
            kind = next(k for k in ("name", "id", "cls") if g[k])
            tests.append((kind, g[kind]))
    if inside:
        raise ValueError(f"missing ')' in selector {s!r}")
    close()
    out.append(steps)
    return out, at


def _formula(text: str) -> tuple[int, int]:
    """(a, b) of an+b."""
    t = re.sub(r"\s+", "", text.lower())
    if t in ("odd", "even"):
        return 2, int(t == "odd")
    if re.fullmatch(r"[+-]?\d+", t):
        return 0, int(t)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", t)
    if not m:
        raise ValueError(f"no position formula: {text!r}")
    return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)


class _Flags:
    """The element table with a boolean column for each part of a selector."""

    def __init__(self, nodes: DataFrame, page: str) -> None:
        self.df, self.page, self.made = nodes, page, []
        order = Window.partitionBy(page).orderBy("node")
        siblings = Window.partitionBy(page, "parent").orderBy("node")
        first, last = Window.unboundedPreceding, Window.unboundedFollowing
        self.before, self.after = order.rowsBetween(first, -1), order.rowsBetween(1, last)
        self.elder, self.younger = siblings.rowsBetween(first, -1), siblings.rowsBetween(1, last)
        self.siblings = siblings
        self.falling = Window.partitionBy(page, "parent").orderBy(F.desc("node"))

    def add(self, value: Column) -> str:
        name = f"_selector{len(self.made)}"
        self.made.append(name)
        self.df = self.df.withColumn(name, value)
        return name

    def above(self, comb: str, flag: str) -> str:
        """Whether an element that ``flag`` marks stands before the combinator."""
        f = F.col(flag)
        if comb == " ":
            return self.add(F.coalesce(F.max(F.when(f, F.col("last"))).over(self.before) >= F.col("node"), F.lit(False)))
        if comb == ">":
            up = self.df.filter(f).select(self.page, F.col("node").alias("parent"), F.lit(True).alias("_up")).distinct()
            return self._joined(up, "parent")
        return self.add(F.coalesce(F.lag(f).over(self.siblings) if comb == "+" else F.max(f).over(self.elder), F.lit(False)))

    def below(self, comb: str, flag: str) -> str:
        """Whether an element that ``flag`` marks stands behind the combinator."""
        f = F.col(flag)
        if comb == " ":
            return self.add(F.coalesce(F.min(F.when(f, F.col("node"))).over(self.after) <= F.col("last"), F.lit(False)))
        if comb == ">":
            up = self.df.filter(f).select(self.page, F.col("parent").alias("node"), F.lit(True).alias("_up")).distinct()
            return self._joined(up, "node")
        return self.add(F.coalesce(F.lead(f).over(self.siblings) if comb == "+" else F.max(f).over(self.younger), F.lit(False)))

    def _joined(self, up: DataFrame, key: str) -> str:
        self.df = self.df.join(up, [self.page, key], "left")
        name = self.add(F.col("_up").isNotNull())
        self.df = self.df.drop("_up")
        return name

    def tests(self, tests: list) -> str:
        out = F.lit(True)
        for kind, what in tests:
            out = out & F.coalesce(self.test(kind, what), F.lit(False))
        return self.add(out)

    def test(self, kind: str, what) -> Column:
        if kind == "name":
            return F.lit(True) if what == "*" else F.lower("name") == what.lower()
        if kind == "id":
            return F.col("attrs")["id"] == what
        if kind == "cls":
            return F.array_contains(F.split(F.col("attrs")["class"], r"[ \t\n\r\f]+"), what)
        if kind == "attr":
            return self.attribute(*what)
        if kind in ("not", "is", "where"):
            hit = self.any_of([self.forward(s) for s in what])
            return ~hit if kind == "not" else hit
        if kind == "has":
            return self.any_of([self.backward(s) for s in what])
        if kind == "root":
            return F.col("parent").isNull()
        if kind in ("first-child", "last-child"):
            kind, what = ("nth-child" if kind == "first-child" else "nth-last-child"), (0, 1)
        elif kind == "only-child":
            return F.col(self.add(self.test("first-child", None))) & F.col(self.add(self.test("last-child", None)))
        a, b = what
        place = F.col(self.add(F.row_number().over(self.siblings if kind == "nth-child" else self.falling)))
        return place == b if a == 0 else ((place - b) % a == 0) & ((place - b) * a >= 0)

    @staticmethod
    def any_of(names: list[str]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | F.col(n)
        return out

    @staticmethod
    def attribute(name: str, op: str | None, value: str | None, fold: bool) -> Column:
        have = F.col("attrs")[name]
        if op is None:
            return have.isNotNull()
        if fold:
            have, value = F.lower(have), value.lower()
        some = F.lit(value != "")
        return {
            "=": have == value,
            "~=": F.lit(not re.search(r"\s", value)) & some & F.array_contains(F.split(have, r"[ \t\n\r\f]+"), value),
            "|=": (have == value) | F.startswith(have, F.lit(value + "-")),
            "^=": some & F.startswith(have, F.lit(value)),
            "$=": some & F.endswith(have, F.lit(value)),
            "*=": some & F.contains(have, F.lit(value)),
        }[op]

    def forward(self, steps: list) -> str:
        """Elements at the end of the steps: each part's elements mark those behind them."""
        now = self.tests(steps[0][1])
        for comb, tests in steps[1:]:
            near = self.above(comb, now)
            now = self.add(F.col(self.tests(tests)) & F.col(near))
        return now

    def backward(self, steps: list) -> str:
        """Elements from which the steps lead on: the last part's elements mark those before them."""
        now = self.tests(steps[-1][1])
        for i in range(len(steps) - 1, 0, -1):
            near = self.below(steps[i][0], now)
            now = self.add(F.col(self.tests(steps[i - 1][1])) & F.col(near))
        return self.below(steps[0][0], now)


def select(nodes: DataFrame, selector: str, page: str = "page") -> DataFrame:
    """The rows of ``nodes`` that match a selector list.

    Names and attribute names are compared without case, values with it. Read are
    type, ``*``, id, class and attribute tests, the four combinators, ``:not``,
    ``:is``, ``:where``, ``:has``, and positions among siblings; anything else is a
    ValueError. A page's elements are one group of a window, which spills.
    """
    flags = _Flags(nodes, page)
    hit = flags.any_of([flags.forward(s) for s in parse(selector)])
    return flags.df.filter(hit).select(*[F.col(f"`{c}`") for c in nodes.columns])


def in_order(page: str = "page"):
    """A page's elements in document order, the whole page."""
    return Window.partitionBy(page).orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def matched(nodes: DataFrame, parsed: list[list], column: str, page: str = "page") -> DataFrame:
    """``nodes`` with an array of the places in ``parsed`` (see ``parse``) of the selector lists that match a row."""
    flags = _Flags(nodes, page)
    hits = []
    for alternatives in parsed:
        hit = F.lit(False)
        for steps in alternatives:
            tests = steps[0][1]
            if len(steps) == 1 and all(kind in ("name", "id", "cls", "attr") for kind, _ in tests):  # a row shows it by itself
                one = F.lit(True)
                for kind, what in tests:
                    one = one & F.coalesce(flags.test(kind, what), F.lit(False))
            else:
                one = F.col(flags.forward(steps))
            hit = hit | one
        hits.append(hit)
    places = F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hits)])) if hits else F.array().cast("array<int>")
    return flags.df.select(*[F.col(f"`{c}`") for c in nodes.columns], places.alias(column))


def with_last(rows: list[dict]) -> list[int]:
    """The greatest number below each of a page's nodes (numbers in document order)."""
    place = {r["node_id"]: i for i, r in enumerate(rows)}
    last = [r["node_id"] for r in rows]
    for i in range(len(rows) - 1, -1, -1):
        up = place.get(rows[i]["parent_id"])
        if up is not None:
            last[up] = max(last[up], last[i])
    return last
