"""Inline Markdown, selectors, graphs and revisions: rules, brute force, hard inputs."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions.inlines import inlines, label
from textloom.operators import graphs, hyphens, selectors, sequential


def shape(text, refs=None):
    """Rows as nested text: (kind target children)."""
    rows = inlines(text, refs)
    out, open_ = [], []
    for _, depth, kind, said, target in rows:
        while len(open_) > depth:
            out.append(")")
            open_.pop()
        if kind in ("emph", "strong", "link", "image"):
            out.append(f"{kind}{'<' + target + '>' if target is not None else ''}(")
            open_.append(kind)
        else:
            out.append(said if kind == "text" else f"{{{kind}:{said}}}")
    return "".join(out) + ")" * len(open_)


@pytest.mark.parametrize(
    "text, want",
    [
        ("*a*", "emph(a)"), ("a * b*", "a * b*"), ("**a**b", "strong(a)b"), ("***a***", "emph(strong(a))"), ("***a** b*", "emph(strong(a) b)"), ("*a **b***", "emph(a strong(b))"),
        ("a_b_c", "a_b_c"), ("a*b*c", "aemph(b)c"), ("_a_.", "emph(a)."), ("**a*", "*emph(a)"), ("*a**b*", "emph(a**b)"), ("*a**", "emph(a)*"), ("*a _b* c_", "emph(a _b) c_"), ("\"*a*\"", "\"emph(a)\""), ("*(*a*)*", "emph((emph(a)))"),
        ("`a``b`", "{code:a``b}"), ("`` ` ``", "{code:`}"), ("`  `", "{code:  }"), ("*a`*`", "*a{code:*}"), ("`a", "`a"),
        ("[a](/u)", "link</u>(a)"), ("[a](<u v> 't')", "link<u v>(a)"), ("[a](u(v)w)", "link<u(v)w>(a)"), ("[a](u v)", "[a](u v)"), ("[]()", "link<>("")".replace('""', "")), ("![a *b*](u)", "image<u>(a emph(b))"), ("[a [b](c)](d)", "[a link<c>(b)](d)"),
        ("[![a](b)](c)", "link<c>(image<b>(a))"), ("*[a*](b)", "*link<b>(a*)"), ("[a](b\\)c)", "link<b)c>(a)"), ("[a](b \"c", "[a](b \"c"),
        ("<http://a>", "{autolink:http://a}"), ("<a@b.c>", "{autolink:a@b.c}"), ("<b x='>'>c</b>", "{html:<b x='>'>}c{html:</b>}"), ("<!-- *a* -->", "{html:<!-- *a* -->}"), ("<1>", "<1>"),
        ("a  \nb", "a{hardbreak:}b"), ("a\\\nb", "a{hardbreak:}b"), ("a \n b", "a{softbreak:}b"), ("\\*a\\*", "*a*"), ("&amp;&#42;a&#42;", "&*a*"), ("&nope;", "&nope;"), ("", ""), (None, ""),
    ],
)
def test_rules(text, want):
    assert shape(text) == want


def test_references():
    refs = {label("A  b"): "/x"}
    assert shape("[a B]", refs) == "link</x>(a B)"
    assert shape("[t *u*][a b]", refs) == "link</x>(t emph(u))"
    assert shape("[a b][]", refs) == "link</x>(a b)"
    assert shape("[c]", refs) == "[c]"


@pytest.mark.parametrize("part", ["[a](", "*a ", "a**b_", "[", "a`", "<!--", "[a](b \"", "*a_ ", "[a](<b", "![[", "](", "<a x='", "*a**", "\\[", "&a"])
def test_cost_grows_like_the_text(part):
    def took(n):
        best = 9e9
        for _ in range(3):
            t = time.process_time()
            inlines(part * n)
            best = min(best, time.process_time() - t)
        return best

    assert took(20000) < 12 * took(4000) + 0.2


# --- selectors ------------------------------------------------------------------------------------


def brute(rows, selector):
    """Each element against a selector by walking up, with backtracking."""
    by = {r["node"]: r for r in rows}
    kids = {}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r)

    def near(r, comb, back):
        family = kids[r["parent"]]
        i = family.index(r)
        if back:
            if comb == " ":
                out, up = [], by.get(r["parent"])
                while up:
                    out.append(up)
                    up = by.get(up["parent"])
                return out
            return {">": [by[r["parent"]]] if r["parent"] in by else [], "+": family[max(0, i - 1) : i], "~": family[:i]}[comb]
        if comb == " ":
            return [x for c in kids.get(r["node"], []) for x in [c, *near(c, " ", False)]]
        return {">": kids.get(r["node"], []), "+": family[i + 1 : i + 2], "~": family[i + 1 :]}[comb]

    def one(r, kind, what):
        attrs = r["attrs"] or {}
        family = kids[r["parent"]]
        if kind == "name":
            return what == "*" or r["name"] == what.lower()
        if kind == "cls":
            return what in (attrs.get("class") or "").split()
        if kind == "attr":
            return what[0] in attrs and (what[1] is None or attrs[what[0]] == what[2])
        if kind == "has":
            return any(ahead(r, s) for s in what)
        if kind in ("not", "is", "where"):
            return any(match(r, s) for s in what) != (kind == "not")
        if kind == "first-child":
            return family[0] is r
        a, b = what
        p = family.index(r) + 1 if kind == "nth-child" else len(family) - family.index(r)
        return any(a * n + b == p for n in range(200))

    def match(r, steps):
        comb, tests = steps[-1]
        return all(one(r, *t) for t in tests) and (len(steps) == 1 or any(match(x, steps[:-1]) for x in near(r, comb, True)))

    def ahead(r, steps):
        comb, tests = steps[0]
        return any(all(one(x, *t) for t in tests) and (len(steps) == 1 or ahead(x, steps[1:])) for x in near(r, comb, False))

    return {r["node"] for r in rows if any(match(r, s) for s in selectors.parse(selector))}


SELECTORS = ["a b", "a > b", "a + b", "a ~ b.x", "a b > a, b + b", "a:has(b)", "a:has(> b + a)", "b:has(~ a b)", ":not(a b)", "*:nth-child(2n+1)", "b:nth-last-child(-n+2)", ".x .y a", "a:not(:has(a)):first-child", "[class]", "b:is(a > b, .y)"]


def test_selectors_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for page in range(4):
        for node in range(40):
            # a node's parent is on the way from the one before it to the root
            up = None if not node else node - 1
            while node and up is not None and rng.random() < 0.5 and rows[page * 40 + up]["parent"] is not None:
                up = rows[page * 40 + up]["parent"]
            rows.append({"page": page, "node": node, "node_id": node, "parent": up, "parent_id": up, "name": rng.choice("ab"), "attrs": rng.choice([None, {"class": "x"}, {"class": "y  x"}, {"class": "y"}])})
    for page in range(4):
        part = rows[page * 40 : page * 40 + 40]
        for r, z in zip(part, selectors.with_last(part), strict=True):
            r["last"] = z
    df = spark.createDataFrame([tuple(r[c] for c in ("page", "node", "parent", "last", "name", "attrs")) for r in rows], "page int, node int, parent int, last int, name string, attrs map<string,string>").cache()
    for s in SELECTORS:
        got = {(r["page"], r["node"]) for r in selectors.select(df, s).select("page", "node").collect()}
        assert got == {(p, n) for p in range(4) for n in brute(rows[p * 40 : p * 40 + 40], s)}, s


def test_selectors_on_html(spark):
    page = "<div class=a><div class=b><div class=b><i>t</i></div></div></div><h1>a</h1> x <p HREF='Foo'>b</p>"
    df = sequential.html_elements(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"))
    hit = lambda s: [r["name"] for r in selectors.select(df, s, "page_id").orderBy("node").collect()]
    assert hit(".a .b i") == ["i"]
    assert hit("h1 + p[href]") == ["p"]
    assert hit("[href=foo]") == [] and hit("[href=foo i]") == ["p"] and hit("[href^='']") == []
    for bad in ("", "a,,b", "a >", "> a", "a:not(b", "a)", "a:hover", "a > > b"):
        with pytest.raises(ValueError):
            selectors.parse(bad)


# --- graphs ---------------------------------------------------------------------------------------


def test_reachable_ring_hub_and_long_chain(spark):
    edges = [(i, i + 1) for i in range(30)] + [(30, 0), (5, None), (None, 7), (5, 6)] + [(3, 100 + i) for i in range(50)] + [(900, 901)]
    e = spark.createDataFrame(edges, "src long, dst long")
    roots = spark.createDataFrame([(0,), (0,), (None,), (500,)], "node long")
    got = {r["node"]: r["steps"] for r in graphs.reachable(e, roots).collect()}
    assert got == {**{i: i for i in range(31)}, **{100 + i: 4 for i in range(50)}, 500: 0}
    assert graphs.reachable(e, roots.limit(0)).count() == 0
    nodes = spark.createDataFrame([(900,), (1,), (None,)], "node long")
    assert {r["node"] for r in graphs.unreachable(nodes, e, roots).collect()} == {900, None}


def test_live_objects_keep_deleted_objects_deleted(spark):
    sections = spark.createDataFrame([(1, 10, None, False), (1, 20, 10, False), (1, 30, 20, True), (2, 5, 6, True), (2, 6, 5, False), (3, 1, 99, True), (1, 77, 10, False)], "file int, section int, prev int, newest boolean")
    entries = [(1, 10, 0, 1, 0, 11, False), (1, 10, 1, 2, 0, 12, False), (1, 20, 0, 1, 1, 0, True), (1, 30, 0, 3, 0, 33, False), (1, 30, 1, 3, 0, 34, False), (1, 77, 0, 2, 0, 99, False), (2, 5, 0, 1, 0, 51, False), (2, 6, 0, 1, 0, 61, False), (2, 6, 1, 2, 0, 62, None), (3, 1, 0, 1, 0, 0, True)]
    e = spark.createDataFrame(entries, "file int, section int, place int, number int, generation int, offset int, free boolean")
    assert sorted(tuple(r) for r in graphs.live_objects(sections, e).collect()) == [(1, 2, 0, 12), (1, 3, 0, 34), (2, 1, 0, 51), (2, 2, 0, 62)]


def test_packed_rows(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x00\xff\x02\x01\x00\x09"),), (bytearray(),), (None,)], "d binary")
    got = [r[0] for r in df.select(graphs.packed_rows(df.d, [1, 2, 0])).collect()]
    assert got == [[[1, 255, None], [2, 256, None]], [], None]
    for bad in ([8], [0, 0], [-1]):
        with pytest.raises(ValueError):
            graphs.packed_rows(df.d, bad)


def test_break_places(spark):
    words = spark.createDataFrame([("Hyphenation",), ("hyphenation",), (None,), ("",), ("ab",), ("present",), ("a" * 3000,)], "word string")
    # a known example of the method: hy-phen-ation by these eight patterns
    patterns = spark.createDataFrame([(p,) for p in ("hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n", None, " ", "hy3ph")], "pattern string")
    exceptions = spark.createDataFrame([("pre-sent",), ("p-resent",), (None,)], "word string")
    got = hyphens.break_places(words, patterns, exceptions)
    said = {r[0]: r[1] for r in got.select("word", hyphens.hyphenated(F.col("word"), F.col("breaks"))).collect()}
    assert said == {"hyphenation": "hy-phen-ation", "": "", "ab": "ab", "present": "p-resent", "a" * 3000: "a" * 3000}
    assert {r[0] for r in hyphens.break_places(words, patterns.limit(0)).collect()} == {"hyphenation", "", "ab", "present", "a" * 3000}
