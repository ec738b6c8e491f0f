"""Character maps, computed styles and ruled tables: rules, brute force, hard inputs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import blocks, charmaps, lattices, styles


def spelled(rng, n):
    """A map of ``n`` entries that overlap, as text and as code -> text."""
    want, parts = {}, []
    for _ in range(n):
        lo = rng.randrange(0, 0xFF00)
        kind = rng.randrange(3)
        if kind == 0:
            parts.append(f"1 beginbfchar <{lo:04x}> <00410042> endbfchar")
            want[lo] = "AB"
        elif kind == 1:
            hi = min(0xFFFF, lo + rng.randrange(0, 40000))
            base = rng.choice([0x20, 0x3B1, 0xD000, 0x1F600])
            target = chr(base).encode("utf-16-be").hex()
            parts.append(f"1 beginbfrange <{lo:04X}> <{hi:04X}> <{target}> endbfrange")
            for c in range(lo, hi + 1):
                p = base + c - lo
                want[c] = "�" if 0xD800 <= p <= 0xDFFF else chr(p)
        else:
            parts.append(f"1 beginbfrange <{lo:04X}> <{lo + 2:04X}> [<0058> <0059> <005A>] endbfrange")
            want |= {lo: "X", lo + 1: "Y", lo + 2: "Z"}
    return "\n".join(parts), want


def test_overlapping_ranges_as_written_out(spark):
    rng = random.Random(5)
    maps, wants, strings = [], {}, []
    for m in range(3):
        body, wants[m] = spelled(rng, 25)
        maps.append((m, "1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + body))
        for k in range(4):
            codes = [rng.randrange(0x10000) for _ in range(500)]
            strings.append((m * 4 + k, m, b"".join(c.to_bytes(2, "big") for c in codes), "".join(wants[m].get(c, "�") for c in codes), sum(c not in wants[m] for c in codes)))
    df = spark.createDataFrame(strings, "id long, map long, data binary, want string, lost long")
    got = charmaps.decode_strings(df, ["id"], spark.createDataFrame(maps, "map long, body string")).join(df, "id")
    rows = got.collect()
    assert len(rows) == 12
    for r in rows:
        assert (r["text"], r["n_codes"], r["n_unmapped"]) == (r["want"], 500, r["lost"])


def test_mixed_codes_read_in_place_and_joined(spark, monkeypatch, capsys):
    rng = random.Random(3)
    spaces = "begincodespacerange <00> <7F> <8140> <9FFC> <A0000000> <A0FFFFFF> endcodespacerange"
    maps = spark.createDataFrame([("m", f"{spaces} beginbfrange <20> <7E> <0020> <8140> <817E> <0391> <A0000000> <A000FFFF> <4E00> endbfrange"), ("w", "begincodespacerange <000000> <FFFFFF> endcodespacerange beginbfrange <000000> <00FFFF> <0041> endbfrange")], "map string, body string")
    strings = [(k, "mw"[k % 2], bytes(rng.choice([0x20, 0x41, 0x81, 0x45, 0x00, 0xA0, 0xFE]) for _ in range(rng.randrange(40)))) for k in range(60)]
    df = spark.createDataFrame(strings, "id long, map string, data binary")
    out = charmaps.decode_strings(df, ["id"], maps)
    got = sorted(map(tuple, out.collect()))
    out.explain()
    assert "MapInArrow" in capsys.readouterr().out  # no row for each code
    monkeypatch.setattr(charmaps, "KNOWN_BYTES", -1)
    assert got == sorted(map(tuple, charmaps.decode_strings(df, ["id"], maps).collect()))
    assert sum(r[3] for r in got) > 0 and sum(r[2] for r in got) > sum(r[3] for r in got)


def test_blocks_cover_a_range_once(spark):
    rng = random.Random(1)
    spans = [(0, 0), (0, 2**32 - 1), (1, 2**32 - 2), (5, 6), (7, 8)] + [tuple(sorted((rng.randrange(2**20), rng.randrange(2**20)))) for _ in range(50)]
    df = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", charmaps.blocks(F.col("lo"), F.col("hi")).alias("b"))
    for r in df.collect():
        parts = sorted((b["block"] << b["level"], (b["block"] + 1) << b["level"]) for b in r["b"])
        assert parts[0][0] == r["lo"] and parts[-1][1] == r["hi"] + 1
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and len(parts) <= 64


def test_map_edges(spark):
    bodies = {
        "none": None, "empty": "", "odd": "1 beginbfchar <0041> <0042F> endbfchar 1 beginbfchar <0042> <D83D> endbfchar 1 beginbfchar <0043> <004> endbfchar",
        "last": "1 beginbfrange <0000> <00FF> <DBFFDFFE> endbfrange", "back": "1 beginbfrange <0042> <0041> <0041> endbfrange", "short": "begincodespacerange <00> <FF> endcodespacerange beginbfchar <0041> <0058> endbfchar",
    }
    maps = spark.createDataFrame(list(bodies.items()), "map string, body string")
    data = [(1, "none", b"\0A"), (2, "empty", b"\0A\0"), (3, "odd", b"\0A\0B\0C"), (4, "last", b"\0\0\0\1\0\2"), (5, "back", b"\0A"), (6, "short", b"AB"), (7, "gone", b"A"), (8, "odd", None), (9, "odd", b""), (10, None, b"A")]
    got = charmaps.decode_strings(spark.createDataFrame(data, "id long, map string, data binary"), ["id"], maps)
    rows = {r["id"]: (r["text"], r["n_codes"], r["n_unmapped"]) for r in got.collect()}
    lost = "�"
    assert rows == {
        1: (lost, 1, 1), 2: (lost * 2, 2, 2), 3: ("B\xf0" + lost + "@", 3, 0), 4: ("\U0010fffe\U0010ffff" + lost, 3, 1), 5: (lost, 1, 1),
        6: ("X" + lost, 2, 1), 7: ("", 0, 0), 8: ("", 0, 0), 9: ("", 0, 0), 10: ("", 0, 0),
    }
    assert charmaps.decode_strings(spark.createDataFrame(data[:0], "id long, map string, data binary"), ["id"], maps).count() == 0


# --- computed styles -----------------------------------------------------------------------------


def table(spark, rows):
    return spark.createDataFrame(rows, "page long, node int, parent int, last int, name string, attrs map<string,string>")


def test_sheet_rules():
    rules = styles.sheet("a, .b c, #d:not(.e, f) { color: red } @media x { a { color: blue } } @import 'q'; g[{ x: y } h { margin: 1px 2px !important; : z; w: }")
    assert [(r.specificity, len(r.alternatives)) for r in rules] == [((0, 0, 1), 1), ((0, 1, 1), 1), ((1, 1, 0), 1), ((0, 0, 1), 1)]
    assert rules[-1].declarations == [("margin-top", "1px", True), ("margin-right", "2px", True), ("margin-bottom", "1px", True), ("margin-left", "2px", True)]
    assert styles.declarations("a: 'x;y'; b:/* c */2 ! IMPORTANT;;c") == [("a", "'x;y'", False), ("b", "2", True)]
    assert [d[1] for d in styles.declarations("padding: 1px 2px 3px")] == ["1px", "2px", "3px", "2px"]
    assert styles.declarations(None) == styles.declarations("") == [] and styles.sheet("") == []


def test_styles_broadcast_nothing(spark, capsys):
    styles.computed(table(spark, [(1, 0, None, 1, "p", None), (1, 1, 0, 1, "b", None)]), styles.sheet("p { color: red }")).explain()
    assert "Broadcast" not in capsys.readouterr().out


PROGRAM = {"p": {"text-align": "center", "width": "50%", "font-size": "2em", "margin-left": "3px"}, "q": {"font-weight": "bold"}}
INITIAL = {"color": "#000000", "text-align": "start", "width": "auto", "margin-left": "0px", "border-top-color": None}


def by_recursion(rows):
    """The same rules, walked from the root down."""
    out, kids = {}, {}
    for r in rows:
        kids.setdefault(r[2], []).append(r)

    def px(v, em, rem):
        for unit, k in (("rem", rem), ("em", em), ("pt", 96 / 72), ("px", 1.0)):
            if v.endswith(unit):
                return float(v[: -len(unit)]) * k
        return None

    def walk(row, above, rem):
        _, node, _, _, name, attrs = row
        own = dict(x.split(":") for x in attrs["style"].split(";") if x)
        ua = PROGRAM.get(name, {})

        def raw(prop):
            v = own.get(prop, ua.get(prop))
            return ua.get(prop) if v == "revert" else None if v == "unset" else v

        got, v = {}, raw("font-size")
        size = above["font-size"] if above else 16.0
        if v == "initial":
            size = 16.0
        elif v == "larger":
            size *= 1.2
        elif v and v.endswith("%"):
            size *= float(v[:-1]) / 100
        elif v and v != "inherit":
            size = px(v, size, rem or 16.0)
        got["font-size"], rem = size, rem or size
        w, v = above["font-weight"] if above else 400, raw("font-weight")
        if v == "bolder":
            w = 400 if w < 350 else 700 if w < 550 else max(w, 900)
        elif v == "lighter":
            w = w if w < 100 else 100 if w < 550 else 400 if w < 750 else 700
        elif v and v != "inherit":
            w = {"bold": 700, "initial": 400}.get(v) or int(v)
        got["font-weight"] = w
        for prop, start in INITIAL.items():
            v, start = raw(prop), start or got["color"]
            before = above[prop] if above else start
            if v == "inherit" or v is None and prop in ("color", "text-align"):
                got[prop] = before
            elif v in (None, "initial"):
                got[prop] = start
            elif prop == "color":
                got[prop] = {"red": "#ff0000", "#Abc": "#aabbcc", "rgb(1, 2, 300)": "#0102ff", "currentcolor": before}.get(v, before)
            elif prop == "border-top-color":
                got[prop] = {"red": "#ff0000", "CurrentColor": got["color"]}.get(v, start)
            elif prop == "text-align":
                got[prop] = v
            elif v.endswith("%"):
                got[prop] = f"{float(v[:-1])}%"
            else:
                n = px(v, size, rem)
                got[prop] = "auto" if v == "auto" else start if n is None or prop == "width" and n < 0 else f"{round(n, 6)}px"
        out[node] = got
        for k in kids.get(node, ()):
            walk(k, got, rem)

    walk(kids[None][0], None, None)
    return out


SAID = {
    "font-size": ["2em", "50%", "10px", "1.5rem", "larger", "initial", "inherit", "unset", "revert", "9pt"], "font-weight": ["bolder", "lighter", "50", "350", "bold", "inherit", "initial", "revert", "1000"],
    "color": ["red", "#Abc", "rgb(1, 2, 300)", "currentcolor", "inherit", "initial", "puce"], "border-top-color": ["red", "CurrentColor", "inherit", "unset", "1px"], "text-align": ["left", "inherit", "initial", "revert", "unset"],
    "width": ["auto", "30%", "2em", "-1px", "inherit", "revert"], "margin-left": ["-1em", "2rem", "auto", "inherit", "revert", "initial", "x"],
}


def test_styles_as_by_recursion(spark):
    rng, rows, want = random.Random(3), [], {}
    for page in range(6):
        mine = []
        for node in range(60):
            up = None if node == 0 else node - 1 if page == 0 else rng.randrange(max(0, node - 8), node)
            style = ";".join(f"{p}:{rng.choice(v)}" for p, v in SAID.items() if rng.random() < 0.5)
            mine.append((page, node, up, node, rng.choice(["p", "q", "div"]), {"style": style}))
        rows += mine
        want |= {(page, n): g for n, g in by_recursion(mine).items()}
    sheet = styles.sheet(" ".join(f"{n} {{ {'; '.join(f'{p}: {v}' for p, v in d.items())} }}" for n, d in PROGRAM.items()), program=True)
    got = styles.computed(table(spark, rows), sheet).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["page"], r["node"]]
        assert abs(r["font_size"] - w["font-size"]) <= 1e-9 * w["font-size"] and r["font_weight"] == w["font-weight"], (r, w)
        for p in INITIAL:
            a, b = r["style"][p], w[p]
            if a.endswith("px") and b.endswith("px"):
                assert abs(float(a[:-2]) - float(b[:-2])) <= 1e-5 + 1e-9 * abs(float(b[:-2])), (p, r, w)
            else:
                assert a == b, (p, r, w)


def test_tiers_and_edges(spark):
    program = styles.sheet("a { color: navy !important; width: 1px } b { color: lime }", program=True)
    rules = program + styles.sheet("a { color: red !important } b { color: red } b { width: 2px !important } b { width: 3px } #i { float: left } b { float: right; clear: up }", first=len(program))
    rows = [(1, 0, None, 3, "a", {"style": "color: blue !important"}), (1, 1, 0, 1, "b", {"style": "color: white; width: 4px", "id": "i"}), (1, 2, 0, 2, None, None), (1, 3, 9, 3, "B", {"style": ""}), (1, 3, 9, 3, "B", {"style": ""}), (2, 0, None, 0, "b", {"style": "width:5px!important"})]
    got = {(r["page"], r["node"]): r["style"] for r in styles.computed(table(spark, rows), rules).collect()}
    assert len(got) == 5
    pick = {k: (s["color"], s["width"], s["float"], s["clear"]) for k, s in got.items()}
    assert pick == {
        (1, 0): ("#000080", "1.0px", "none", "none"), (1, 1): ("#ffffff", "2.0px", "left", "none"), (1, 2): ("#000080", "auto", "none", "none"),
        (1, 3): ("#ff0000", "2.0px", "right", "none"), (2, 0): ("#ff0000", "5.0px", "right", "none"),
    }
    assert styles.computed(table(spark, rows[:0]), rules).count() == 0
    assert {r["style"]["color"] for r in styles.computed(table(spark, rows[2:3]), []).collect()} == {"#000000"}


# --- tables from strokes -------------------------------------------------------------------------


def test_components_as_by_pairs():
    rng = np.random.default_rng(2)
    for _ in range(20):
        make = lambda n: np.column_stack([rng.uniform(0, 300, n), *np.sort(rng.uniform(0, 300, (2, n)), axis=0)])  # noqa: B023, E731
        h, v = make(40), make(30)
        group = np.arange(70)
        for _ in range(70):
            for i, (y, a, b) in enumerate(h):
                for j, (x, c, d) in enumerate(v):
                    if a - 2 <= x <= b + 2 and c - 2 <= y <= d + 2:
                        group[i] = group[40 + j] = min(group[i], group[40 + j])
        got = lattices.components(h, v)
        assert len(set(zip(got.tolist(), group.tolist(), strict=True))) == len(set(got.tolist())) == len(set(group.tolist()))


def box(x0, y0, x1, y1):
    return [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]


def cells(spark, pages):
    df = spark.createDataFrame([(p, *(None if x is None else float(x) for x in s)) for p, strokes in pages.items() for s in strokes], "page long, x0 double, y0 double, x1 double, y1 double")
    out = {}
    for r in lattices.table_cells(df).collect():
        out.setdefault((r["page"], r["table"]), []).append((r["row"], r["col"], r["tall"], r["wide"]))
    return {k: sorted(v) for k, v in out.items()}


def test_tables_of_strokes(spark):
    halves = [(0, 50, 100, 50), (50, 0, 50, 100)]
    shared = [(0, 25, 50, 25), (25, 0, 25, 50)]  # divides the lower left cell from edge to edge
    inset = [s for s in box(60, 60, 90, 90)] + [(60, 75, 90, 75), (75, 60, 75, 90)]
    deep = box(64, 64, 71, 71) + [(64, 67.5, 71, 67.5), (67.5, 64, 67.5, 71)]
    pages = {
        1: box(0, 0, 100, 100), 2: box(0, 0, 100, 100) + halves, 3: box(0, 0, 100, 100) + halves + shared, 4: box(0, 0, 100, 100) + halves + inset + deep,
        5: box(0, 0, 100, 100) + halves[:1] + box(200, 0, 300, 120) + [(250, 0, 250, 120)], 6: [(0, 0, 100, 0), (0, 10, 100, 10)], 7: [(0, 0, 50, 50), (0, 0, 1, 0), (None, 0, 9, 0), (0, float("nan"), 9, 0), (0, 0, float("inf"), 0)],
        8: (box(0, 0, 100, 100) + halves) * 3, 9: box(0, 0, 100, 100) + [(20, 50, 80, 50)],
    }
    four = [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1)]
    got = cells(spark, pages)
    assert got == {
        (2, "0"): four, (3, "0"): four, (3, "0/1,0"): four, (4, "0"): four, (4, "0/0,1"): four, (4, "0/0,1/1,0"): four,
        (5, "0"): [(0, 0, 1, 1), (0, 1, 1, 1)], (5, "1"): [(0, 0, 1, 1), (1, 0, 1, 1)], (8, "0"): four, (9, "0"): [(0, 0, 2, 1)],
    }


def test_texts_of_tables_broadcasts_nothing(spark, capsys):
    strokes = spark.createDataFrame([(1, *map(float, s)) for s in box(0, 0, 100, 100)], "page long, x0 double, y0 double, x1 double, y1 double")
    df = spark.createDataFrame([(1, 1, 10.0, 80.0, 20.0, 90.0, "b")], "page long, frag long, x0 double, y0 double, x1 double, y1 double, text string")
    lattices.ruled_tables(strokes, df).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_texts_of_tables(spark):
    strokes = spark.createDataFrame([(1, *map(float, s)) for s in box(0, 0, 100, 100) + [(50, 0, 50, 100)]], "page long, x0 double, y0 double, x1 double, y1 double")
    frags = [(1, 1, 10.0, 80.0, 20.0, 90.0, "b"), (1, 2, 10.0, 90.0, 20.0, 99.0, "a"), (1, 3, 45.0, 10.0, 55.0, 20.0, "edge"), (1, 4, 200.0, 0.0, 210.0, 9.0, "out"), (1, 5, 60.0, 10.0, 70.0, 20.0, None), (2, 6, 1.0, 1.0, 2.0, 2.0, "x"), (None, 7, 1.0, 1.0, 2.0, 2.0, "x")]
    df = spark.createDataFrame(frags, "page long, frag long, x0 double, y0 double, x1 double, y1 double, text string")
    assert sorted((r["row"], r["col"], r["text"]) for r in lattices.ruled_tables(strokes, df).collect()) == [(0, 0, "a b edge"), (0, 1, "")]
    assert lattices.ruled_tables(strokes.limit(0), df).count() == 0
    assert [r["text"] for r in lattices.ruled_tables(strokes, df.limit(0)).collect()] == ["", ""]


# --- blocks of lines -----------------------------------------------------------------------------


def placed(spark, rows):
    """Lines of (x0, x1, y0, size, text[, bold, mono])."""
    full = [(1, 1, i, *map(float, r[:3]), float(r[3]), r[4], *(r[5:] or (False, False))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "doc long, page long, line long, x0 double, x1 double, y0 double, size double, text string, bold boolean, mono boolean")


def kinds(spark, rows):
    return [(r["kind"], r["level"]) for r in blocks.classify(placed(spark, rows)).orderBy("line").collect()]


def test_lines_by_their_neighbours(spark):
    body = "body text that goes on for a whole line of the page,"
    rows = [
        (72, 300, 700, 24, "Title"), (72, 500, 660, 10, body), (72, 500, 648, 10, body), (72, 200, 610, 10, "A short one"), (72, 500, 598, 10, body),
        (72, 200, 560, 10, "1990. It was a good year"), (72, 500, 548, 10, body),
        (72, 172, 510, 10, "• one item"), (92, 300, 498, 10, "over two lines"), (92, 300, 486, 10, "or three"), (72, 172, 474, 10, "• next item"), (104, 204, 462, 10, "- below it"), (72, 300, 450, 10, "no longer an item"), (92, 300, 438, 10, "nor this"),
        (72, 300, 400, 10, "x = 1", False, True), (72, 300, 388, 10, "• y", False, True), (72, 200, 350, 16, "Second"),
    ]
    assert kinds(spark, rows) == [
        ("heading", 1), ("text", 0), ("text", 0), ("heading", 3), ("text", 0), ("heading", 3), ("text", 0),
        ("item", 0), ("continuation", 0), ("continuation", 0), ("item", 0), ("item", 1), ("text", 0), ("text", 0), ("code", 0), ("code", 0), ("heading", 2),
    ]
    got = [(r["kind"], r["level"], r["text"]) for r in blocks.document_blocks(placed(spark, rows)).orderBy("ordinal").collect()]
    assert got[4:] == [
        ("heading", 3, "1990. It was a good year"), ("paragraph", 0, body), ("item", 0, "one item over two lines or three"), ("item", 0, "next item"), ("item", 2, "below it"),
        ("paragraph", 0, "no longer an item nor this"), ("code", 0, "x = 1\n• y"), ("heading", 2, "Second"),
    ]


def test_line_edges(spark):
    nothing = placed(spark, [(0, 1, 2, 3, "x")]).limit(0)
    assert blocks.document_blocks(nothing).count() == 0
    rows = [(1, 1, 0, 1.0, 9.0, 5.0, 10.0, None, None, None), (1, 1, 1, None, 9.0, 4.0, 10.0, "lost", None, None), (1, 1, 1, 1.0, 9.0, 4.0, 10.0, "", None, None), (2, 1, 0, 1.0, 9.0, 5.0, 10.0, "a", True, True)]
    df = spark.createDataFrame(rows, "doc long, page long, line long, x0 double, x1 double, y0 double, size double, text string, bold boolean, mono boolean")
    clash = df.withColumn("kind", F.lit("k")).withColumn("block", F.lit(1)).withColumn("body", F.lit("b"))
    got = [(r["doc"], r["kind"], r["text"]) for r in blocks.document_blocks(clash).orderBy("doc").collect()]
    assert got == [(1, "paragraph", " "), (2, "code", "a")]
