"""Functions of single values."""

from __future__ import annotations

import numpy as np

from textloom.functions import values as v


def test_text():
    assert v.unescape_xml("&lt;&#65;&#x42;&nope;&#x110000;") == "<AB&nope;&#x110000;"
    assert v.resolve_char_refs("&notin; &not it &#0; &#x80;") == "∉ ¬ it � €"
    assert v.resolve_char_refs("a&copy=1&copy;", attribute=True) == "a&copy=1©"
    assert v.expand_tabs("a\tb", 4) == "a   b"
    assert v.resolve_template("{{x} {a}{b}", {"a": "1"}) == "{x} 1"
    assert v.unknown_tokens("{a} {b} {{c}", {"a"}) == ["b"]
    assert v.split_row("| a | b\\|c |") == ["a", "b|c"] and v.split_row("one") == ["one"]
    assert v.autolinks("see https://a.b/c). or www.x.y, me@x.org") == ["https://a.b/c", "www.x.y", "me@x.org"]
    assert v.footnotes("b[^b] a[^a] b[^B]\n[^a]: A\n[^b]: B\n[^c]: C") == [(1, "b", "B"), (2, "a", "A")]


def test_calls():
    assert v.parse_call('AFSimple_Calculate("SUM", new Array("a", "b"));') == ("AFSimple_Calculate", ["SUM", ["a", "b"]])
    assert v.parse_call("AFNumber_Format(2, 0, 0, 0, '$', true)") == ("AFNumber_Format", [2.0, 0.0, 0.0, 0.0, "$", True])
    assert v.parse_call("AFNumber_Format(x)") is None and v.parse_call("alert(1)") is None and v.parse_call(None) is None
    assert v.parse_call("AFDate_Format('x')") is None and v.parse_call("AFDate_Format(1)") == ("AFDate_Format", [1.0])
    assert v.parse_call("/* a */ AFPercent_Format(1, 2) // b") == ("AFPercent_Format", [1.0, 2.0]) and v.parse_call("AFPercent_Format(1, 2, 3)") is None
    assert v.parse_call(r"AFDate_FormatEx('a\nb')") == ("AFDate_FormatEx", ["a\nb"]) and v.parse_call(r"AFDate_FormatEx('a\qb')") is None
    assert v.parse_call("AFDate_Format(1x)") is None and v.parse_call("AFDate_Format(1); f()") is None and v.parse_call("/* AFDate_Format(1)") is None
    got = v.recalculate({"a.x": "1", "a.y": "2,5", "ab": "9", "t": ""}, [("t", 'AFSimple_Calculate("SUM", "a")'), ("u", "f()")])
    assert got == ({"t": "3.5"}, ["u"])
    assert v.exact_sum([1e16, 1, -1e16, None]) == 1 and v.exact_sum([0.1, 0.2, 0.3]) == 0.6


def test_structure():
    assert v.groups_by_place([(0, 0, 1, 1), (1, 0, 2, 1), (2, 0, 3, 1)], 1) == [[0, 1], [2]]
    assert v.specificity("#a .b div:hover") == 10201
    assert v.cascade([(0, ".a", 1, "color", "red"), (0, "p", 2, "color", "blue"), (1, "p", 0, "top", "1")]) == {"color": "red", "top": "1"}
    assert v.css_length("calc(2em + 10px * 2)", {"em": 16, "px": 1}) == 52
    assert v.css_length("clamp(1px, 5px, 3px)", {"px": 1}) == 3 and v.css_length("nope(", {}) is None


def test_rdf():
    packet = """<x xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:d="urn:d"><r:RDF><r:Description d:fmt="pdf">
    <d:title><r:Alt><r:li xml:lang="x-default">T</r:li></r:Alt></d:title><d:creator><r:Seq><r:li>A</r:li><r:li>B</r:li></r:Seq></d:creator><d:n>1</d:n></r:Description></r:RDF></x>"""
    assert v.rdf_properties(packet) == {"fmt": "pdf", "title": {"x-default": "T"}, "creator": ["A", "B"], "n": "1"}
    assert v.rdf_properties("<") == {}


def test_pictures():
    a = np.full((6, 8, 3), 255, np.uint8)
    b = a.copy()
    b[0, 0] = 0
    b[1, 1] = 0
    b[5, 7] = 0
    assert v.changed_regions(v.diff_pixels(a, b)) == [(0, 0, 2, 2), (7, 5, 8, 6)]
    assert v.diff_pixels(a, a[:3]).sum() == 0
