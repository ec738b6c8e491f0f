"""Column functions and value algorithms against stated expectations."""

from __future__ import annotations

import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import dates, numbers, sequences, text, values
from textloom.operators import checks, hygiene, relations, retrieval, tables
from textloom.plans.ranking import global_row_number
from textloom.shipping import ship
from textloom.sources import parsers, readers
from textloom.streaming import changes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def words(s):
    return text.tokenize(F.lit(s))


@pytest.mark.parametrize(("column", "want"), [
    (lambda: words("Hello, World! 42"), ["hello", "world", "42"]),
    (lambda: words("Привет, мир"), ["привет", "мир"]),
    (lambda: text.tokenize_words(F.lit("  Hello,  world!\n\tBye. ")), ["Hello,", "world!", "Bye."]),
    (lambda: text.escape_table_cell(F.lit("3.5 a|b")), "3.5 a\\|b"),
    (lambda: text.escape_table_cell(F.lit("# x")), "# x"),
    (lambda: text.escape_markdown(F.lit("# heading\n1. item")), "\\# heading\n1\\. item"),
    (lambda: text.emphasize(F.lit(" a b "), bold=True), " **a b** "),
    (lambda: text.emphasize(F.lit("x"), italic=True, script="super"), "<sup>*x*</sup>"),
    (lambda: text.emphasize(F.lit("  "), bold=True), "  "),
    (lambda: text.filter_disallowed_html(F.lit("<script>a</SCRIPT ><b>")), "&lt;script>a&lt;/SCRIPT ><b>"),
    (lambda: text.strip_json_fence(F.lit(" ```json\n{}\n``` ")), "{}"),
    (lambda: text.strip_json_fence(F.lit("say ```x```")), "say ```x```"),
    (lambda: text.strip_non_xml(F.lit("a\x00b\x0bc")), "abc"),
    (lambda: text.contains_private_use(F.lit("a")), True),
    (lambda: text.escape_link_destination(F.lit("a b<c")), "<a b\\<c>"),
    (lambda: numbers.make_number(F.lit(" 1,5x")), 1.5),
    (lambda: numbers.make_number(F.lit("1,234,5")), 1.234),
    (lambda: numbers.make_number(F.lit("x")), None),
    (lambda: numbers.number_format(F.lit("-1234.5"), 2, 0, 2, "$", True), "($1,234.50)"),
    (lambda: numbers.number_format(F.lit("-1234.5"), 2, 4, 0, "", True), "-1'234.50"),
    (lambda: numbers.number_format(F.lit("abc"), 2, 0), ""),
    (lambda: numbers.percent_format(F.lit("0.256"), 1, 0), "25.6%"),
    (lambda: numbers.percent_format(F.lit("?"), 1, 0), "%"),
    (lambda: numbers.special_format(F.lit("123456789"), 3), "123-45-6789"),
    (lambda: numbers.special_format(F.lit("5551234567"), 2), "(555) 123-4567"),
    (lambda: numbers.special_format(F.lit("5551234"), 2), "555-1234"),
    (lambda: numbers.special_keystroke(F.lit("12345-6789"), 1), True),
    (lambda: numbers.special_keystroke(F.lit("1234"), 0), False),
    (lambda: numbers.number_keystroke(F.lit("1,5"), 2), True),
    (lambda: numbers.range_validate(F.lit("7"), 1, 5), False),
    (lambda: numbers.range_validate(F.lit(" "), 1, 5), True),
    (lambda: numbers.bates(F.lit(42)), "000042"),
    (lambda: numbers.bates(F.lit(12345678)), "12345678"),
    (lambda: numbers.roman(F.lit(1994)), "mcmxciv"),
    (lambda: numbers.alpha(F.lit(28)), "bb"),
    (lambda: dates.pdf_date_to_iso(F.lit("D:20240131120000+01'30'")), "2024-01-31T12:00:00+01:30"),
    (lambda: dates.pdf_date_to_iso(F.lit("D:2024013112")), "2024-01-31T12:00"),
    (lambda: dates.pdf_date_to_iso(F.lit("D:20241301")), None),
    (lambda: dates.iso_to_pdf_date(F.lit("2024-01-31T12:00:00.5Z")), "D:20240131120000Z"),
    (lambda: dates.iso_instant(F.lit("1970-01-02T00:00:00.25+01:00")), 82800250),
    (lambda: dates.same_instant(F.lit("2024-01-01T00:00:00.9Z"), F.lit("2024-01-01T01:00:00+01:00")), True),
    (lambda: dates.is_metadata_date(F.lit("2024-13-40")), True),
    (lambda: dates.is_metadata_date(F.lit("2024-01-01T12Z")), True),
    (lambda: dates.is_metadata_date(F.lit("2024-01-01T12:30+")), False),
    (lambda: dates.is_metadata_date(F.lit("2024\n")), False),
    (lambda: dates.pdf_date_to_iso(F.lit(" 20240603 ")), "2024-06-03"),
    (lambda: dates.pdf_date_to_iso(F.lit("D:20240231")), None),
    (lambda: dates.pdf_date_to_iso(F.lit("D:20240229")), "2024-02-29"),
    (lambda: dates.pdf_date_to_iso(F.lit("D:19000229")), None),
    (lambda: dates.pdf_date_to_iso(F.lit("D:2024010112+99'99'")), None),
    (lambda: dates.pdf_date_to_iso(F.lit("D:2024010112+0130")), "2024-01-01T12:00+01:30"),
    (lambda: dates.pdf_date_to_iso(F.lit("D:2024010112-01'")), "2024-01-01T12:00-01:00"),
    (lambda: dates.pdf_date_to_iso(F.lit("D:20240101Z")), None),
    (lambda: dates.pdf_date_to_iso(F.lit("D:202401011")), None),
    (lambda: dates.pdf_date_to_iso(F.lit("D:2024010112+01'3")), None),
    (lambda: dates.pdf_date_to_iso(F.lit("")), None),
    (lambda: dates.pdf_date_to_iso(F.lit(None).cast("string")), None),
    (lambda: dates.iso_to_pdf_date(F.lit("2024-02-31")), None),
    (lambda: dates.iso_to_pdf_date(F.lit("2024-02-29T10:20")), "D:202402291020"),
    (lambda: dates.iso_to_pdf_date(F.lit("2024-02T10:20")), None),
    (lambda: dates.iso_to_pdf_date(F.lit("2024-02-29T10")), None),
    (lambda: dates.iso_to_pdf_date(F.lit("2024-02-29T10:20:30.")), None),
    (lambda: dates.iso_instant(F.lit("2024-02-31")), None),
    (lambda: dates.iso_instant(F.lit("0001-01-01")), -62135596800000),
    (lambda: numbers.bates(F.lit(7)), "000007"),
    (lambda: tables.page_range("3-", F.lit(5)), [3, 4, 5]),
    (lambda: tables.page_range("3,1-2,1", F.lit(5)), [1, 2, 3]),
    (lambda: tables.delimiter_row(F.lit("| :-- | --: | :-: | - |")), ["left", "right", "center", "none"]),
    (lambda: tables.delimiter_row(F.lit("| a | b |")), None),
    (lambda: tables.body_row(F.lit("| a | b\\|c |"), F.lit(3)), ["a", "b|c", ""]),
    (lambda: tables.default_scope(F.lit(0), F.lit(2)), "Column"),
    (lambda: readers.data_uri(F.lit("data:text/plain;BASE64,aGk=")), bytearray(b"hi")),
    (lambda: readers.data_uri(F.lit("data:,a%20b+c")), bytearray(b"a b+c")),
    (lambda: readers.data_uri(F.lit("data:a")), None),
    (lambda: readers.ascii_hex(F.lit("48 6 9 7>zz")), bytearray(b"Hip")),
])
def test_column(spark, column, want):
    assert value(spark, column()) == want


@pytest.mark.parametrize(("tag", "wanted", "hit"), [
    ("en-US", "en", True), ("english", "en", False), ("EN-us", "en-US", True), ("en", "en-US", False), ("", "*", False),
    ("zh-Hans-CH", "*-CH", True), ("en-a-bbb-x-a-ccc", "en-*-ccc", False), ("de-Latn-DE-1996", "de-DE", True), ("de-x-DE", "de-DE", False), (None, "en", False),
])
def test_lang_matches(spark, tag, wanted, hit):
    assert value(spark, text.lang_matches(F.lit(tag).cast("string"), F.lit(wanted))) is hit


def test_find_ranges(spark):
    got = lambda s, t, **k: [tuple(r) for r in value(spark, text.find_ranges(F.lit(s), t, **k))]
    assert len(got("Hello HELLO hello", "hello", ignore_case=True)) == 3
    assert got("cat concat cat_x cats cat. 9cat cat", "cat", whole_word=True) == [(0, 3), (22, 25), (32, 35)]
    assert got("ba a a", "a a", whole_word=True) == [(3, 6)]
    assert got("日本 a", "a") == [(3, 4)]


@pytest.mark.parametrize("spec", ["1,,2", "a", "3-1", "0", ""])
def test_bad_page_range(spec):
    with pytest.raises(ValueError):
        tables.page_range(spec, F.lit(5))


def test_bm25(spark):
    rank = lambda texts, q: [r["doc_id"] for r in retrieval.rank(retrieval.bm25(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), q), 9).collect()]
    assert rank(["the cat sat", "a dog barked at the dog", "bird"], "dog barked")[0] == 1
    assert rank(["alpha alpha", "alpha zeta", "alpha"], "alpha zeta")[0] == 1
    assert rank(["a", "b", "c"], "zzz") == [0, 1, 2]
    assert rank([], "x") == []


def test_simple_calculate(spark):
    df = spark.createDataFrame([("1e16",), ("1",), ("-1e16",), ("x",)], "t string")
    got = df.agg(*[numbers.simple_calculate(k, F.col("t")).alias(k) for k in ("SUM", "AVG", "MIN", "MAX")]).first()
    assert (got["SUM"], got["AVG"]) == (1.0, 0.25)
    assert numbers.simple_calculate("MEDIAN", F.col("t")) is not None
    assert df.limit(0).agg(numbers.simple_calculate("SUM", F.col("t")).alias("v")).first()["v"] == 0


def test_dedup_fixpoint(spark):
    # 1 and 2 are equal, so 3 and 4, which refer to them, become equal
    objects = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "id long, payload string")
    refs = spark.createDataFrame([(3, 0, 1), (4, 0, 2)], "src long, pos int, dst long")
    assert sorted(map(tuple, hygiene.dedup_to_fixpoint(objects, refs).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_global_row_number(spark):
    got = global_row_number(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")), "x", parts=7).orderBy("x").collect()
    assert [r["row_number"] for r in got] == list(range(1, 1001))


def test_prune_veto(spark):
    r, u = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a",)], "name string")
    veto = lambda v: spark.createDataFrame([(v,)], "veto boolean")
    assert [x[0] for x in relations.prune_unused(r, u, veto(False)).collect()] == ["b"]
    assert relations.prune_unused(r, u, veto(True)).count() == 0


def test_chunks():
    assert sequences.split_oversized("aa\n\nbb\ncc", 8) == ["aa", "bb\ncc"]
    assert sequences.split_oversized("abcdefghij", 4) == ["abcd", "efgh", "ij"]
    assert sequences.split_oversized(" \n ", 100) == []
    assert sequences.pack_texts(["aaa", "bbb", "ccc"], 8) == ["aaa\n\nbbb", "ccc"]
    pages = [(1, "alpha"), (2, "beta")]
    assert [p for p, _ in sequences.pack_pages(pages, 100)] == [[1, 2]]
    assert len(sequences.pack_pages(pages, 20)) == 2
    body = " ".join(f"word{i}" for i in range(600))
    w = sequences.window_text(body)
    assert all(len(x) <= 1500 for x in w) and set(" ".join(w).split()) == set(body.split())


def test_diff():
    ops = lambda a, b, **k: [(r["op"], r["old"] or r["new"]) for r in sequences.diff(a.split(), b.split(), **k)]
    assert ops("a b c", "a x c") == [("equal", ["a"]), ("delete", ["b"]), ("insert", ["x"]), ("equal", ["c"])]
    s = sequences.diff_stats(sequences.diff("a b c d e".split(), "a x c e f".split()))
    assert (s["equal"], s["deleted"], s["inserted"], s["changes"]) == (3, 2, 2, 3)
    rng = random.Random(42)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
        for semantic in (False, True):
            runs = sequences.diff(a, b, semantic)
            assert [x for r in runs for x in r["old"]] == a and [x for r in runs for x in r["new"]] == b
            if not semantic:
                assert sum(len(r["old"] or r["new"]) for r in runs if r["op"] != "equal") == len(a) + len(b) - 2 * lcs[-1][-1]
    # of equal spellings of an edit the leftmost
    assert ops("a a c", "a x a c") == [("equal", ["a"]), ("insert", ["x"]), ("equal", ["a", "c"])]
    assert ops("a b c", "a b x a b c") == [("insert", ["a", "b", "x"]), ("equal", ["a", "b", "c"])]
    # past the bound only the common ends are kept
    assert ops("p a b q", "p c d q", most=0) == [("equal", ["p"]), ("delete", ["a", "b"]), ("insert", ["c", "d"]), ("equal", ["q"])]
    assert sequences.is_minimal(["a"], ["b"]) and not sequences.is_minimal(["a"], ["b"], most=0)
    runs = sequences.diff("a b c".split(), "a x c".split())
    assert sequences.report(runs, "html") == "a <del>b</del> <ins>x</ins> c"


def test_changes_that_can_meet_are_one():
    for seed in range(6):
        rng = random.Random(seed)
        a = [rng.choice("ab") for _ in range(6000)]
        b = [f"\u00a4{i}" if i % 97 == 96 else x for i, x in enumerate(a)]
        runs, minimal = sequences.compared(a, b)
        s = sequences.diff_stats(runs)
        assert (s["deleted"], s["inserted"], s["changes"], minimal) == (61, 61, 61, True)
        assert [x for r in runs for x in r["old"]] == a and [x for r in runs for x in r["new"]] == b


def test_diff_searched_from_both_ends(monkeypatch):
    monkeypatch.setattr(sequences, "TABLE_BITS", 0)
    test_diff_lengths()


def test_diff_lengths():
    rng = random.Random(7)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        pairs, _ = sequences.matches(a, b)
        assert len(pairs) == row[-1] and all(a[i] == b[j] for i, j in pairs)


def test_masks_and_dates():
    assert sequences.apply_mask("999-9999", "555 1234") == "555-1234"
    assert sequences.apply_mask(">A<A*", "ab1") == "Ab1"
    assert sequences.print_date("dd.mm.yyyy HH:MM tt", 2024, 2, 9, 15, 5) == "09.02.2024 15:05 pm"
    assert sequences.scan_date("dd.mm.yyyy", "09.02.2024") == (2024, 2, 9, 0, 0, 0)
    assert sequences.scan_date("m/d/yy h:MM tt", "2/9/24 3:05 pm") == (2024, 2, 9, 15, 5, 0)
    assert sequences.scan_date("mm/dd/yyyy", "13/01/2024") == (2025, 1, 1, 0, 0, 0)
    assert sequences.scan_date("dd.mm.yyyy", "09.02.2024x") is None
    assert sequences.scan_date("m" + "d" * 25, "1" * 48) is None
    assert sequences.list_labels([(0, "%1."), (1, "%1.%2"), (1, "%1.%2"), (0, "%1."), (1, "%1.%2")]) == ["1.", "1.1", "1.2", "2.", "2.1"]


def test_tables_grid():
    assert tables.grid_issue([[(1, 2)], [(1, 1), (1, 1)]]) is None
    assert "wider" in tables.grid_issue([[(1, 1)], [(1, 2)]])
    assert "beyond" in tables.grid_issue([[(2, 1)]])
    assert "reaches 1" in tables.grid_issue([[(1, 2)], [(1, 1)]])


def test_parsers():
    page = "<html lang=en><head><title>T</title><script>x<y</script></head><body><p>a <b>b<p>c<br>d &amp; e</body>"
    assert parsers.html_text(page) == "a b\nc\nd & e"
    assert parsers.html_links('<a href="/x">one <i>two</i></a><a>no</a>') == [("/x", "one two")]
    rows = parsers.html_nodes('<div lang="fr"><p lang=""><i>x</i></p><b>y</b></div>')
    lang = {r["name"]: parsers.language_of(rows, r["node_id"]) for r in rows if r["kind"] == "element"}
    assert lang == {"div": "fr", "p": None, "i": None, "b": "fr"}
    assert parsers.rich_text_to_plain("<p>a</p><p>b</p>") == "a\nb"
    assert parsers.rich_text_to_plain("<p>a<b>x</b>y</p>") == "axy"
    assert parsers.rich_text_to_plain("<p>a   \n  b</p>") == "a b"
    assert parsers.rich_text_to_plain("<p>a") is None
    kinds = [(b["kind"], b["level"]) for b in parsers.markdown_blocks("# h\ntext\nmore\n\n- a\n- b\n> q\n```\ncode\n```\n---\n| a | b |\n|---|---|\n| 1 | 2 |\n\nunder\n===")]
    assert kinds == [("heading", 1), ("paragraph", 0), ("item", 0), ("item", 0), ("quote", 0), ("code", 0), ("rule", 0), ("table", 0), ("heading", 1)]
    assert parsers.xml_leaves("<a><b>1</b><b>2</b><c><d/></c></a>") == [("a.b[0]", "1"), ("a.b[1]", "2"), ("a.c[0].d[0]", "")]
    assert parsers.xml_leaves("<a>") == []
    assert parsers.read_xfdf(parsers.write_xfdf([("a.b", "1"), ("a.c", "<2>")])) == [("a.b", "1"), ("a.c", "<2>")]
    assert parsers.sniff_charset(b"\xef\xbb\xbfx") == "utf-8" and parsers.sniff_charset(b"\xff\xfex") == "utf-16-le"
    assert parsers.sniff_charset(b'<meta charset="utf-16">') == "utf-8" and parsers.sniff_charset(b"<meta charset=latin1>") == "cp1252"
    assert parsers.decode_html(b"\xff") == "�"


def test_readers(spark, tmp_path):
    ship(spark)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.txt", "1")
        z.writestr("d/two.txt", "2")
    got = readers.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted((r["name"], bytes(r["data"])) for r in got) == [("d/two.txt", b"2"), ("one.txt", b"1")]
    (tmp_path / "ok.txt").write_bytes(b"\xef\xbb\xbfok")
    (tmp_path / "wide.txt").write_bytes("﻿é".encode("utf-16-le"))
    (tmp_path / "bad.txt").write_bytes(b"\xff\x80\x80")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["status"]) for r in readers.read_text_files(spark, f"file://{tmp_path}").collect()}
    assert got["ok.txt"] == ("ok", "ok") and got["wide.txt"] == ("é", "ok") and got["bad.txt"][1] == "malformed"
    fields = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "y")], "form int, name string, value string")
    readers.write_forms(fields, f"file://{tmp_path}/forms")
    assert spark.read.json(f"file://{tmp_path}/forms").count() == 2
    assert readers.write_xfdf(fields).count() == 2


def test_streams(spark, tmp_path):
    d = f"file://{tmp_path}"
    schema = "k long, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(f"{d}/in")
    q = changes.apply_snapshots(spark.readStream.schema(schema).parquet(f"{d}/in"), f"{d}/out", "k", f"{d}/ck")
    q.awaitTermination(60)
    spark.createDataFrame([(2, "B"), (3, "c")], schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    changes.apply_snapshots(spark.readStream.schema(schema).parquet(f"{d}/in"), f"{d}/out", "k", f"{d}/ck").awaitTermination(60)
    got = sorted((r["batch"], r["k"], r["change"]) for r in spark.read.parquet(f"{d}/out").collect())
    assert got == [(0, 1, "added"), (0, 2, "added"), (1, 1, "freed"), (1, 2, "replaced"), (1, 3, "added")]


def test_long_differences():
    rng = random.Random(7)

    def edited(n, edits):
        a = [f"t{rng.randrange(5000)}" for _ in range(n)]
        b = list(a)
        for _ in range(edits):
            b[rng.randrange(n)] = "EDIT"
        return a, b

    for n, edits in ((50_000, 200), (50_000, 2), (25_000, 10)):
        a, b = edited(n, edits)
        began = time.process_time()
        runs, minimal = sequences.compared(a, b)
        assert minimal and time.process_time() - began < 2
        s = sequences.diff_stats(runs)
        assert s["deleted"] == s["inserted"] == sum(x != y for x, y in zip(a, b, strict=True))
    body = [f"w{i}" for i in range(20_000)]
    runs, minimal = sequences.compared([*body, "old", *body], [*body, "new", *body], most=10)
    assert minimal and [r["op"] for r in runs] == ["equal", "delete", "insert", "equal"]
    a, b = "a b c d e f g h".split(), "h g f e d c b a".split()
    runs, minimal = sequences.compared(a, b, most=1)
    assert not minimal and [x for r in runs for x in r["old"]] == a and [x for r in runs for x in r["new"]] == b


def test_differences_by_every_way(monkeypatch):
    """Tables, middles and halves find equally many matches."""
    rng = random.Random(3)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(60))], [rng.choice("abcd") for _ in range(rng.randrange(60))]) for _ in range(60)]
    want = [len(sequences.matches(a, b)[0]) for a, b in pairs]
    monkeypatch.setattr(sequences, "TABLE_BITS", 0)
    for (a, b), n in zip(pairs, want, strict=True):
        got, whole = sequences.matches(a, b)
        assert whole and len(got) == n and all(a[i] == b[j] for i, j in got)
    monkeypatch.undo()
    a, b = ([rng.randrange(300) for _ in range(3000)] for _ in range(2))
    n = len(sequences.matches(a, b)[0])
    monkeypatch.setattr(sequences, "STEP", 1e-9)  # the search from both ends never ends early
    assert len(sequences.matches(a, b)[0]) == n


def test_split_oversized_places():
    assert sequences.split_oversized("aa\n\nbb\ncc", 8) == ["aa", "bb\ncc"]
    assert sequences.split_oversized("abcdefghij", 4) == ["abcd", "efgh", "ij"]
    assert sequences.split_oversized("  \n ", 5) == [] and sequences.split_oversized("a b c", 100) == ["a b c"]
    for most in (1, 3, 7):
        text_ = "one two\n\nthree\nfour  five sixseveneight"
        got = sequences.split_oversized(text_, most)
        assert all(0 < len(x) <= most for x in got) and "".join("".join(got).split()) == "".join(text_.split())


def test_canonical_maps_differ(spark):
    maps = [{"a": "1 b=2"}, {"a": "1", "b": "2"}, {"a": None}, {"a": ""}, {}, {"a=": "1"}, {"a": "=1"}, {"a\\": "1"}, {"b": "2", "a": "1"}]
    df = spark.createDataFrame([(m,) for m in maps], "m map<string,string>")
    got = [r[0] for r in df.select(checks.canonical(F.col("m"))).collect()]
    assert got[1] == got[8] and len(set(got)) == len(maps) - 1


def test_simple_calculate_of_huge_values(spark):
    df = spark.createDataFrame([("9" * 17,)] * 3 + [("1e29",)] * 20 + [("5",)], "t string")
    got = df.agg(numbers.simple_calculate("SUM", F.col("t")).alias("s")).first()["s"]
    assert got == 0 or got >= 3 * (10**17 - 1)
    big = spark.createDataFrame([("9" * 17 + "." + "9",)] * 30, "t string").agg(numbers.simple_calculate("SUM", F.col("t")).alias("s")).first()["s"]
    assert abs(big - 30e17) < 1e4


def test_specificity_of_negations():
    assert values.specificity("a:not(.b)") == 101 and values.specificity("p:not(#x):hover") == 10101
