"""Queries over functions of single values, on inputs whose results SQL knows."""

from __future__ import annotations

import base64
import zlib

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import dates, numbers, sequences, text, values
from textloom.operators import exports, sequential, tables
from textloom.plans.structures import query as _query
from textloom.sources import parsers, pdf, readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    return _query(sql, QUERIES, ORACLES)


def _rows(read, inputs, make, schema, table="part", key="p_partkey"):
    """A Python function over columns made from a table's key."""
    cols = {f"a{i}": c for i, c in enumerate(inputs)}
    return sequential.explode_rows(read(table).select(key, *[c.alias(n) for n, c in cols.items()]), [key], list(cols), lambda *a: [make(*a)], schema)


def _k():
    return F.col("p_partkey")


def _ks():
    return _k().cast("string")


@query("SELECT p_partkey, ' **' || p_type || '** ' AS bold, '***' || p_type || '***' AS both, '<sup>*' || p_type || '*</sup>' AS raised, '  ' AS blank FROM part")
def emphasis(read):
    t = F.col("p_type")
    return read("part").select("p_partkey", text.emphasize(F.concat(F.lit(" "), t, F.lit(" ")), bold=True).alias("bold"), text.emphasize(t, True, True).alias("both"), text.emphasize(t, italic=True, script="super").alias("raised"), text.emphasize(F.lit("  "), bold=True).alias("blank"))


@query("SELECT p_partkey, 'a&b<' || p_partkey || '>AB&bogus;&#xD800;' AS plain FROM part")
def xml_references(read):
    return _rows(read, [F.concat(F.lit("a&amp;b&lt;"), _ks(), F.lit("&gt;&#65;&#x42;&bogus;&#xD800;"))], lambda t: (values.unescape_xml(t),), "plain string")


@query("SELECT p_partkey, repeat('x', CAST(p_partkey % 10 AS INT)) || repeat(chr(160), CAST(8 - p_partkey % 10 % 8 AS INT)) || 'y' AS line FROM part")
def tab_stops(read):
    return _rows(read, [F.concat(F.repeat(F.lit("x"), (_k() % 10).cast("int")), F.lit("\ty"))], lambda t: (values.expand_tabs(t),), "line string")


@query("SELECT doc_id, sha256(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') || 'ab') AS clean FROM documents")
def xml_characters(read):
    return read("documents").select("doc_id", F.sha2(text.strip_non_xml(F.concat("text", F.lit("a\x01b￾"))), 256).alias("clean"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'odd,when' ELSE 'when' END AS unknown FROM part")
def template_tokens(read):
    t = F.concat(F.lit("{page} {{x} {when}"), F.when(_k() % 2 == 0, "{odd}").otherwise(""))
    return _rows(read, [t], lambda t: (",".join(values.unknown_tokens(t, {"page"})),), "unknown string")


@query("""SELECT p_partkey, p_partkey % 4 <> 3 AS number_dot, p_partkey % 4 IN (0, 1, 3) AS number_comma, p_partkey % 3 <> 2 AS zip, p_partkey % 5 IN (0, 1) AS ssn FROM part""")
def keystrokes(read):
    n = F.when(_k() % 4 == 0, "").when(_k() % 4 == 1, "12").when(_k() % 4 == 2, "1.5").otherwise("-1,5")
    zip_ = F.when(_k() % 3 == 0, "12345").when(_k() % 3 == 1, " 123-45").otherwise("1234")
    ssn = F.when(_k() % 5 == 0, "123-45-6789").when(_k() % 5 == 1, "123456789").otherwise(_ks())
    return read("part").select("p_partkey", numbers.number_keystroke(n, 0).alias("number_dot"), numbers.number_keystroke(n, 2).alias("number_comma"), numbers.special_keystroke(zip_, 0).alias("zip"), numbers.special_keystroke(ssn, 3).alias("ssn"))


@query("SELECT p_partkey, 't=' || CAST(p_size + 0.5 AS VARCHAR) || ',m=' || p_size AS changed, 'u' AS unknown FROM part")
def recalculated_fields(read):
    scripts = [("t", 'AFSimple_Calculate("SUM", "a")'), ("m", "AFSimple_Calculate('MAX', ['a.x', 'a.y'])"), ("u", "f()")]

    def make(n):
        changed, unknown = values.recalculate({"a.x": str(n), "a.y": "0,5", "ab": "9", "t": "", "m": ""}, scripts)
        return ",".join(f"{k}={v}" for k, v in changed.items()), ",".join(unknown)

    return _rows(read, [F.col("p_size")], make, "changed string, unknown string")


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS same, o_orderkey % 12 NOT IN (0, 9, 10, 11) AS shape FROM orders""")
def date_comparisons(read):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey")
    other = F.when(k % 3 == 0, F.concat(iso, F.lit(".25Z"))).when(k % 3 == 1, F.concat(iso, F.lit("+01:00"))).otherwise("n/a")
    shapes = ("2024/01/01", "2024-13-40", "", "2024-1-1", "-2024", "2024-01-01T12Z", "2024-01-01T12:30+05", "2024-01-01T1:2:3.4-5:6", None, "2024-", "2024-01-01T", "2024-01-01T12:30+")
    shape = F.coalesce(F.element_at(F.array(*[F.lit(x) for x in shapes]), (k % 12 + 1).cast("int")), F.concat(iso, F.lit("Z")))
    return read("orders").select("o_orderkey", dates.same_instant(F.concat(iso, F.lit("Z")), other).alias("same"), dates.is_metadata_date(shape).alias("shape"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN epoch_ms(o_orderdate) - 5400000 WHEN 1 THEN epoch_ms(date_trunc('year', o_orderdate)) END AS instant, CASE WHEN o_orderkey % 3 = 2 THEN 'last year' END AS raw FROM orders""")
def document_dates(read):
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+01'30'"))).when(k == 1, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyy"))).otherwise("last year")
    return read("orders").select("o_orderkey", dates.parse_pdf_date(t).alias("d")).select("o_orderkey", "d.instant", "d.raw")


@query("SELECT p_partkey, p_type AS plain, CAST(p_partkey % 10 AS VARCHAR) || '0' AS odd, CAST(NULL AS VARCHAR) AS bad FROM part")
def hex_texts(read):
    h = F.hex(F.encode("p_type", "utf-8"))
    spaced = F.concat(F.substring(h, 1, 3), F.lit(" \n"), F.substring(h, F.lit(4), F.length(h)), F.lit(">junk"))
    return read("part").select("p_partkey", F.decode(readers.ascii_hex(spaced), "utf-8").alias("plain"), F.hex(readers.ascii_hex((_k() % 10).cast("string"))).alias("odd"), F.hex(readers.ascii_hex(F.lit("4g"))).alias("bad"))


def _lzw(data: bytes) -> bytes:
    """Literal codes only, a new table every 200 bytes."""
    bits = "".join(f"{256:09b}" + "".join(f"{b:09b}" for b in data[i : i + 200]) for i in range(0, len(data), 200)) + f"{257:09b}"
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@query("SELECT p_partkey, p_type AS a85, p_type AS run, p_type AS lzw, p_type AS flate, repeat(substr(p_type, 1, 4), 3) AS rows_up, 'DCTDecode' AS codec FROM part")
def stream_filters(read):
    def make(t):
        b = t.encode()
        row = b[:4]
        up = b"\x02" + row + (b"\x02" + bytes(4)) * 2
        left = pdf.decode(zlib.compress(up), ["FlateDecode"], [{"Predictor": 12, "Columns": 4}])[0]
        one = lambda data, *names: pdf.decode(data, list(names), [])[0].decode()
        return (
            one(base64.a85encode(b) + b"~>", "A85"), one(bytes([len(b) - 1]) + b + b"\x80", "RunLengthDecode"), one(_lzw(b), "LZWDecode"),
            one(zlib.compress(b).hex().encode() + b">", "ASCIIHexDecode", "FlateDecode"), left.decode(), pdf.decode(b, ["DCTDecode"], [])[1],
        )

    return _rows(read, [F.col("p_type")], make, "a85 string, run string, lzw string, flate string, rows_up string, codec string")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'left,center,right,none' END AS kinds, p_type || ';a|b;' AS body, CASE WHEN p_partkey % 3 = 0 THEN 'Both' WHEN p_partkey % 3 = 1 THEN 'Column' ELSE 'Row' END AS scope, p_type || ';a|b' AS cells FROM part""")
def table_lines(read):
    rule = F.when(_k() % 3 == 0, "| :-- | :-: | --: | --- |").when(_k() % 3 == 1, "| :-- | x |").otherwise("---")
    line = F.concat(F.lit("| "), "p_type", F.lit(" | a\\|b |"))
    scope = tables.default_scope(F.when(_k() % 3 == 2, 1).otherwise(0), F.when(_k() % 3 == 1, 1).otherwise(0))
    native = read("part").select("p_partkey", F.array_join(tables.delimiter_row(rule), ",").alias("kinds"), F.array_join(tables.body_row(line, F.lit(3)), ";").alias("body"), scope.alias("scope"))
    return native.join(_rows(read, [line], lambda t: (";".join(values.split_row(t)),), "cells string"), "p_partkey")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-be' WHEN 2 THEN 'koi8-r' WHEN 3 THEN 'cp1252' ELSE 'utf-8' END AS charset FROM part")
def page_charsets(read):
    data = F.when(_k() % 5 == 0, F.unhex(F.lit("EFBBBF41"))).when(_k() % 5 == 1, F.unhex(F.lit("FEFF0041"))).when(_k() % 5 == 2, F.lit('<meta charset="koi8-r">').cast("binary")).when(_k() % 5 == 3, F.lit("<META http-equiv=x content='text/html; charset=latin1'>").cast("binary")).otherwise(F.lit("<meta charset=utf-16>").cast("binary"))
    return _rows(read, [data], lambda b: (parsers.sniff_charset(b),), "charset string")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 10201 WHEN 1 THEN 2 WHEN 2 THEN 101 ELSE 100 END AS weight, CASE WHEN p_partkey % 2 = 0 THEN 'red' ELSE 'blue' END AS color, CAST(p_size * 16 + 4 AS DOUBLE) AS width, 3.0 AS held FROM part")
def style_values(read):
    selector = F.when(_k() % 4 == 0, "#a .b div:hover").when(_k() % 4 == 1, "ul li").when(_k() % 4 == 2, "a[href]").otherwise(".x")

    def make(s, k, n):
        won = values.cascade([(0, ".a" if k % 2 == 0 else "p", 1, "color", "red"), (0, "p", 2, "color", "blue")])
        return values.specificity(s), won["color"], values.css_length(f"calc({n}em + 2 * 2px)", {"em": 16, "px": 1}), values.css_length("clamp(1px, 5px, 3px)", {"px": 1})

    return _rows(read, [selector, _k(), F.col("p_size")], make, "weight int, color string, width double, held double")


@query("SELECT p_partkey, p_type AS title, p_brand || ',B' AS creators, CAST(p_size AS VARCHAR) AS n, 'Grüße ' || p_size AS wide, 'Gr' || chr(252) || 'n' AS narrow FROM part")
def metadata_values(read):
    def make(title, brand, n):
        packet = f'<x xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:d="urn:d"><r:RDF><r:Description><d:title><r:Alt><r:li xml:lang="x-default">{title}</r:li></r:Alt></d:title><d:creator><r:Seq><r:li>{brand}</r:li><r:li>B</r:li></r:Seq></d:creator><d:n>{n}</d:n></r:Description></r:RDF></x>'
        got = values.rdf_properties(packet)
        return got["title"]["x-default"], ",".join(got["creator"]), got["n"], pdf.decode_text(b"\xfe\xff" + f"Grüße {n}".encode("utf-16-be")), pdf.decode_text(b"Gr\xfcn")

    return _rows(read, [F.col("p_type"), F.col("p_brand"), F.col("p_size")], make, "title string, creators string, n string, wide string, narrow string")


@query("SELECT p_partkey, CAST(3 + p_partkey % 3 AS INT) AS changed, '0,0,2,2;5,4,' || (6 + p_partkey % 3) || ',5' AS regions FROM part")
def picture_changes(read):
    def make(k):
        a = np.full((6, 9, 3), 255, np.uint8)
        b = a.copy()
        b[0, 0] = b[1, 1] = 0
        b[4, 5 : 6 + k % 3] = 0
        mask = values.diff_pixels(a, b)
        return int(mask.sum()), ";".join(",".join(map(str, r)) for r in values.changed_regions(mask))

    return _rows(read, [_k()], make, "changed int, regions string")


@query("SELECT p_partkey, '1.,1.1,1.2,2.,2.1' AS labels, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN n < 10 THEN '0' || n ELSE '' || n END WHEN 1 THEN repeat(chr(CAST(65 + (n - 1) % 26 AS INT)), CAST(floor((n - 1) / 26) + 1 AS INT)) WHEN 2 THEN '' END AS form FROM (SELECT p_partkey, p_partkey % 60 + 1 AS n FROM part)")
def list_numbers(read):
    form = F.when(_k() % 4 == 0, "decimalZero").when(_k() % 4 == 1, "upperLetter").when(_k() % 4 == 2, "none").otherwise("chicago")
    labels = _rows(read, [_k()], lambda k: (",".join(sequences.list_labels([(0, "%1."), (1, "%1.%2"), (1, "%1.%2"), (0, "%1."), (1, "%1.%2")])),), "labels string")
    return read("part").select("p_partkey", numbers.number_form(_k() % 60 + 1, form).alias("form")).join(labels, "p_partkey")


@query("SELECT p_partkey, CAST(ceil(n / 3.0) AS INT) AS chunks, CAST(CASE WHEN n >= 3 THEN 34 ELSE 12 * n - 2 END AS INT) AS longest, CAST(greatest(1, n - 1) AS INT) AS pieces FROM (SELECT p_partkey, p_partkey % 7 + 1 AS n FROM part)")
def packed_texts(read):
    def make(n):
        chunks = sequences.pack_texts(["0123456789"] * n, 34)
        return len(chunks), max(map(len, chunks)), len(sequences.split_oversized("\n\n".join(["0123456789"] * n), 22))

    return _rows(read, [_k() % 7 + 1], make, "chunks int, longest int, pieces int")


@query("SELECT c_custkey, 'a.b=' || c_mktsegment || ';a.c=' || c_custkey || ';d=<x&y>' AS fields, 'seg,' || c_mktsegment AS plain, 'id ' || c_custkey AS coded FROM customer")
def form_files(read):
    def make(segment, k):
        return (";".join(f"{n}={v}" for n, v in parsers.read_xfdf(parsers.write_xfdf([("a.b", segment), ("a.c", str(k)), ("d", "<x&y>")]))),)

    k = F.col("c_custkey")
    out = _rows(read, [F.col("c_mktsegment"), k], make, "fields string", "customer", "c_custkey")
    plain = readers.data_uri(F.concat(F.lit("data:,seg%2C"), "c_mktsegment"))
    coded = readers.data_uri(F.concat(F.lit("data:text/plain;base64,"), F.base64(F.concat(F.lit("id "), k.cast("string")).cast("binary"))))
    return out.join(read("customer").select("c_custkey", F.decode(plain, "utf-8").alias("plain"), F.decode(coded, "utf-8").alias("coded")), "c_custkey")


@query("SELECT p_partkey, p_type || chr(10) || 'b c' AS plain, CAST(NULL AS VARCHAR) AS damaged FROM part")
def rich_texts(read):
    return _rows(read, [F.concat(F.lit("<body><p>"), "p_type", F.lit("</p><p>b <b>c</b></p></body>"))], lambda t: (parsers.rich_text_to_plain(t), parsers.rich_text_to_plain("<p>" + t)), "plain string, damaged string")


@query("SELECT p_partkey, p_type AS opened, CAST(NULL AS VARCHAR) AS short FROM part")
def decrypted_texts(read):
    key = F.lit(b"0123456789abcdef")
    sealed = F.aes_encrypt(F.col("p_type").cast("binary"), key, F.lit("CBC"))
    opened = lambda c: F.when(F.octet_length(c) >= 32, F.try_aes_decrypt(c, key, F.lit("CBC")))
    return read("part").select("p_partkey", opened(sealed).cast("string").alias("opened"), opened(F.substring(sealed, 1, 20)).cast("string").alias("short"))


@query("SELECT p_partkey, round(0.2 + pow(x, 2) * 0.6, 9) AS curve, round(CASE WHEN x < 0.5 THEN 2 * x ELSE 1 - (x - 0.5) / 0.5 END, 9) AS pieces FROM (SELECT p_partkey, p_partkey % 11 / 10.0 AS x FROM part)")
def shading_functions(read):
    x = _k() % 11 / 10.0
    ramp = lambda c: numbers.exponential(c, 0.0, 1.0, 1.0)
    return read("part").select("p_partkey", F.round(numbers.exponential(x, 0.2, 0.8, 2.0), 9).alias("curve"), F.round(numbers.stitched(x, [0.5], [ramp, ramp], [(0.0, 1.0), (1.0, 0.0)]), 9).alias("pieces"))


BLOCKS_SQL = "b AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'item' WHEN 2 THEN 'code' ELSE 'paragraph' END AS kind, role AS text FROM conversations)"


def _blocks(read):
    t = F.col("turn") % 4
    return read("conversations").select("conv_id", F.col("turn").alias("ordinal"), F.when(t == 0, "heading").when(t == 1, "item").when(t == 2, "code").otherwise("paragraph").alias("kind"), F.when(t == 0, 2).otherwise(0).alias("level"), F.col("role").alias("text"))


@query(f"WITH {BLOCKS_SQL} SELECT conv_id, string_agg(CASE kind WHEN 'heading' THEN '## ' || text WHEN 'item' THEN '- ' || text WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS document FROM b GROUP BY conv_id")
def markdown_documents(read):
    return exports.to_markdown(_blocks(read), "conv_id")


@query(f"WITH {BLOCKS_SQL} SELECT conv_id, string_agg(CASE kind WHEN 'heading' THEN '<h2>' || text || '</h2>' WHEN 'item' THEN '<li>' || text || '</li>' WHEN 'code' THEN '<pre>' || text || '</pre>' ELSE '<p>' || text || '</p>' END, chr(10) ORDER BY turn) AS document FROM b GROUP BY conv_id")
def html_documents(read):
    return exports.to_html(_blocks(read), "conv_id")


@query("SELECT p_partkey, CAST(len(w) AS INT) AS equal, 1 AS inserted, CAST(len(w) AS VARCHAR) AS at FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)")
def difference_json(read):
    make = lambda t: (sequences.report_json(sequences.diff(t.split(" "), [*t.split(" "), "new"])),)
    out = _rows(read, [F.col("p_type")], make, "report string")
    get = lambda p: F.get_json_object("report", p)
    return out.select("p_partkey", get("$.stats.equal").cast("int").alias("equal"), get("$.stats.inserted").cast("int").alias("inserted"), get("$.runs[1].new_index").alias("at"))
