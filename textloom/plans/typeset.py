"""Queries over character maps, computed styles and ruled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import blocks, charmaps, exports, lattices, sequential, styles
from textloom.plans.markup import ELEMENTS_SQL, part_elements
from textloom.plans.structures import query as _query

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    return _query(sql, QUERIES, ORACLES)


# --- character maps ---------------------------------------------------------------------------

#: A map of two-byte codes; {n} is where its letters begin.
LETTER_MAP = """/CMapType 2 def % <0041> <0042> is no entry
1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfrange
<0020> <007D> <00{n}>
<00C0> <00FF> <00c0>
endbfrange
2 beginbfchar <0065> <0045 0033> <007E> <> endbfchar
1 beginbfrange <0061> <0063> [<0041> <00420062> <D83DDE00>] endbfrange
endcmap"""


@query("""WITH c AS (SELECT doc_id, ascii(lang) % 5 + 1 AS n, regexp_extract_all(text, '(?s).') AS cs FROM documents),
t AS (SELECT doc_id, len(cs) AS n_codes, list_transform(cs, lambda c: CASE WHEN c = 'a' THEN 'A' WHEN c = 'b' THEN 'Bb' WHEN c = 'c' THEN chr(128512) WHEN c = 'e' THEN 'E3' WHEN c = '~' THEN ''
  WHEN unicode(c) BETWEEN 32 AND 125 THEN chr(CAST(unicode(c) + n AS INT)) WHEN unicode(c) BETWEEN 192 AND 255 THEN c ELSE NULL END) AS ts FROM c)
SELECT doc_id, sha256(array_to_string(list_transform(ts, lambda x: coalesce(x, chr(65533))), '')) AS text_sha256, n_codes, len(list_filter(ts, lambda x: x IS NULL)) AS n_unmapped FROM t""")
def decoded_glyphs(read):
    """Whole texts as two-byte codes, each language with a map of its own."""
    docs = read("documents")
    start = F.hex((F.ascii("lang") % 5 + 33).cast("long"))
    maps = docs.select("lang").distinct().select(F.col("lang").alias("map"), F.replace(F.lit(LETTER_MAP), F.lit("{n}"), start).alias("body"))
    strings = docs.select("doc_id", F.col("lang").alias("map"), F.encode("text", "UTF-16BE").alias("data"))
    return charmaps.decode_strings(strings, ["doc_id"], maps).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "n_codes", "n_unmapped")


#: Codes of one and of two bytes; ranges that overlap; an entry of a length that no code has.
MIXED_MAP = """2 begincodespacerange <00> <7F> <8140> <9FFC> endcodespacerange
2 beginbfrange <20> <7E> <0020> <8140> <817E> <0391> endbfrange
1 beginbfrange <8150> <815F> <0410> endbfrange
2 beginbfchar <8155> <0058> <0041> <0059> endbfchar"""


@query("""SELECT p_partkey, p_name || CASE WHEN v = 63 THEN chr(65533) WHEN v = 21 THEN 'X' WHEN v BETWEEN 16 AND 31 THEN chr(CAST(1040 + v - 16 AS INT)) ELSE chr(CAST(913 + v AS INT)) END || chr(65533) || p_type || chr(65533) AS text,
CAST(length(p_name) + length(p_type) + 3 AS BIGINT) AS n_codes, CAST(CASE WHEN v = 63 THEN 3 ELSE 2 END AS BIGINT) AS n_unmapped FROM (SELECT *, p_partkey % 64 AS v FROM part)""")
def mixed_codes(read):
    """Codes of one and two bytes, bytes that belong to none, later ranges over earlier ones."""
    part = read("part")
    code = F.unhex(F.concat(F.lit("81"), F.hex(F.col("p_partkey") % 64 + 64)))
    raw = F.concat(F.encode("p_name", "UTF-8"), code, F.unhex(F.lit("80")), F.encode("p_type", "UTF-8"), F.unhex(F.lit("81")))
    maps = part.select(F.col("p_brand").alias("map")).distinct().withColumn("body", F.lit(MIXED_MAP))
    return charmaps.decode_strings(part.select("p_partkey", F.col("p_brand").alias("map"), raw.alias("data")), ["p_partkey"], maps)


# --- computed styles --------------------------------------------------------------------------------

PART_SHEET = """/* of our own */ section { font-size: 1.5em; color: navy; line-height: 150% } ul > li { font-size: 80%; font-weight: bolder }
.PROMO { color: red; margin: 1em 2px } p { line-height: 1.2; color: inherit } @media print { p { color: lime } } li.LARGE { font-size: 20px; color: initial !important } li { color: nonsense }"""
PART_STYLE = "color: #0A0; font-weight: 300"


@query(f"""WITH RECURSIVE {ELEMENTS_SQL}, w AS (SELECT e.*, coalesce(u.name = 'ul' AND e.name = 'li', FALSE) AS listed, e.name = 'li' AND e.cls = 'LARGE' AS large, e.brand LIKE '%3' AS own FROM e LEFT JOIN e u ON u.page = e.page AND u.node = e.parent),
r AS (SELECT w.page, w.node, 16.0::DOUBLE AS size, CASE WHEN own THEN 300 ELSE 400 END AS weight, CASE WHEN own THEN '#00aa00' WHEN cls = 'PROMO' THEN '#ff0000' ELSE '#000000' END AS tint, 'normal' AS line, w.cls FROM w WHERE node = 0
UNION ALL SELECT w.page, w.node, CASE WHEN large THEN 20 WHEN listed THEN r.size * 0.8 WHEN w.name = 'section' THEN r.size * 1.5 ELSE r.size END,
  CASE WHEN own THEN 300 WHEN listed THEN CASE WHEN r.weight < 350 THEN 400 WHEN r.weight < 550 THEN 700 ELSE 900 END ELSE r.weight END,
  CASE WHEN large THEN '#000000' WHEN own THEN '#00aa00' WHEN w.cls = 'PROMO' THEN '#ff0000' WHEN w.name = 'section' THEN '#000080' ELSE r.tint END,
  CASE WHEN w.name = 'section' THEN round(1.5 * 1.5 * r.size, 6) || 'px' WHEN w.name = 'p' THEN '1.2' ELSE r.line END, w.cls FROM r JOIN w ON w.page = r.page AND w.parent = r.node)
SELECT page, node, round(size, 6) AS font_size, CAST(weight AS INT) AS font_weight, tint AS color, line AS line_height, CASE WHEN cls = 'PROMO' THEN round(size, 6) || 'px' ELSE '0px' END AS margin_top FROM r""")
def computed_styles(read):
    """A sheet and styles of single elements over pages made of the parts: sizes, weights, colours, margins."""
    e = part_elements(read)
    own = F.when(F.col("attrs")["data-brand"].endswith("3"), F.map_concat("attrs", F.create_map(F.lit("style"), F.lit(PART_STYLE)))).otherwise(F.col("attrs"))
    out = styles.computed(e.withColumn("attrs", own), styles.sheet(PART_SHEET))
    value = lambda name: F.col("style")[name].alias(name.replace("-", "_"))
    return out.select("page", "node", F.round("font_size", 6).alias("font_size"), "font_weight", value("color"), value("line-height"), value("margin-top"))


@query()
def page_styles(read):
    """What a program without sheets shows of the elements of whole pages."""
    out = styles.computed(sequential.html_elements(read("pages")), styles.sheet(styles.PROGRAM_SHEET, program=True), "page_id")
    return out.select("page_id", "node", "font_size", "font_weight", F.col("style")["display"].alias("display"), F.col("style")["margin-top"].alias("margin_top"))


# --- tables from strokes ------------------------------------------------------------------------

#: A part draws a table: four on a page, rows and columns by its size, some with a wide first cell, some with a table in the last cell.
TABLES_SQL = """p AS (SELECT p_partkey // 4 AS page, p_partkey % 4 AS slot, 2 + p_size % 3 AS nr, 2 + p_size % 2 AS nc, p_size % 5 = 0 AS spans, p_size % 7 = 0 AS nests, p_brand, p_type, CAST(row_number() OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey % 4 // 2 DESC, p_partkey % 2) - 1 AS VARCHAR) AS t FROM part)"""


@query(f"""WITH {TABLES_SQL}, g AS (SELECT *, unnest(range(nr)) AS r FROM p), c AS (SELECT *, unnest(range(nc)) AS c FROM g)
SELECT page, t AS "table", CAST(0 AS INT) AS depth, CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(1 AS INT) AS tall, CAST(CASE WHEN spans AND r = 0 AND c = 0 THEN 2 ELSE 1 END AS INT) AS wide,
  CASE WHEN nests AND r = nr - 1 AND c = nc - 1 THEN '' WHEN spans AND r = 0 AND c = 0 THEN p_brand || ' 0 0 ' || p_brand || ' 0 1' ELSE p_brand || ' ' || r || ' ' || c END AS text FROM c WHERE NOT (spans AND r = 0 AND c = 1)
UNION ALL SELECT page, t || '/' || (nr - 1) || ',' || (nc - 1), 1, CAST(i // 2 AS INT), CAST(i % 2 AS INT), 1, 1, CASE WHEN i = 2 THEN p_type ELSE '' END FROM p, range(4) AS k(i) WHERE nests""")
def ruled_tables(read):
    """Several tables a page from strokes: split lines, wide cells, tables in cells, and the text of each cell."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = read("part").select(
        F.floor(k / 4).alias("page"), k, "p_brand", "p_type", (k % 2 * 300).cast("double").alias("x"), (F.floor(k % 4 / 2) * 400 + 300).cast("double").alias("y"),
        (2 + size % 3).alias("nr"), (2 + size % 2).alias("nc"), (size % 5 == 0).alias("spans"), (size % 7 == 0).alias("nests"),
    )
    x, y, w, h = F.col("x"), F.col("y"), F.col("nc") * 40, F.col("nr") * 20
    line = lambda x0, y0, x1, y1: F.struct(*[e.cast("double").alias(n) for e, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])
    flat = F.transform(F.sequence(F.lit(0), "nr"), lambda i: F.array(line(x, y - i * 20, x + 50, y - i * 20), line(x + w, y - i * 20, x + 50, y - i * 20)))
    upright = F.transform(F.sequence(F.lit(0), "nc"), lambda i: line(x + i * 40, y - h, x + i * 40, F.when(F.col("spans") & (i == 1), y - 20).otherwise(y)))
    cx, cy = x + w - 40, y - h
    small = F.array(*[line(cx + 5, cy + 4 + 6 * i, cx + 35, cy + 4 + 6 * i) for i in range(3)], *[line(cx + 5 + 15 * i, cy + 4, cx + 5 + 15 * i, cy + 16) for i in range(3)])
    lines = F.concat(F.flatten(flat), upright, F.when(F.col("nests"), small).otherwise(F.slice(small, 1, 0)), F.array(line(x, y, x + 1, y + 1)))
    strokes = p.select("page", F.explode(lines).alias("s")).select("page", "s.*")

    at = lambda text, px, py: F.struct(text.alias("text"), (px - 3).alias("x0"), (py - 2).alias("y0"), (px + 3).alias("x1"), (py + 2).alias("y1"))
    word = lambda r, c: at(F.concat_ws(" ", "p_brand", r.cast("string"), c.cast("string")), x + c * 40 + 20.0, y - r * 20 - 10.0)
    last = lambda r, c: (r == F.col("nr") - 1) & (c == F.col("nc") - 1)
    words = F.flatten(F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda r: F.filter(F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda c: F.when(~(F.col("nests") & last(r, c)), word(r, c))), lambda f: f.isNotNull())))
    held = F.when(F.col("nests"), F.array(at(F.col("p_type"), cx + 12.0, cy + 7.0)))
    texts = F.concat(words, F.coalesce(held, F.slice(words, 1, 0)))
    frags = p.select("page", "p_partkey", F.posexplode(texts).alias("n", "f")).select("page", (F.col("p_partkey") * 100 + F.col("n")).alias("frag"), "f.*")
    return lattices.ruled_tables(strokes, frags)


# --- blocks from placed lines ----------------------------------------------------------------------

PLACED_SQL = """d AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
l AS (SELECT doc, n // 50 AS page, n AS line, length(s) AS len, 72.0 + 18 * (length(s) % 3) AS x0, -14.0 * n AS y0, 5.0 * length(s) AS w, CASE WHEN length(s) % 11 = 0 THEN 18.0 ELSE 12.0 END AS size,
  length(s) % 13 = 0 AS mono, length(s) % 7 = 0 AS bold, length(s) % 5 < 2 AND length(s) % 13 <> 0 AS marked, CASE WHEN length(s) % 5 < 2 THEN '- #' ELSE '§' END || s AS text FROM d WHERE s <> ''),
z AS (SELECT doc, size, sum(length(text)) AS n FROM l GROUP BY ALL), zb AS (SELECT doc, arg_max(size, n * 100 + size) AS body, max(size) AS top FROM z GROUP BY doc),
b0 AS (SELECT l.*, zb.body, top > body + 0.5 AS has_larger, greatest(3, 0.5 * body) AS tol, x0 + w * 2 / (len + 3) AS bx,
  coalesce(lag(y0) OVER p - y0 > 1.5 * greatest(size, lag(size) OVER p) OR lag(size) OVER p <> size, FALSE)::INT AS begins FROM l JOIN zb USING (doc) WINDOW p AS (PARTITION BY doc, page ORDER BY line)),
b1 AS (SELECT *, sum(begins) OVER (PARTITION BY doc, page ORDER BY line) AS block FROM b0),
b2 AS (SELECT *, marked AND (coalesce(lag(marked) OVER o, FALSE) OR coalesce(lead(marked) OVER o, FALSE) OR coalesce(NOT lead(mono) OVER o AND abs(lead(x0) OVER o - bx) <= tol, FALSE)) AS item, lag(y0) OVER o - y0 AS gap,
  max(w) OVER g AS wide, lag(y0) OVER g2 AS above, lead(x0) OVER g2 AS next_x, lead(size) OVER g2 AS next_size FROM b1 WINDOW o AS (PARTITION BY doc, page, block ORDER BY line), g AS (PARTITION BY doc, page), g2 AS (PARTITION BY doc, page ORDER BY line)),
m AS (SELECT doc, page, list_sort(list(gap))[count(*) // 2 + 1] AS step FROM b2 WHERE gap > 0 GROUP BY ALL),
b3 AS (SELECT *, sum((item OR mono)::INT) OVER (PARTITION BY doc, page, block ORDER BY line) AS part, (SELECT count(DISTINCT c.x0) FROM b2 c WHERE c.doc = b2.doc AND c.page = b2.page AND c.block = b2.block AND c.item AND c.x0 < b2.x0) AS depth FROM b2),
b4 AS (SELECT *, first_value(item) OVER q AS opened, first_value(bx) OVER q AS open_x FROM b3 WINDOW q AS (PARTITION BY doc, page, block, part ORDER BY line)),
b5 AS (SELECT b4.*, coalesce(m.step, 1.2 * body) AS step, NOT (item OR mono) AND opened AND min((item OR mono OR abs(x0 - open_x) <= tol)::INT) OVER (PARTITION BY b4.doc, b4.page, block, part ORDER BY line) = 1 AS goes_on FROM b4 LEFT JOIN m ON m.doc = b4.doc AND m.page = b4.page),
b6 AS (SELECT *, CASE WHEN mono THEN 'code' WHEN item THEN 'item' WHEN goes_on THEN 'continuation' WHEN size > body + 0.5 THEN 'heading' WHEN w < 0.6 * wide AND coalesce(above - y0 >= 1.2 * step, TRUE) AND coalesce(abs(next_x - x0) <= tol AND next_size <= body + 0.5, FALSE)
  AND (bold OR (length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 2 AND trim(text) = upper(trim(text))) OR NOT regexp_matches(trim(text, ' '), '[.,]$')) THEN 'heading' ELSE 'text' END AS kind FROM b5),
b7 AS (SELECT *, CASE kind WHEN 'item' THEN depth WHEN 'heading' THEN CASE WHEN size > body + 0.5 OR NOT has_larger THEN 1 ELSE 2 END ELSE 0 END AS level FROM b6),
b8 AS (SELECT *, (NOT (kind = 'continuation' OR coalesce(kind <> 'item' AND lag(kind) OVER v = kind AND lag(level) OVER v = level AND lag(block) OVER v = block AND lag(page) OVER v = page, FALSE)))::INT AS starts FROM b7 WINDOW v AS (PARTITION BY doc ORDER BY line)),
b9 AS (SELECT *, sum(starts) OVER (PARTITION BY doc ORDER BY line) - 1 AS ordinal, CASE WHEN kind = 'code' THEN text WHEN kind = 'item' THEN trim(substr(text, 3), ' ') ELSE trim(text, ' ') END AS said FROM b8),
k AS (SELECT doc, CAST(ordinal AS INT) AS ordinal, CASE arg_min(kind, line) WHEN 'text' THEN 'paragraph' ELSE arg_min(kind, line) END AS kind, CAST(arg_min(level * CASE kind WHEN 'item' THEN 2 ELSE 1 END, line) AS INT) AS level, count(*) AS n_lines,
  sha256(CASE arg_min(kind, line) WHEN 'code' THEN string_agg(said, chr(10) ORDER BY line) ELSE string_agg(said, ' ' ORDER BY line) END) AS text_sha256 FROM b9 GROUP BY doc, b9.ordinal)"""


def _placed_lines(read):
    """The lines of whole texts, placed by their length."""
    rows = read("documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "s")).filter("s <> ''")
    n, size = F.col("n"), F.length("s")
    x = 72.0 + 18 * (size % 3)
    return rows.select(
        "doc", F.floor(n / 50).alias("page"), n.alias("line"), x.alias("x0"), (x + 5.0 * size).alias("x1"), (-14.0 * n).alias("y0"), F.when(size % 11 == 0, 18.0).otherwise(12.0).alias("size"),
        F.concat(F.when(size % 5 < 2, "- #").otherwise("§"), "s").alias("text"), (size % 7 == 0).alias("bold"), (size % 13 == 0).alias("mono"),
    )


@query(f"WITH {PLACED_SQL} SELECT * FROM k")
def inferred_blocks(read):
    """Headings, paragraphs, items and code of the lines of whole texts."""
    return blocks.document_blocks(_placed_lines(read)).select("doc", "ordinal", "kind", "level", "n_lines", F.sha2("text", 256).alias("text_sha256"))


@query()
def placed_markdown(read):
    """Placed lines of whole texts as one Markdown document each."""
    return exports.to_markdown(blocks.document_blocks(_placed_lines(read)), "doc").select("doc", F.sha2("document", 256).alias("document_sha256"), F.length("document").alias("n_chars"))
