"""Queries over inline markup, selectors, object graphs and revisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import graphs, hyphens, selectors, sequential
from textloom.plans.structures import query as _query

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    return _query(sql, QUERIES, ORACLES)


# --- Markdown inlines -------------------------------------------------------------------------


@query()
def markdown_inlines(read):
    """Inline nodes of the blocks of whole documents."""
    blocks = sequential.markdown_blocks(read("documents")).filter("kind NOT IN ('code', 'rule', 'table')")
    return sequential.markdown_inlines(blocks.withColumnRenamed("ordinal", "block"), ["doc_id", "block"])


def _cases():
    """(text with {n}, {b}, {k} for name, brand and key; its rows) by case."""
    return [
        ("*{n} **{b}***", [(0, "emph", "", None), (1, "text", "{n} ", None), (1, "strong", "", None), (2, "text", "{b}", None)]),
        ("**{n}* {b}", [(0, "text", "*", None), (0, "emph", "", None), (1, "text", "{n}", None), (0, "text", " {b}", None)]),
        ("**{n}*{b}", [(0, "text", "**{n}*{b}", None)]),
        ("[*{n}*](/p/{k} \"t\")!", [(0, "link", "", "/p/{k}"), (1, "emph", "", None), (2, "text", "{n}", None), (0, "text", "!", None)]),
        ("![{n}](<a {k}>)", [(0, "image", "", "a {k}"), (1, "text", "{n}", None)]),
        ("`` {n}`{b} ``*", [(0, "code", "{n}`{b}", None), (0, "text", "*", None)]),
        ("x_{n}_y _{k}_", [(0, "text", "x_{n}_y ", None), (0, "emph", "", None), (1, "text", "{k}", None)]),
        ("<uu:{k}>\\*{b}&lt;  \n<b>", [(0, "autolink", "uu:{k}", "uu:{k}"), (0, "text", "*{b}<", None), (0, "hardbreak", "", None), (0, "html", "<b>", None)]),
        ("[a [{n}](u{k})](v)", [(0, "text", "[a ", None), (0, "link", "", "u{k}"), (1, "text", "{n}", None), (0, "text", "](v)", None)]),
        ("*[{n}*](u)\n{b}", [(0, "text", "*", None), (0, "link", "", "u"), (1, "text", "{n}*", None), (0, "softbreak", "", None), (0, "text", "{b}", None)]),
    ]


_FILLS = {"{n}": "p_name", "{b}": "p_type", "{k}": "p_partkey"}


def _sql_text(t: str | None) -> str:
    if t is None:
        return "CAST(NULL AS VARCHAR)"
    out = "'" + t.replace("'", "''") + "'"
    for mark, column in _FILLS.items():
        out = f"replace({out}, '{mark}', CAST({column} AS VARCHAR))"
    return out


def _cases_sql() -> str:
    rows = []
    for i, (_, nodes) in enumerate(_cases()):
        for j, (depth, kind, t, target) in enumerate(nodes):
            rows.append(f"SELECT p_partkey, CAST({j} AS INT) AS ordinal, CAST({depth} AS INT) AS depth, '{kind}' AS kind, {_sql_text(t)} AS text, {_sql_text(target)} AS target FROM part WHERE p_partkey % {len(_cases())} = {i}")
    return "\nUNION ALL ".join(rows)


@query(_cases_sql())
def markdown_inline_cases(read):
    """Each rule of emphasis, links, code and escapes, on the words of the parts."""
    said = F.lit(None).cast("string")
    for i, (t, _) in enumerate(_cases()):
        filled = F.lit(t)
        for mark, column in _FILLS.items():
            filled = F.replace(filled, F.lit(mark), F.col(column).cast("string"))
        said = F.when(F.col("p_partkey") % len(_cases()) == i, filled).otherwise(said)
    return sequential.markdown_inlines(read("part").select("p_partkey", said.alias("text")), ["p_partkey"])


# --- selectors -----------------------------------------------------------------------------------

#: Forty parts are a page: a root, sections of thirteen, in each three lists and their items.
ELEMENTS_SQL = """e AS (SELECT page, node, o, CASE WHEN node = 0 THEN NULL WHEN o = 0 THEN 0 WHEN o IN (1, 5, 9) THEN node - o ELSE node - (o - 1) % 4 END AS parent,
  CASE WHEN node = 0 THEN top WHEN o = 0 THEN least(node + 12, top) WHEN o IN (1, 5, 9) THEN least(node + 3, top) ELSE node END AS last,
  CASE WHEN node = 0 THEN 'body' WHEN o = 0 THEN 'section' WHEN o IN (1, 5, 9) THEN CASE WHEN p_size % 2 = 0 THEN 'ul' ELSE 'ol' END WHEN p_size % 3 = 0 THEN 'p' ELSE 'li' END AS name, p_type AS cls, p_brand AS brand
  FROM (SELECT *, max(node) OVER (PARTITION BY page) AS top, (node + 12) % 13 AS o FROM (SELECT p_partkey // 40 AS page, p_partkey % 40 AS node, p_size, p_type, p_brand FROM part)))"""


def part_elements(read):
    k = F.col("p_partkey")
    n = read("part").select(F.floor(k / 40).alias("page"), (k % 40).alias("node"), "p_size", "p_type", "p_brand")
    n = n.withColumns({"top": F.max("node").over(Window.partitionBy("page")), "o": (F.col("node") + 12) % 13})
    node, o, listed = F.col("node"), F.col("o"), F.col("o").isin(1, 5, 9)
    return n.select(
        "page", "node",
        F.when(node == 0, None).when(o == 0, 0).when(listed, node - o).otherwise(node - (o - 1) % 4).alias("parent"),
        F.when(node == 0, F.col("top")).when(o == 0, F.least(node + 12, "top")).when(listed, F.least(node + 3, "top")).otherwise(node).alias("last"),
        F.when(node == 0, "body").when(o == 0, "section").when(listed, F.when(F.col("p_size") % 2 == 0, "ul").otherwise("ol")).otherwise(F.when(F.col("p_size") % 3 == 0, "p").otherwise("li")).alias("name"),
        F.create_map(F.lit("class"), "p_type", F.lit("data-brand"), "p_brand").alias("attrs"),
    )


_ELDER = "SELECT 1 FROM e a WHERE a.page = b.page AND a.parent = b.parent AND a.node < b.node"
#: Selector, and the same as a condition on ``b`` over all pairs of elements.
SELECTORS = {
    "ul li": "b.name = 'li' AND EXISTS (SELECT 1 FROM e a WHERE a.page = b.page AND a.name = 'ul' AND a.node < b.node AND b.node <= a.last)",
    "section > OL > .LARGE": "b.cls = 'LARGE' AND EXISTS (SELECT 1 FROM e a JOIN e c ON c.page = a.page AND c.node = a.parent WHERE a.page = b.page AND a.node = b.parent AND a.name = 'ol' AND c.name = 'section')",
    "li + p": f"b.name = 'p' AND EXISTS ({_ELDER} AND a.name = 'li' AND NOT EXISTS (SELECT 1 FROM e c WHERE c.page = a.page AND c.parent = a.parent AND c.node > a.node AND c.node < b.node))",
    "p ~ li:not(:last-child)": f"b.name = 'li' AND EXISTS ({_ELDER} AND a.name = 'p') AND EXISTS (SELECT 1 FROM e a WHERE a.page = b.page AND a.parent = b.parent AND a.node > b.node)",
    "section:has(> ul p), [data-brand$=\"3\"]:first-child": f"(b.name = 'section' AND EXISTS (SELECT 1 FROM e a JOIN e c ON c.page = a.page AND a.node < c.node AND c.node <= a.last WHERE a.page = b.page AND a.parent = b.node AND a.name = 'ul' AND c.name = 'p')) OR (b.brand LIKE '%3' AND NOT EXISTS ({_ELDER}))",
    "li:nth-child(2n+1):is(.PROMO, [class|=ECONOMY])": f"b.name = 'li' AND b.cls IN ('PROMO', 'ECONOMY') AND (SELECT count(*) FROM e a WHERE a.page = b.page AND a.parent = b.parent AND a.node < b.node) % 2 = 0",
}


def _selectors_sql() -> str:
    each = [f"SELECT '{s}' AS selector, page, node FROM e b WHERE {c}" for s, c in SELECTORS.items()]
    return f"WITH {ELEMENTS_SQL} " + "\nUNION ALL ".join(each)


@query(_selectors_sql())
def selector_matches(read):
    """Selectors over pages made of the parts, against the same by pairs of elements."""
    e, out = part_elements(read), None
    for s in SELECTORS:
        hit = selectors.select(e, s).select(F.lit(s).alias("selector"), "page", "node")
        out = hit if out is None else out.unionByName(hit)
    return out


#: Links in lists of a page's navigation, and paragraphs with a link or before another paragraph.
PAGE_SELECTOR = "nav > ul li a[href], p:has(a), p:has(+ p), body > :not(nav):nth-child(even)"


@query()
def page_selector_matches(read):
    """The elements of whole pages that a selector list picks."""
    return selectors.select(sequential.html_elements(read("pages")), PAGE_SELECTOR, "page_id").select("page_id", "node", "name")


# --- graphs and revisions -------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_quantity >= 48 UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 2)),
w AS (SELECT DISTINCT 'p' || p_partkey AS node, 0 AS steps FROM part WHERE p_size = 1 UNION SELECT e.dst, w.steps + 1 FROM w JOIN e ON e.src = w.node WHERE w.steps < 40)
SELECT node, CAST(min(steps) AS INT) AS steps FROM w GROUP BY node""")
def reachable_objects(read):
    """Parts and suppliers that orders link with rings and hubs; what the smallest parts reach."""
    part, supplier = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    l = read("lineitem")
    edges = l.filter("l_quantity >= 48").select(part.alias("src"), supplier.alias("dst")).union(l.filter("l_returnflag = 'R' AND l_quantity <= 2").select(supplier, part))
    return graphs.reachable(edges, read("part").filter("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("node")))


@query("""WITH s AS (SELECT l_orderkey AS file, l_linenumber AS section, min(l_partkey) AS a, max(l_suppkey) AS b, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY ALL),
e AS (SELECT file, section, 0 AS place, a % 4 AS number, a * 16 + section AS off, flag = 'R' AS free FROM s UNION ALL SELECT file, section, 1, b % 4, b * 16 + section, status = 'O' FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY file, number ORDER BY section DESC, place DESC) AS r FROM e)
SELECT file, number, section AS generation, off AS "offset" FROM r WHERE r = 1 AND NOT free""")
def live_objects(read):
    """An order is a file, its lines are sections that changed it one after the other; freed objects stay gone."""
    s = read("lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("section")).agg(F.min("l_partkey").alias("a"), F.max("l_suppkey").alias("b"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    w = Window.partitionBy("file").orderBy("section")
    sections = s.select("file", "section", F.lag("section").over(w).alias("prev"), F.lead("section").over(w).isNull().alias("newest"))
    entry = lambda place, key, free: s.select("file", "section", F.lit(place).alias("place"), (F.col(key) % 4).alias("number"), F.col("section").alias("generation"), (F.col(key) * 16 + F.col("section")).alias("offset"), free.alias("free"))
    return graphs.live_objects(sections, entry(0, "a", F.col("flag") == "R").union(entry(1, "b", F.col("status") == "O")))


@query("""SELECT p_partkey, CAST(i AS INT) AS row, CAST(p_size + i AS BIGINT) AS kind, CAST(p_partkey * 7 + i AS BIGINT) AS field, CAST(p_size * (i + 1) AS BIGINT) AS last FROM part, range(3) AS r(i)""")
def packed_entries(read):
    """Rows of fields of 1, 3, 0 and 2 bytes, read back from binary; a broken fourth row is left out."""
    hexed = lambda v, n: F.lpad(F.hex(v.cast("long")), n, "0")
    k, size = F.col("p_partkey"), F.col("p_size")
    parts = [h for i in range(3) for h in (hexed(size + i, 2), hexed(k * 7 + i, 6), hexed(size * (i + 1), 4))]
    rows = read("part").select("p_partkey", F.posexplode(graphs.packed_rows(F.unhex(F.concat(*parts, F.lit("0102"))), [1, 3, 0, 2])).alias("row", "f"))
    return rows.select("p_partkey", "row", F.col("f")[0].alias("kind"), F.col("f")[1].alias("field"), F.col("f")[3].alias("last"))


# --- hyphenation ---------------------------------------------------------------------------------

#: Patterns of our own for the syllables of the texts, and an exception.
PATTERNS = [".an3", "th1e", "1ti", "n1d", "e2r", "er3h", "2tz.", "on1", "1he", "s2h", "a1n", "i1ng", "o4u", "ing5s", "c2h", "4e.", "2n1t", ".re3i"]
EXCEPTION = "th-i-s"


def _patterns_sql() -> str:
    rows = []
    for p in PATTERNS:
        letters, levels = "", [0]
        for c in p:
            if c.isdigit():
                levels[-1] = int(c)
            else:
                letters += c
                levels.append(0)
        rows.append(f"('{letters}', {levels})")
    return ", ".join(rows)


@query(f"""WITH q(letters, levels) AS (VALUES {_patterns_sql()}),
d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
s AS (SELECT word, unnest(range(1, length(word) + 3)) AS s FROM d),
g AS (SELECT word, s - 2 + i AS place, max(levels[i + 1]) AS level FROM s JOIN q ON substr('.' || word || '.', s, length(letters)) = letters JOIN range(0, 9) AS r(i) ON i <= length(letters) GROUP BY ALL),
b AS (SELECT word, list(place ORDER BY place) AS cuts FROM g WHERE level % 2 = 1 AND place >= 2 AND place <= length(word) - 3 GROUP BY word)
SELECT word, array_to_string(list_transform(range(1, length(word) + 1), lambda i: substr(word, i, 1) || CASE WHEN list_contains(cuts, i) THEN '-' ELSE '' END), '') AS hyphenated FROM d LEFT JOIN b USING (word) WHERE word <> 'this'
UNION ALL SELECT word, '{EXCEPTION}' FROM d WHERE word = 'this'""")
def hyphenated_words(read):
    """Where the distinct words of whole documents may break."""
    docs = read("documents")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("word"))
    spark = docs.sparkSession
    table = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    out = hyphens.break_places(words, table, spark.createDataFrame([(EXCEPTION,)], "word string"))
    return out.select("word", hyphens.hyphenated(F.col("word"), F.col("breaks")).alias("hyphenated"))
