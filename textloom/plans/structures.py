"""Queries over layout, trees and rules. Their inputs are made from the keys of the tables, so that SQL knows them too."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.plans.ranking import global_row_number
from textloom.operators import checks, layout, sequential, trees
from textloom.shipping import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, queries: dict | None = None, oracles: dict | None = None):
    """Register a query of (read) -> DataFrame, where read(table) gives a table; workers can import this package."""

    def wrap(f):
        def run(spark, sf_dir):
            ship(spark)
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        (QUERIES if queries is None else queries)[f.__name__] = run
        if sql:
            (ORACLES if oracles is None else oracles)[f.__name__] = sql
        return f

    return wrap


# --- layout -------------------------------------------------------------------------------

FRAGS_SQL = """f AS (SELECT l_suppkey * 10 + CAST(l_quantity AS INT) % 10 AS page, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS frag, CAST(l_orderkey * 13 % 550 AS DOUBLE) AS x0, CAST(l_partkey * 37 % 800 AS DOUBLE) AS y0,
  l_orderkey * 13 % 550 + 4.0 * length('w' || l_partkey % 1000) AS x1, 8 + l_linenumber % 5 AS size, 'w' || l_partkey % 1000 AS text FROM lineitem)"""
LINES_SQL = f"""WITH RECURSIVE {FRAGS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0 DESC, x0, frag) AS k FROM f),
g AS (SELECT page, k, frag, y0 AS anchor, 0 AS line FROM k WHERE k = 1 UNION ALL
  SELECT k.page, k.k, k.frag, CASE WHEN abs(k.y0 - g.anchor) > greatest(2, 0.5 * k.size) THEN k.y0 ELSE g.anchor END, g.line + CASE WHEN abs(k.y0 - g.anchor) > greatest(2, 0.5 * k.size) THEN 1 ELSE 0 END
  FROM g JOIN k ON k.page = g.page AND k.k = g.k + 1),
l AS (SELECT k.*, g.line FROM k JOIN g ON k.page = g.page AND k.k = g.k)"""


def _fragments(read):
    k = F.col("l_orderkey")
    text = F.concat(F.lit("w"), (F.col("l_partkey") % 1000).cast("string"))
    x, y = (k * 13 % 550).cast("double"), (F.col("l_partkey") * 37 % 800).cast("double")
    return read("lineitem").select(
        (F.col("l_suppkey") * 10 + F.col("l_quantity").cast("int") % 10).alias("page"), ((k * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("frag"),
        x.alias("x0"), y.alias("y0"), (x + 4.0 * F.length(text)).alias("x1"), (y + 8).alias("y1"),
        (8 + F.col("l_linenumber") % 5).cast("double").alias("size"), text.alias("text"),
    )


@query(LINES_SQL + " SELECT page, frag, CAST(line AS INT) AS line FROM l")
def fragment_lines(read):
    return layout.group_lines(_fragments(read)).select("page", "frag", "line")


@query(LINES_SQL + """, p AS (SELECT page, line, x0, frag, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, line ORDER BY x0, frag) > 0.25 * size THEN ' ' ELSE '' END || text AS t FROM l),
t AS (SELECT page, line, rtrim(string_agg(t, '' ORDER BY x0, frag)) AS t FROM p GROUP BY page, line)
SELECT page, sha256(string_agg(t, chr(10) ORDER BY line)) AS text FROM t GROUP BY page""")
def placed_page_text(read):
    return layout.page_text(layout.group_lines(_fragments(read))).select("page", F.sha2("text", 256).alias("text"))


@query(LINES_SQL + " SELECT page, CAST(line AS INT) AS line, min(x0) AS x0, max(x1) AS x1, count(*) AS n, CAST(max(size) AS DOUBLE) AS size FROM l GROUP BY page, line")
def structured_lines(read):
    lines = layout.group_lines(_fragments(read))
    return layout.structured(lines).join(lines.groupBy("page", "line").agg(F.count("*").alias("n")), ["page", "line"]).select("page", "line", "x0", "x1", "n", "size")


@query("""WITH RECURSIVE r AS (SELECT p_partkey // 50 AS page, CASE p_partkey % 2 WHEN 0 THEN 'h' ELSE 'v' END AS axis, CAST(p_size * 3 % 120 AS DOUBLE) AS pos, CAST(p_partkey * 7 % 300 AS DOUBLE) AS lo, p_partkey * 7 % 300 + 20.0 + p_size AS hi, p_partkey AS id FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY page, axis ORDER BY pos, lo, hi) AS k FROM r),
g AS (SELECT page, axis, k, 1 AS c, pos, lo, hi FROM k WHERE k = 1 UNION ALL
  SELECT k.page, k.axis, k.k, CASE WHEN k.pos - g.pos <= 2 AND k.lo <= g.hi + 2 THEN g.c ELSE g.c + 1 END, CASE WHEN k.pos - g.pos <= 2 AND k.lo <= g.hi + 2 THEN (g.pos + k.pos) / 2 ELSE k.pos END,
    CASE WHEN k.pos - g.pos <= 2 AND k.lo <= g.hi + 2 THEN least(g.lo, k.lo) ELSE k.lo END, CASE WHEN k.pos - g.pos <= 2 AND k.lo <= g.hi + 2 THEN greatest(g.hi, k.hi) ELSE k.hi END
  FROM g JOIN k ON k.page = g.page AND k.axis = g.axis AND k.k = g.k + 1)
SELECT page, axis, round(max_by(pos, k), 6) AS pos, max_by(lo, k) AS lo, max_by(hi, k) AS hi FROM g GROUP BY page, axis, c""")
def clustered_rules(read):
    k = F.col("p_partkey")
    rules = read("part").select(F.floor(k / 50).alias("page"), F.when(k % 2 == 0, "h").otherwise("v").alias("axis"), (F.col("p_size") * 3 % 120).cast("double").alias("pos"), (k * 7 % 300).cast("double").alias("lo"), (k * 7 % 300 + 20.0 + F.col("p_size")).alias("hi"))
    return layout.cluster_rules(rules).withColumn("pos", F.round("pos", 6))


@query("""WITH s AS (SELECT p_partkey // 100 AS page, p_partkey AS side_id, p_partkey % 50 * 4.0 AS pos, p_partkey % 30 * 10.0 AS lo, p_partkey % 30 * 10.0 + 8 AS hi FROM part),
e AS (SELECT s_suppkey // 5 AS page, s_suppkey AS edge, -s_suppkey AS ordinal, s_suppkey % 50 * 4.0 + 0.5 AS pos, s_suppkey % 3 * 90.0 AS lo, s_suppkey % 3 * 90.0 + 110 AS hi FROM supplier)
SELECT s.page, s.side_id, min_by(e.edge, e.ordinal) AS edge FROM s LEFT JOIN e ON s.page = e.page AND abs(e.pos - s.pos) <= 1 AND e.lo <= s.lo + 1 AND e.hi >= s.hi - 1 GROUP BY s.page, s.side_id""")
def spanning_edges(read):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    sides = read("part").select(F.floor(k / 100).alias("page"), k.alias("side_id"), (k % 50 * 4.0).alias("pos"), (k % 30 * 10.0).alias("lo"), (k % 30 * 10.0 + 8).alias("hi"))
    edges = read("supplier").select(F.floor(s / 5).alias("page"), s.alias("edge"), (-s).alias("ordinal"), (s % 50 * 4.0 + 0.5).alias("pos"), (s % 3 * 90.0).alias("lo"), (s % 3 * 90.0 + 110).alias("hi"))
    return layout.edge_at(sides, edges)


@query("""WITH m AS (SELECT * FROM (VALUES (0, 0, 0, 1, 1), (0, 0, 1, 1, 1), (0, 0, 2, 1, 1), (0, 1, 0, 1, 1), (0, 1, 1, 1, 1), (0, 1, 2, 1, 1),
  (1, 0, 0, 1, 2), (1, 0, 2, 1, 1), (1, 1, 0, 1, 1), (1, 1, 1, 1, 1), (1, 1, 2, 1, 1), (2, 0, 0, 1, 1), (2, 0, 1, 2, 1), (2, 0, 2, 1, 1), (2, 1, 0, 1, 1), (2, 1, 2, 1, 1),
  (3, 0, 0, 1, 1), (3, 0, 1, 2, 2), (3, 1, 0, 1, 1)) AS t(kind, r, c, down, across))
SELECT p_partkey, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(down AS INT) AS row_span, CAST(across AS INT) AS col_span FROM part JOIN m ON p_partkey % 4 = kind""")
def grown_cells(read):
    def cells(kind: int):
        across = [[not (kind == 1 and r == 0 and c == 0) and not (kind == 3 and c == 1) for c in range(2)] for r in range(2)]
        down = [[not (kind == 2 and c == 1) and not (kind == 3 and c > 0)] for c in range(3)]
        return layout.grid_cells(across, down)

    rows = read("part").select("p_partkey", (F.col("p_partkey") % 4).alias("kind"))
    return sequential.explode_rows(rows, ["p_partkey"], ["kind"], cells, "r int, c int, row_span int, col_span int")


@query("""WITH c AS (SELECT p_partkey * 10 + q AS page, r AS cell, r * 200.0 AS x0, 0.0 AS y0, r * 200.0 + 190 AS x1, 400.0 AS y1 FROM (SELECT s_suppkey AS p_partkey FROM supplier), range(0, 10) a(q), range(0, 3) b(r)),
""" + FRAGS_SQL + """ SELECT c.page, c.cell, sha256(coalesce(string_agg(f.text, ' ' ORDER BY f.y0 DESC, f.x0, f.frag), '')) AS text
FROM c LEFT JOIN f ON f.page = c.page AND (f.x0 + f.x1) / 2 BETWEEN c.x0 AND c.x1 AND f.y0 + 4 BETWEEN c.y0 AND c.y1 GROUP BY c.page, c.cell""")
def cell_texts(read):
    pages = read("supplier").select(F.explode(F.expr("sequence(s_suppkey * 10, s_suppkey * 10 + 9)")).alias("page"))
    cells = pages.select("page", F.explode(F.expr("sequence(0L, 2L)")).alias("cell")).select("page", "cell", (F.col("cell") * 200.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("cell") * 200.0 + 190).alias("x1"), F.lit(400.0).alias("y1"))
    return layout.cell_text(_fragments(read), cells).select("page", "cell", F.sha2("text", 256).alias("text"))


@query("""WITH f AS (SELECT l_orderkey AS page, l_linenumber AS line, unnest([0, 1, 2]) AS k, l_partkey, l_suppkey FROM lineitem),
w AS (SELECT page, line, k * 120.0 + l_partkey % 20 AS x0, k * 120.0 + l_partkey % 20 + 30 + l_suppkey % 60 AS x1 FROM f WHERE k < 2 OR l_partkey % 3 = 0),
b AS (SELECT page, min(x0) - 1 AS l, max(x1) + 1 AS r, count(DISTINCT line) AS n FROM w GROUP BY page),
cov AS (SELECT DISTINCT w.page, unnest(range(CAST(floor(x0 - l) AS BIGINT), CAST(ceil(x1 - l) AS BIGINT) + 1)) AS u FROM w JOIN b ON w.page = b.page),
nx AS (SELECT page, u, lead(u) OVER (PARTITION BY page ORDER BY u) AS v FROM cov),
cut AS (SELECT nx.page, (l + u + 1 + l + v) / 2 AS cut FROM nx JOIN b ON nx.page = b.page WHERE v - u > 1 AND u + 1 > 6 AND l + v < r - 6 AND v - u - 1 >= 6),
cs AS (SELECT b.page, b.n, list_sort(list_concat([l, r], coalesce((SELECT list(cut) FROM cut WHERE cut.page = b.page), []))) AS cuts FROM b),
col AS (SELECT w.page, w.line, len(list_filter(cuts, lambda c: c <= (x0 + x1) / 2)) AS c FROM w JOIN cs ON w.page = cs.page),
fill AS (SELECT page, min(n) AS least, count(*) AS cols FROM (SELECT page, c, count(DISTINCT line) AS n FROM col GROUP BY page, c) GROUP BY page)
SELECT cs.page, cs.n AS n_rows, CAST(len(cuts) AS INT) AS n_cuts, list_sum(cuts) AS cut_sum, n >= 2 AND len(cuts) >= 3 AND cols = len(cuts) - 1 AND least >= ceil(n * 0.5) AS accepted FROM cs JOIN fill ON cs.page = fill.page""")
def whitespace_tables(read):
    r = read("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"), "l_partkey", "l_suppkey").filter("k < 2 OR l_partkey % 3 = 0")
    x = F.col("k") * 120.0 + F.col("l_partkey") % 20
    out = layout.whitespace_columns(r.select("page", "line", x.alias("x0"), (x + 30 + F.col("l_suppkey") % 60).alias("x1")))
    return out.select("page", "n_rows", F.size("cuts").alias("n_cuts"), F.aggregate("cuts", F.lit(0.0), lambda s, c: s + c).alias("cut_sum"), "accepted")


@query("""WITH l AS (SELECT conv_id AS doc, turn AS page, unnest([0, 1, 2]) AS o FROM conversations), n AS (SELECT conv_id AS doc, count(*) AS n FROM conversations GROUP BY conv_id),
t AS (SELECT doc, page, o, CASE o WHEN 0 THEN 'Page #' WHEN 1 THEN 'Draft' ELSE 'Body ' || role END AS k, CASE o WHEN 0 THEN 'Page ' || page WHEN 1 THEN 'Draft' ELSE 'Body ' || role END AS text, CASE WHEN o = 1 THEN page % 2 ELSE 0 END AS place FROM l JOIN conversations c ON c.conv_id = l.doc AND c.turn = l.page)
SELECT t.doc, min_by(text, page) AS text, min(page) AS first_page, count(DISTINCT page) AS pages, count(*) AS occurrences FROM t JOIN n ON t.doc = n.doc GROUP BY t.doc, k, place, n.n HAVING count(DISTINCT page) >= greatest(2, ceil(n.n / 2))""")
def placed_watermarks(read):
    c = read("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "role", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ordinal"))
    text = F.when(F.col("ordinal") == 0, F.concat(F.lit("Page "), F.col("page").cast("string"))).when(F.col("ordinal") == 1, "Draft").otherwise(F.concat(F.lit("Body "), "role"))
    y = F.when(F.col("ordinal") == 1, F.col("page") % 2 * 50.0).otherwise(10.0) + F.col("page") % 3 * 0.5
    lines = c.select("doc", "page", "ordinal", text.alias("text"), F.lit(5.0).alias("x0"), y.alias("y0"), F.lit(90.0).alias("x1"), (y + 8).alias("y1"))
    return layout.watermarks(lines, c.groupBy("doc").agg(F.count_distinct("page").alias("n_pages")))


# --- trees ---------------------------------------------------------------------------------

#: Nodes 0, 1, 2, ... of a tree in which node k has the children 3k + 1 to 3k + 3.
TREE_SQL = "t AS (SELECT p_partkey - 1 AS node, CASE WHEN p_partkey > 1 THEN CAST(floor((p_partkey - 2) / 3) AS BIGINT) END AS parent FROM part)"


def _tree(read):
    node = F.col("p_partkey") - 1
    return read("part").select(node.alias("node"), F.when(node > 0, F.floor((node - 1) / 3)).alias("parent"))


@query(f"""WITH RECURSIVE {TREE_SQL}, w AS (SELECT node, 1 AS depth, lpad('0', 2, '0') AS path FROM t WHERE parent IS NULL UNION ALL
  SELECT t.node, w.depth + 1, w.path || lpad(CAST((t.node - 1) % 3 AS VARCHAR), 2, '0') FROM w JOIN t ON t.parent = w.node)
SELECT node, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY path) - 1 AS ordinal FROM w""")
def outline_order(read):
    t = _tree(read).distinct()
    held = t.filter("parent IS NOT NULL")
    first = held.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("first"))
    later = held.select("node", F.lead("node").over(Window.partitionBy("parent").orderBy("node")).alias("next"))
    rows = t.select("node").join(first, "node", "left").join(later, "node", "left")
    # keys may have gaps: what hangs on a node that isn't there is in no outline
    ways = trees.outline(rows).join(t.filter("parent IS NULL").select(F.col("node").alias("root")), "root", "left_semi")
    ways = global_row_number(ways, "path", name="ordinal")
    return ways.select("node", "depth", (F.col("ordinal") - 1).alias("ordinal"))


@query(f"""WITH RECURSIVE {TREE_SQL}, v AS (SELECT node, parent, CASE WHEN node % 7 = 0 THEN 'lang' || node % 5 END AS lang FROM t), w AS (SELECT node, lang FROM v WHERE parent IS NULL UNION ALL SELECT v.node, coalesce(v.lang, w.lang) FROM w JOIN v ON v.parent = w.node)
SELECT node, lang FROM w""")
def inherited_language(read):
    t = _tree(read).withColumn("lang", F.when(F.col("node") % 7 == 0, F.concat(F.lit("lang"), (F.col("node") % 5).cast("string"))))
    return trees.nearest_above(t, "lang")


@query(f"""WITH RECURSIVE {TREE_SQL}, v AS (SELECT node, parent, CASE WHEN node % 11 = 0 THEN 'rtl' WHEN node % 4 = 1 THEN 'ltr' END AS dir FROM t), w AS (SELECT node, coalesce(dir, 'ltr') AS dir FROM v WHERE parent IS NULL UNION ALL SELECT v.node, coalesce(v.dir, w.dir) FROM w JOIN v ON v.parent = w.node)
SELECT node, dir FROM w""")
def inherited_direction(read):
    n = F.col("node")
    t = _tree(read).withColumn("dir", F.when(n % 11 == 0, "rtl").when(n % 4 == 1, "LTR ").when(n % 4 == 2, "sideways"))
    stated = F.lower(F.trim("dir"))
    out = trees.nearest_above(t.withColumn("dir", F.when(stated.isin("ltr", "rtl"), stated)), "dir")
    return out.withColumn("dir", F.coalesce("dir", F.lit("ltr")))


@query("""WITH n AS (SELECT c_custkey AS doc, unnest(['P', 'Chapter', 'Alias', 'Loop', 'Unknown', 'Far']) AS name FROM customer)
SELECT doc, name, CASE name WHEN 'P' THEN 'P' WHEN 'Chapter' THEN CASE WHEN doc % 2 = 0 THEN 'Sect' ELSE 'Chapter' END WHEN 'Alias' THEN CASE WHEN doc % 2 = 0 THEN 'Sect' ELSE 'Chapter' END
  WHEN 'Loop' THEN 'Loop' WHEN 'Far' THEN 'Loop2' ELSE name END AS role FROM n""")
def role_resolution(read):
    doc = read("customer").select(F.col("c_custkey").alias("doc"))
    pairs = lambda *p: F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("target")) for a, b in p])
    some = pairs(("P", "Div"), ("Alias", "Chapter"), ("Loop", "Loop2"), ("Loop2", "Loop"), ("Far", "Loop2"))
    both = F.when(F.col("doc") % 2 == 0, F.concat(some, pairs(("Chapter", "Sect")))).otherwise(some)
    names = doc.select("doc", F.explode(F.array(*[F.lit(x) for x in ("P", "Chapter", "Alias", "Loop", "Unknown", "Far")])).alias("name"))
    return trees.resolve_roles(names, doc.select("doc", F.explode(both).alias("x")).select("doc", "x.*"), checks.STANDARD_TYPES)


LEAVES_SQL = "l AS (SELECT s_suppkey AS leaf, 'k' || lpad(CAST(s_suppkey % 50 AS VARCHAR), 3, '0') AS lo, CASE WHEN s_suppkey % 4 = 0 THEN 'k000' ELSE 'k' || lpad(CAST(s_suppkey % 50 + 20 AS VARCHAR), 3, '0') END AS hi, unnest(range(0, 5)) AS pos, s_suppkey FROM supplier), e AS (SELECT leaf, lo, hi, pos, 'k' || lpad(CAST((s_suppkey * 3 + pos * 11) % 70 AS VARCHAR), 3, '0') AS key, s_suppkey * 10 + pos AS value FROM l)"


def _leaves(read):
    s = F.col("s_suppkey")
    name = lambda n: F.concat(F.lit("k"), F.lpad(n.cast("string"), 3, "0"))
    entry = lambda i: F.struct(name((s * 3 + i * 11) % 70).alias("key"), (s * 10 + i).alias("value"))
    return read("supplier").select(s.alias("leaf"), name(s % 50).alias("lo"), F.when(s % 4 == 0, "k000").otherwise(name(s % 50 + 20)).alias("hi"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), entry).alias("entries"))


@query(f"WITH {LEAVES_SQL} SELECT key, min_by(value, leaf * 10 + pos) AS value FROM e GROUP BY key")
def name_tree_entries(read):
    return trees.tree_entries(_leaves(read), ["leaf"])


@query(f"WITH {LEAVES_SQL}, w AS (SELECT 'k' || lpad(CAST(i AS VARCHAR), 3, '0') AS key FROM range(0, 90) t(i)) SELECT w.key, min_by(value, leaf * 10 + pos) AS value FROM w LEFT JOIN e ON e.key = w.key AND e.key BETWEEN lo AND hi GROUP BY w.key")
def name_tree_lookup(read):
    leaves = _leaves(read)
    wanted = leaves.sparkSession.range(90).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("key"))
    return trees.tree_lookup(wanted, leaves)


@query("WITH e AS (SELECT c_custkey AS key, unnest(range(0, 2)) AS k FROM customer) SELECT w.n AS key, max(CASE WHEN l.v IS NOT NULL THEN l.v END) AS value FROM (SELECT c_custkey * 2 AS n FROM customer) w LEFT JOIN (SELECT c_custkey * 3 AS key, c_custkey AS v FROM customer) l ON l.key = w.n GROUP BY w.n")
def number_tree_lookup(read):
    k = F.col("c_custkey")
    leaves = read("customer").select(F.floor(k / 16).alias("leaf"), F.struct((k * 3).alias("key"), k.alias("value")).alias("e")).groupBy("leaf").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    leaves = leaves.select("leaf", F.get("entries", F.lit(0))["key"].alias("lo"), F.element_at("entries", -1)["key"].alias("hi"), "entries")
    return trees.tree_lookup(read("customer").select((k * 2).alias("key")), leaves)


@query("SELECT p_partkey AS start_index, CASE p_partkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'r' WHEN 2 THEN 'A' ELSE 'none' END AS style, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS prefix, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) ELSE 1 END AS start FROM part WHERE p_partkey % 17 <> 0")
def page_label_ranges(read):
    k = F.col("p_partkey")
    style = F.when(k % 5 == 0, "D").when(k % 5 == 1, "r").when(k % 5 == 2, "A").when(k % 5 == 3, "Q")
    entries = F.create_map(F.lit("S"), style, F.lit("P"), F.when(k % 2 == 0, F.col("p_brand")), F.lit("St"), F.when(k % 3 == 0, F.col("p_size").cast("string")).otherwise("x"))
    return trees.page_labels(read("part").select(k.alias("key"), F.when(k % 17 != 0, entries).alias("value")))


@query(f"""WITH RECURSIVE {TREE_SQL}, k AS (SELECT node, CASE WHEN node % 50 = 49 THEN NULL ELSE parent END AS parent, 3 * node + 1 < (SELECT count(*) FROM t) AS inner_node FROM t),
up AS (SELECT node AS leaf, node, parent FROM k WHERE NOT inner_node AND node % 13 <> 5 UNION ALL SELECT up.leaf, k.node, k.parent FROM up JOIN k ON k.node = up.parent),
c AS (SELECT node, count(*) AS n FROM up GROUP BY node), kind AS (SELECT k.*, CASE WHEN node % 13 = 5 THEN 'Odd' WHEN inner_node THEN 'Pages' ELSE 'Page' END AS kind FROM k)
SELECT node, 'kind' AS issue FROM kind WHERE kind = 'Odd' UNION ALL SELECT a.node, 'parent' FROM kind a LEFT JOIN kind b ON a.parent = b.node WHERE a.parent IS NOT NULL AND b.kind IS DISTINCT FROM 'Pages'
UNION ALL SELECT kind.node, 'count' FROM kind LEFT JOIN c ON kind.node = c.node WHERE kind = 'Pages' AND coalesce(c.n, 0) <> 3""")
def page_tree_check(read):
    t = _tree(read)
    n = t.agg(F.count("*").alias("n"))  # one row
    k = F.col("node")
    kind = F.when(k % 13 == 5, "Odd").when(3 * k + 1 < F.col("n"), "Pages").otherwise("Page")
    rows = t.crossJoin(F.broadcast(n)).select("node", F.when(k % 50 != 49, F.col("parent")).alias("parent"), kind.alias("kind"), F.lit(3).alias("count"))
    return trees.page_tree_issues(rows)


@query(f"""WITH RECURSIVE {TREE_SQL}, c AS (SELECT node, parent, node % 10 >= 2 OR node = 0 AS ok FROM t), w AS (SELECT node, ok, node AS root FROM c WHERE parent IS NULL UNION ALL SELECT c.node, c.ok AND w.ok, w.root FROM w JOIN c ON c.parent = w.node)
SELECT node AS cert, CASE WHEN root <> 0 THEN 'untrusted' WHEN ok THEN 'valid' ELSE 'expired' END AS verdict FROM w UNION ALL SELECT -2 * s - i, CASE WHEN s % 2 = 0 THEN 'ring' ELSE 'untrusted' END FROM (SELECT s_suppkey + 1 AS s FROM supplier), range(0, 2) r(i) WHERE s % 2 = 0 OR i = 0""")
def certificate_chains(read):
    t, s = _tree(read), F.col("s_suppkey") + 1
    certs = t.select(F.col("node").alias("cert"), F.coalesce("parent", "node").alias("issuer"), F.lit(10).alias("not_before"), F.when((F.col("node") % 10 >= 2) | (F.col("node") == 0), 99).otherwise(49).alias("not_after"))
    # rings of two, and certificates whose issuer nobody has
    pair = read("supplier").select(s.alias("s"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).filter("s % 2 = 0 OR i = 0")
    more = pair.select((-2 * F.col("s") - F.col("i")).alias("cert"), F.when(F.col("s") % 2 == 0, -2 * F.col("s") - 1 + F.col("i")).otherwise(F.lit(-1_000_000_000)).alias("issuer"), F.lit(10), F.lit(99))
    anchors = t.filter("node = 0").select(F.col("node").alias("cert"))
    return trees.chain_verdicts(certs.union(more), anchors, F.lit(50))


# --- rules ----------------------------------------------------------------------------------

GRID_SQL = """g AS (SELECT p_partkey AS t, r, c, (p_partkey * (r * 3 + c + 2) + p_size * r) % 5 < 2 AS h, CASE WHEN (p_partkey + r + 2 * c) % 4 = 0 THEN 'Row' WHEN (p_partkey + r + 2 * c) % 4 = 1 THEN 'Column' END AS scope,
  CASE WHEN (p_size + c) % 6 = 0 THEN ['h' || r || c, 'hx'] WHEN (p_size + r) % 7 = 0 THEN ['h00'] END AS headers FROM part, range(0, 3) a(r), range(0, 3) b(c))"""


@query(f"""WITH {GRID_SQL}, s AS (SELECT *, coalesce(scope, CASE WHEN r = 0 AND c = 0 THEN 'Both' WHEN r = 0 THEN 'Column' WHEN c = 0 THEN 'Row' ELSE 'Both' END) AS eff FROM g),
gate AS (SELECT t, list('h' || r || c) FILTER (WHERE h) AS ids FROM g GROUP BY t HAVING coalesce(bool_or(scope IS NULL) FILTER (WHERE h), false)),
d AS (SELECT s.*, ids, list_filter(coalesce(headers, []), lambda x: NOT list_contains(ids, x)) AS unknown FROM s JOIN gate ON s.t = gate.t WHERE NOT h AND NOT (r = 0 AND c = 0)),
up AS (SELECT d.t, d.r, d.c, bool_or(a.eff IN ('Both', 'Column')) AS ok FROM d JOIN s a ON a.t = d.t AND a.c = d.c AND a.r < d.r AND a.h
  WHERE NOT EXISTS (SELECT 1 FROM s x, s y WHERE x.t = d.t AND y.t = d.t AND x.c = d.c AND y.c = d.c AND x.r > a.r AND x.r < d.r AND NOT x.h AND y.r > x.r AND y.r < d.r AND y.h) GROUP BY d.t, d.r, d.c),
lf AS (SELECT d.t, d.r, d.c, bool_or(a.eff IN ('Both', 'Row')) AS ok FROM d JOIN s a ON a.t = d.t AND a.r = d.r AND a.c < d.c AND a.h
  WHERE NOT EXISTS (SELECT 1 FROM s x, s y WHERE x.t = d.t AND y.t = d.t AND x.r = d.r AND y.r = d.r AND x.c > a.c AND x.c < d.c AND NOT x.h AND y.c > x.c AND y.c < d.c AND y.h) GROUP BY d.t, d.r, d.c),
bad AS (SELECT d.t, d.r, d.c, unknown FROM d LEFT JOIN up ON up.t = d.t AND up.r = d.r AND up.c = d.c LEFT JOIN lf ON lf.t = d.t AND lf.r = d.r AND lf.c = d.c
  WHERE NOT coalesce(up.ok, false) AND NOT coalesce(lf.ok, false) AND NOT (len(coalesce(headers, [])) > 0 AND len(unknown) = 0))
SELECT t AS "table", CAST(min(r * 3 + c) // 3 AS INT) AS "row", CAST(min(r * 3 + c) % 3 AS INT) AS col, CAST(len(min_by(unknown, r * 3 + c)) AS INT) AS n_unknown FROM bad GROUP BY t""")
def header_connectivity(read):
    p = read("part").select(F.col("p_partkey").alias("table"), "p_size", F.explode(F.expr("sequence(0, 2)")).alias("row")).withColumn("col", F.explode(F.expr("sequence(0, 2)")))
    t, r, c = F.col("table"), F.col("row"), F.col("col")
    name = F.concat(F.lit("h"), r.cast("string"), c.cast("string"))
    k = (t + r + 2 * c) % 4
    cells = p.select(
        "table", "row", "col", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), ((t * (r * 3 + c + 2) + F.col("p_size") * r) % 5 < 2).alias("is_header"),
        F.when(k == 0, "Row").when(k == 1, "Column").alias("scope"), name.alias("id"),
        F.when((F.col("p_size") + c) % 6 == 0, F.array(name, F.lit("hx"))).when((F.col("p_size") + r) % 7 == 0, F.array(F.lit("h00"))).alias("headers"),
    )
    return checks.header_gaps(cells).select("table", "row", "col", F.size("unknown").alias("n_unknown"))


@query("""WITH m AS (SELECT s_suppkey AS g, unnest([s_suppkey % 25, (s_suppkey + 7) % 25]) AS layer FROM supplier WHERE s_suppkey % 5 <> 0), l AS (SELECT n_nationkey AS layer, CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS shown FROM nation),
s AS (SELECT g, bool_and(coalesce(shown, true)) AS a, bool_or(coalesce(shown, true)) AS o FROM m LEFT JOIN l ON m.layer = l.layer GROUP BY g),
i AS (SELECT p_partkey AS item, p_partkey % 25 AS layer, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 100 + 1 END AS g FROM part)
SELECT item, CASE WHEN s.g IS NOT NULL THEN CASE s.g % 4 WHEN 0 THEN a WHEN 1 THEN o WHEN 2 THEN NOT a ELSE NOT o END ELSE coalesce(shown, true) END AS visible FROM i LEFT JOIN s ON i.g = s.g LEFT JOIN l ON i.layer = l.layer""")
def layer_visibility(read):
    s, p, n = F.col("s_suppkey"), F.col("p_partkey"), F.col("n_nationkey")
    policy = F.when(s % 4 == 0, "AllOn").when(s % 4 == 2, "AnyOff").when(s % 4 == 3, "AllOff")
    members = read("supplier").filter(s % 5 != 0).select(s.alias("group"), policy.alias("policy"), F.explode(F.array(s % 25, (s + 7) % 25)).alias("layer"))
    layers = read("nation").select(n.cast("long").alias("layer"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("shown"))
    items = read("part").select(p.alias("item"), (p % 25).alias("layer"), F.when(p % 2 == 0, p % 100 + 1).alias("group"))
    return checks.visible(items, layers, members)


@query("""SELECT c_custkey AS name, CASE c_custkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' ELSE 'choice' END AS kind, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'Yes' ELSE c_mktsegment || ',b' END AS value FROM customer
WHERE c_custkey % 5 <= 2 AND NOT (c_custkey % 5 = 1 AND c_custkey % 3 <> 0) AND NOT (c_custkey % 5 = 0 AND c_custkey % 4 = 0)""")
def form_values(read):
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 0, "text").when(k % 5 == 1, "checkbox").when(k % 5 == 2, "choice").when(k % 5 == 3, "signature").otherwise("button")
    values = F.when((k % 5 == 0) & (k % 4 == 0), F.array(F.lit(""))).when(k % 5 == 2, F.array("c_mktsegment", F.lit("b"))).otherwise(F.array("c_mktsegment"))
    fields = read("customer").select(k.alias("name"), kind.alias("kind"), values.alias("values"), (k % 3 == 0).alias("checked"), F.lit(None).cast("string").alias("on"))
    return checks.collect_form(fields).select("name", "kind", F.array_join("values", ",").alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 OR p_partkey % 10 = 3 THEN NULL ELSE p_brand || '=' || p_brand || ',x=' || p_type END AS options FROM part")
def option_lists(read):
    k = F.col("p_partkey")
    first = F.struct(F.when(k % 6 == 0, "").otherwise(F.col("p_brand")).alias("export"), F.lit(None).cast("string").alias("display"))
    second = F.struct(F.when(k % 10 == 3, F.col("p_brand")).otherwise("x").alias("export"), F.col("p_type").alias("display"))
    out = F.transform(checks.normalize_options(F.array(first, second)), lambda o: F.concat_ws("=", o["export"], o["display"]))
    return read("part").select("p_partkey", F.when(out.isNotNull(), F.array_join(out, ",")).alias("options"))


@query("""WITH v AS (SELECT p_partkey AS doc, 'n' || p_partkey % 6 AS name, CASE p_partkey % 4 WHEN 0 THEN '12' WHEN 1 THEN 'True' ELSE 'abc' END AS value FROM part),
t AS (SELECT *, CASE WHEN doc % 9 = 0 THEN 'integer' WHEN name = 'n1' THEN 'boolean' WHEN name IN ('n1', 'n2', 'n3') THEN 'integer' WHEN name = 'n5' THEN 'text' END AS type FROM v)
SELECT doc, 'p' AS ns, name, type FROM t WHERE (type = 'integer' AND value <> '12') OR (type = 'boolean' AND value <> 'True')""")
def value_types(read):
    k = F.col("p_partkey")
    name = F.concat(F.lit("n"), (k % 6).cast("string"))
    rows = read("part").select(k.alias("doc"), F.lit("p").alias("ns"), name.alias("name"), F.when(k % 4 == 0, "12").when(k % 4 == 1, "True").otherwise("abc").alias("value"))
    own = rows.filter("doc % 9 = 0").select("doc", "ns", "name", F.lit("integer").alias("type"))
    make = rows.sparkSession.createDataFrame
    main = make([("p", "n1", "boolean")], "ns string, name string, type string")
    table = make([("p", "n1", "integer"), ("p", "n2", "integer"), ("p", "n3", "integer"), ("p", "n5", "text")], "ns string, name string, type string")
    ok = F.when(F.col("type") == "integer", F.col("value").rlike("^[+-]?[0-9]+$")).when(F.col("type") == "boolean", F.col("value").isin("True", "False")).otherwise(True)
    return checks.type_mismatches(rows, own, main, table, ok)


OBJECTS_SQL = "o AS (SELECT l_orderkey AS doc, l_linenumber AS object, CASE WHEN l_orderkey % 8 = 0 AND l_linenumber = 1 THEN 'signature' WHEN l_linenumber % 4 = 0 THEN 'popup' WHEN l_partkey % 3 = 0 THEN 'annotation' WHEN l_partkey % 3 = 1 THEN 'form' ELSE 'page' END AS category, CASE WHEN l_linenumber % 4 = 0 THEN l_linenumber - 1 END AS parent FROM lineitem), x AS (SELECT o.*, CASE WHEN o.category = 'popup' THEN coalesce(p.category, 'annotation') ELSE o.category END AS kind, EXISTS (SELECT 1 FROM o s WHERE s.doc = o.doc AND s.category = 'signature') AS signed FROM o LEFT JOIN o p ON o.doc = p.doc AND o.parent = p.object)"


def _objects(read):
    n, k, doc = F.col("l_linenumber"), F.col("l_partkey") % 3, F.col("l_orderkey")
    kind = F.when((doc % 8 == 0) & (n == 1), "signature").when(n % 4 == 0, "popup").when(k == 0, "annotation").when(k == 1, "form").otherwise("page")
    return read("lineitem").select(doc.alias("doc"), n.alias("object"), kind.alias("category"), F.when(n % 4 == 0, n - 1).alias("parent"))


@query(f"WITH {OBJECTS_SQL} SELECT doc, object, category FROM x WHERE signed OR kind NOT IN ('annotation', 'form')")
def sanitized_objects(read):
    return checks.sanitize(_objects(read), ["annotation", "form"])[0].select("doc", "object", "category")


@query(f"WITH {OBJECTS_SQL} SELECT d.doc, c.category, d.signed AS refused, count(x.object) AS removed FROM (SELECT DISTINCT doc, signed FROM x) d CROSS JOIN (VALUES ('annotation'), ('form')) AS c(category) LEFT JOIN x ON x.doc = d.doc AND x.kind = c.category AND NOT x.signed GROUP BY d.doc, c.category, d.signed")
def sanitize_report(read):
    return checks.sanitize(_objects(read), ["annotation", "form"])[1]


@query("""WITH l AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END AS level FROM orders), c AS (SELECT l_orderkey AS doc, CASE l_linenumber % 4 WHEN 0 THEN 'form' WHEN 1 THEN 'signature' WHEN 2 THEN 'annotation' ELSE 'form' END AS kind FROM lineitem WHERE l_partkey % 2 = 0)
SELECT l.doc, CASE WHEN bool_and(level IS NULL OR c.doc IS NULL OR (level = 2 AND kind IN ('form', 'signature')) OR level = 3) THEN 'allowed' ELSE 'refused' END AS verdict FROM l LEFT JOIN c ON l.doc = c.doc GROUP BY l.doc""")
def certified_changes(read):
    n = F.col("l_linenumber") % 4
    levels = read("orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 4).alias("level"))
    changes = read("lineitem").filter("l_partkey % 2 = 0").select(F.col("l_orderkey").alias("doc"), F.when(n == 1, "signature").when(n == 2, "annotation").otherwise("form").alias("kind"))
    return checks.change_verdicts(levels, changes)


@query("""WITH t AS (SELECT doc_id AS annot, unnest([{'key': 'Contents', 'v': text}, {'key': 'T', 'v': source}]) AS x FROM documents),
p AS (SELECT annot, x.key AS key, x.v AS v, unnest(range(1, length(x.v))) AS i FROM t WHERE length(x.v) > 1)
SELECT annot, key, count(*) AS places, CAST(sum(i - 1) AS BIGINT) AS starts FROM p WHERE substr(v, i, 2) = 'in' GROUP BY annot, key""")
def carried_text(read):
    rows = read("documents").select(F.col("doc_id").alias("annot"), F.create_map(F.lit("T"), F.col("source"), F.lit("Contents"), F.col("text"), F.lit("NM"), F.lit("in")).alias("texts"))
    return checks.search_carried_text(rows, "in").groupBy("annot", "key").agg(F.count("*").alias("places"), F.sum("start").cast("long").alias("starts"))


@query("SELECT DISTINCT l_suppkey AS font, l_linenumber AS code, CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END AS mode, CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE CAST(l_quantity AS INT) END AS mcid, coalesce(CASE WHEN l_linestatus = 'F' THEN true END, false) AS artifact FROM lineitem")
def shown_glyphs(read):
    return checks.distinct_glyphs(_glyphs(read))


def _glyphs(read):
    return read("lineitem").select(F.col("l_suppkey").alias("font"), F.col("l_linenumber").alias("code"), F.when(F.col("l_returnflag") == "R", 3).alias("mode"), F.when(F.col("l_partkey") % 2 != 0, F.col("l_quantity").cast("int")).alias("mcid"), F.when(F.col("l_linestatus") == "F", True).alias("artifact"))


@query("SELECT p_partkey AS font, coalesce(string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)), '') AS codes, count(l_linenumber) > 0 AS complete FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 25 GROUP BY p_partkey")
def glyph_codes(read):
    glyphs = read("lineitem").filter("l_quantity > 25").select(F.col("l_partkey").alias("font"), F.col("l_linenumber").cast("long").alias("code"))
    out = checks.glyph_usage(read("part").select(F.col("p_partkey").alias("font")), glyphs)
    return out.select("font", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"), "complete")


@query("SELECT l_suppkey AS page, count(*) FILTER (WHERE l_returnflag = 'R') AS images, count(*) FILTER (WHERE l_quantity > 40) AS large, count(*) FILTER (WHERE l_discount = 0) AS plain FROM lineitem GROUP BY l_suppkey")
def page_feature_scan(read):
    rows = read("lineitem").withColumnRenamed("l_suppkey", "page")
    return checks.page_features(rows, {"images": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 40, "plain": F.col("l_discount") == 0})


@query("SELECT coalesce(a.page_id, b.page_id) AS page, a.url AS old, b.url AS new FROM (SELECT * FROM pages WHERE page_id % 3 <> 0 OR page_id % 4 = 0) a FULL JOIN (SELECT * FROM pages WHERE page_id % 4 <> 0) b ON a.page_id = b.page_id")
def paired_pages(read):
    p = read("pages").select(F.col("page_id").alias("page"), F.col("url").alias("content"))
    return checks.pair_pages(p.filter("page % 3 <> 0 OR page % 4 = 0"), p.filter("page % 4 <> 0"))


@query("""WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS d, CASE WHEN p_partkey % 5 = 0 THEN true WHEN p_partkey % 5 = 1 THEN false END AS c, CASE WHEN p_partkey % 7 < 3 THEN true END AS p, CASE WHEN p_partkey % 2 = 0 THEN true END AS f FROM part)
SELECT k, CASE WHEN d IS NOT NULL THEN d WHEN c IS NULL AND p IS NULL THEN coalesce(f, false) ELSE coalesce(c, false) <> coalesce(p, false) END AS bold, coalesce(CASE WHEN k % 4 = 0 THEN 9 END, CASE WHEN k % 3 = 0 THEN 10 END, 11) AS size FROM t""")
def run_styles(read):
    k = F.col("p_partkey")
    flag = lambda on, off=None: F.when(on, True) if off is None else F.when(on, True).when(off, False)
    bold = checks.resolve_run(flag(k % 3 == 0, k % 3 == 1), [flag(k % 5 == 0, k % 5 == 1)], [flag(k % 7 < 3)], flag(k % 2 == 0), True)
    size = checks.resolve_run(F.when(k % 4 == 0, 9), [], [F.when(k % 3 == 0, 10)], F.lit(11), False)
    return read("part").select(k.alias("k"), bold.alias("bold"), size.alias("size"))


@query("SELECT o_orderkey, 'clerk=' || (o_orderkey % 10) || ' priority=' || replace(replace(o_orderpriority, ' ', '\\ '), '=', '\\=') AS canonical, 'clerk' AS kept, sha256('ctx' || chr(0) || o_orderpriority) AS key_with, sha256(o_orderpriority) AS key_plain FROM orders")
def canonical_keys(read):
    k = (F.col("o_orderkey") % 10).cast("string")
    m = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("clerk"), k)).otherwise(F.create_map(F.lit("clerk"), k, F.lit("priority"), F.col("o_orderpriority")))
    return read("orders").select("o_orderkey", checks.canonical(m).alias("canonical"), F.array_join(F.map_keys(checks.prune_keys(m, ["priority"])), ",").alias("kept"), checks.content_key(F.col("o_orderpriority"), F.lit("ctx")).alias("key_with"), checks.content_key(F.col("o_orderpriority")).alias("key_plain"))


@query("""WITH t AS (SELECT c_custkey AS k, ['Sect', 'H7', 'Aside', 'mrow', 'Art'][c_custkey % 5 + 1] AS name, CASE c_custkey % 4 WHEN 0 THEN 'http://iso.org/pdf/ssn' WHEN 1 THEN 'http://iso.org/pdf2/ssn' WHEN 2 THEN 'http://www.w3.org/1998/Math/MathML' END AS ns FROM customer)
SELECT k, CASE WHEN ns IS NULL OR ns LIKE '%/pdf/ssn' THEN name IN ('Sect', 'Art') WHEN ns LIKE '%pdf2%' THEN name IN ('Sect', 'H7', 'Aside') ELSE true END AS standard, CASE WHEN k % 3 = 0 THEN 'suppress' WHEN k % 3 = 1 THEN 'degraded' END AS policy FROM t""")
def standard_types(read):
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("Sect", "H7", "Aside", "mrow", "Art")]), (k % 5 + 1).cast("int"))
    ns = F.when(k % 4 == 0, checks.OLDER_NS).when(k % 4 == 1, checks.NEWER_NS).when(k % 4 == 2, checks.MATH_NS)
    policy = checks.element_policy(F.when(k % 3 == 1, "canvas").otherwise("p"), F.when(k % 3 == 0, "math").otherwise("html"))
    return read("customer").select(k.alias("k"), checks.is_standard_type(name, ns).alias("standard"), policy.alias("policy"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def documents_with_text(read):
    return checks.with_text(read("documents")).select("doc_id", F.char_length("text").cast("long").alias("n"))
