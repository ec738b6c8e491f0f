"""Queries over folds, differences and parsers; SQL where a recursion or a made-up input can give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.functions import numbers, sequences, text, values
from textloom.operators import sequential, tables
from textloom.shipping import ship

QUERIES: dict = {}


def query(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

    QUERIES[f.__name__] = run
    return f


@query
def chunk_windows(read):
    return sequential.windows(read("documents"))


@query
def pack_pages(read):
    return sequential.conversation_chunks(read("conversations"), 600)


def _turn_pairs(read):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read("conversations").withColumns({"old": F.lag("text").over(w), "new": F.col("text")}).filter("old IS NOT NULL")


@query
def diff_turns(read):
    return sequential.compare(_turn_pairs(read), ["conv_id", "turn"])


@query
def diff_report_html(read):
    return sequential.compare_report(_turn_pairs(read), ["conv_id", "turn"], "html", 3)


@query
def diff_report_markdown(read):
    return sequential.compare_report(_turn_pairs(read), ["conv_id", "turn"], "markdown")


@query
def html_nodes(read):
    return sequential.html_nodes(read("pages"))


@query
def html_link_list(read):
    return sequential.html_links(read("pages"))


@query
def html_text_lines(read):
    return sequential.html_text(read("pages"))


@query
def markdown_blocks(read):
    return sequential.markdown_blocks(read("documents"))


@query
def table_markdown(read):
    cells = F.array(F.array(F.lit("part"), F.lit("a|b")), F.array(F.col("p_name"), F.col("p_size").cast("string")))
    return read("part").select("p_partkey", tables.to_markdown(cells).alias("markdown"))


@query
def table_grid_check(read):
    rows = read("part").select("p_partkey", F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), (F.col("p_size") % 3 + 1).cast("int"))).alias("spans"))
    make = lambda s: [(tables.grid_issue([[(1, c) for c in r] for r in s]),)]
    return sequential.explode_rows(rows, ["p_partkey"], ["spans"], make, "issue string")


@query
def table_stitch(read):
    t = read("supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("table_id"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("page"), F.when(F.col("s_acctbal") > 0, F.array(F.lit(0.0), F.lit(50.0))).otherwise(F.array(F.lit(0.0), F.lit(70.0))).alias("edges"))
    return tables.stitch(t)


@query
def table_column_cuts(read):
    f = read("part").select(F.floor(F.col("p_partkey") / 40).alias("table_id"), (F.col("p_size") * 20.0).alias("x0"), (F.col("p_size") * 20.0 + 9).alias("x1"))
    return tables.column_cuts(f)



@query
def autolinks(read):
    return sequential.explode_rows(read("documents"), ["doc_id"], ["text"], lambda t: [(x,) for x in values.autolinks(t or "")], "link string")


@query
def char_refs(read):
    return sequential.explode_rows(read("pages"), ["page_id"], ["html"], lambda h: [(values.resolve_char_refs(h or ""),)], "text string")


@query
def template_lines(read):
    return read("part").select("p_partkey", text.fill_template("Part {id} of {n}{none} {{x}", {"id": F.col("p_partkey"), "n": F.col("p_size")}).alias("line"))


@query
def exact_sums(read):
    return numbers.exact_sum(read("lineitem"), ["l_suppkey"], "l_extendedprice", "total").withColumn("total", F.round("total", 2))


@query
def exact_sums_of_mixed_sizes(read):
    """Large terms that cancel, and small ones that a plain sum would lose."""
    k = F.col("l_orderkey")
    v = (k % 1000).cast("double") / 8
    terms = F.when(F.col("l_linenumber") == 1, F.array(v, F.lit(1e17), F.lit(-1e17))).otherwise(F.array(v))
    return numbers.exact_sum(read("lineitem").select(F.col("l_suppkey").alias("g"), F.explode(terms).alias("v")), ["g"], "v", "total")


@query
def call_recognition(read):
    k, n = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    script = (
        F.when(k == 0, F.format_string("AFRange_Validate(true, 1, true, %d);", F.col("p_size")))
        .when(k == 1, "AFDate_Format('x')")
        .when(k == 2, F.concat(F.lit("/* c */ AFDate_Format("), n, F.lit(") // end")))
        .when(k == 3, F.concat(F.lit("AFSimple_Calculate('SUM', new Array('a', \"b"), n, F.lit("\"))")))
        .when(k == 4, F.concat(F.lit("AFPercent_Format("), n, F.lit(", 0, false)")))
        .when(k == 5, "AFNumber_Format(2, 0, 0, 0, 'a\\qb', true)")
        .when(k == 6, F.lit(None).cast("string"))
        .otherwise("run()")
    )
    make = lambda s: [(c[0], len(c[1])) if (c := values.parse_call(s)) else (None, -1)]
    return sequential.explode_rows(read("part").select("p_partkey", script.alias("script")), ["p_partkey"], ["script"], make, "name string, arguments int")


@query
def mask_print(read):
    rows = read("customer").select("c_custkey", F.when(F.col("c_custkey") % 50 != 0, F.format_string("%09d", F.col("c_custkey") * 7919)).alias("v"))
    return sequential.explode_rows(rows, ["c_custkey"], ["v"], lambda x: [(sequences.apply_mask("999-99-9999", x),)], "masked string")


@query
def date_pictures(read):
    v = F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "dd.MM.yyyy"))
    rows = read("orders").select("o_orderkey", v.alias("v"))
    return sequential.explode_rows(rows, ["o_orderkey"], ["v"], lambda x: [(sequences.format_date("dd.mm.yyyy", "mmm d, yyyy", x),)], "printed string")


@query
def diff_edited_turns(read):
    """Differences of known size: every fifth word replaced, every seventh dropped, a word put in before every ninth."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    edit = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.when(i % 5 == 0, F.array(F.concat(F.lit("\u00a4r"), i.cast("string")))).when(i % 7 == 0, F.array().cast("array<string>")).when(i % 9 == 0, F.array(F.concat(F.lit("\u00a4i"), i.cast("string")), F.get("w", i - 1))).otherwise(F.array(F.get("w", i - 1)))))
    rows = read("conversations").select("conv_id", "turn", w.alias("w")).filter(F.size("w") > 0).select("conv_id", "turn", F.array_join("w", " ").alias("old"), F.array_join(edit, " ").alias("new"))
    return sequential.compare(rows, ["conv_id", "turn"], semantic=False).drop("changes", "similarity")


@query
def diff_long_texts(read):
    """All texts of a source, one after the other, against the same with every 997th word replaced: long texts with few edits."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    told = read("conversations").select((F.floor(F.col("conv_id") / 50)).alias("part"), "conv_id", "turn", words.alias("w"))
    whole = told.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "w"))).alias("t")).select("part", F.flatten(F.transform("t", lambda r: r["w"])).alias("w"))
    edited = F.transform("w", lambda x, i: F.when(i % 997 == 996, F.concat(F.lit("\u00a4"), i.cast("string"))).otherwise(x))
    rows = whole.select("part", F.array_join("w", " ").alias("old"), F.array_join(edited, " ").alias("new"))
    return sequential.compare(rows, ["part"], semantic=False)


#: Windows one after the other: where each ends (the last line end of its second half, else the last space there) and the next begins.
WINDOWS_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, text, n, 0 AS k, CAST(0 AS BIGINT) AS a, CASE WHEN n <= 1500 THEN n ELSE 1500 - CASE WHEN instr(reverse(substr(text, 1, 1501)), chr(10)) BETWEEN 1 AND 751 THEN instr(reverse(substr(text, 1, 1501)), chr(10)) - 1 WHEN instr(reverse(substr(text, 1, 1501)), ' ') BETWEEN 1 AND 751 THEN instr(reverse(substr(text, 1, 1501)), ' ') - 1 ELSE 0 END END AS b FROM d
  UNION ALL SELECT doc_id, text, n, k + 1, s, CASE WHEN n <= s + 1500 THEN n ELSE s + 1500 - CASE WHEN instr(reverse(substr(text, s + 1, 1501)), chr(10)) BETWEEN 1 AND 751 THEN instr(reverse(substr(text, s + 1, 1501)), chr(10)) - 1 WHEN instr(reverse(substr(text, s + 1, 1501)), ' ') BETWEEN 1 AND 751 THEN instr(reverse(substr(text, s + 1, 1501)), ' ') - 1 ELSE 0 END END
  FROM (SELECT *, CASE WHEN length(g) < b - o THEN o + length(g) + 1 ELSE o END AS s FROM (SELECT *, regexp_extract(substr(text, CAST(o + 1 AS BIGINT), CAST(b - o AS BIGINT)), '^\S*') AS g FROM (SELECT *, greatest(a + 1, b - 200) AS o FROM w WHERE b < n)))),
t AS (SELECT doc_id, k, regexp_replace(regexp_replace(substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)), '^\s+', ''), '\s+$', '') AS "window" FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS ordinal, "window" FROM t WHERE "window" <> ''"""

ORACLES = {
    "chunk_windows": WINDOWS_SQL,
    "template_lines": "SELECT p_partkey, 'Part ' || p_partkey || ' of ' || p_size || ' {x}' AS line FROM part",
    "exact_sums": "SELECT l_suppkey, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total FROM lineitem GROUP BY l_suppkey",
    "call_recognition": """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'AFRange_Validate' WHEN 2 THEN 'AFDate_Format' WHEN 3 THEN 'AFSimple_Calculate' WHEN 4 THEN 'AFPercent_Format' END AS name,
  CASE p_partkey % 8 WHEN 0 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE -1 END AS arguments FROM part""",
    "exact_sums_of_mixed_sizes": "SELECT l_suppkey AS g, CAST(sum(CAST(l_orderkey % 1000 AS DECIMAL(18, 3)) / 8) AS DOUBLE) AS total FROM lineitem GROUP BY l_suppkey",
    "diff_edited_turns": r"""WITH w AS (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM conversations),
c AS (SELECT conv_id, turn, n, len(list_filter(range(1, n + 1), lambda i: i % 5 = 0)) AS r, len(list_filter(range(1, n + 1), lambda i: i % 5 <> 0 AND i % 7 = 0)) AS d, len(list_filter(range(1, n + 1), lambda i: i % 5 <> 0 AND i % 7 <> 0 AND i % 9 = 0)) AS p FROM w WHERE n > 0)
SELECT conv_id, turn, CAST(n - r - d AS INT) AS equal, CAST(r + d AS INT) AS deleted, CAST(r + p AS INT) AS inserted, true AS minimal FROM c""",
    "diff_long_texts": r"""WITH n AS (SELECT CAST(floor(conv_id / 50) AS BIGINT) AS part, CAST(sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS n FROM conversations GROUP BY 1)
SELECT part, CAST(n - n // 997 AS INT) AS equal, CAST(n // 997 AS INT) AS deleted, CAST(n // 997 AS INT) AS inserted, CAST(n // 997 AS INT) AS changes, (n - n // 997) / n AS similarity, true AS minimal FROM n""",
    "mask_print": "SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE substr(v, 1, 3) || '-' || substr(v, 4, 2) || '-' || substr(v, 6, 4) END AS masked FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 9, '0') AS v FROM customer)",
    "date_pictures": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%b %-d, %Y') END AS printed FROM orders",
    "table_markdown": r"""SELECT p_partkey, '| part | a\|b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(regexp_replace(p_name, '([\\`*_\[\]<&~])', '\\\1', 'g'), '|', '\|') || ' | ' || p_size || ' |' AS markdown FROM part""",
    "table_grid_check": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'row 1 reaches 2 of 3 columns' WHEN 2 THEN 'row 1 is wider than 3 columns' END AS issue FROM part""",
    "table_stitch": """WITH t AS (SELECT s_nationkey AS doc_id, s_suppkey AS table_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS page, s_acctbal > 0 AS kind FROM supplier),
n AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY doc_id ORDER BY page) = kind THEN 0 ELSE 1 END AS fresh FROM t)
SELECT doc_id, table_id, CAST(page AS INT) AS page, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS chain FROM n""",
    "table_column_cuts": """WITH f AS (SELECT p_partkey // 40 AS table_id, p_size * 20.0 AS x0, p_size * 20.0 + 9 AS x1 FROM part),
r AS (SELECT table_id, x0, max(x1) OVER (PARTITION BY table_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f)
SELECT table_id, CAST(reach AS DOUBLE) AS cut_from, CAST(x0 AS DOUBLE) AS cut_to FROM r WHERE x0 - reach >= 6""",
}
