"""Registered queries (spark, sf_dir) -> DataFrame, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import dates, numbers, text
from textloom.operators import hygiene, pagesets, relations, retrieval, tables
from textloom.plans.ranking import global_row_number

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Used by several queries.
QUESTION = "the anat of thing tion"
TERMS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def query(sql: str | None = None):
    """Register a query of (read) -> DataFrame, where read(table) gives a table."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


# --- text -------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({TERMS_SQL}) AS INT) AS n_terms, CAST(len(list_distinct({TERMS_SQL})) AS INT) AS n_distinct FROM documents")
def tokenize_terms(read):
    t = text.tokenize(F.col("text"))
    return read("documents").select("doc_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


BM25_SQL = f"""
WITH q AS (SELECT unnest(list_distinct(string_split('{QUESTION}', ' '))) AS term),
d AS (SELECT doc_id, {TERMS_SQL} AS t FROM documents),
n AS (SELECT count(*) AS n, sum(len(t)) / greatest(1, count(*)) AS mean FROM d),
tf AS (SELECT doc_id, len(t) AS len, term, len(list_filter(t, lambda x: x = term)) AS f FROM d, q),
df AS (SELECT term, count(*) AS df FROM tf WHERE f > 0 GROUP BY term),
s AS (SELECT tf.doc_id, sum(CASE WHEN f > 0 THEN ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * tf.len / n.mean)) ELSE 0 END) AS score
  FROM tf JOIN df ON tf.term = df.term, n GROUP BY tf.doc_id)
"""


@query(BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM s")
def bm25_rank(read):
    return retrieval.bm25(read("documents"), QUESTION).select("doc_id", F.round("score", 6).alias("score"))


@query(BM25_SQL + """, r AS (SELECT s.doc_id, length(d.text) AS size, row_number() OVER (ORDER BY round(score, 9) DESC, s.doc_id) AS rank FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE score > 0),
u AS (SELECT *, sum(size) OVER (ORDER BY rank) AS used FROM r WHERE rank <= 8)
SELECT doc_id, CAST(rank AS INT) AS rank, CAST(used AS BIGINT) AS used FROM u WHERE used <= 20000""")
def bm25_topk_budget(read):
    docs = read("documents")
    best = retrieval.bm25(docs, QUESTION).withColumn("score", F.round("score", 9)).join(docs.select("doc_id", F.char_length("text").alias("size")), "doc_id")
    return retrieval.select_under_budget(best, 20000).select("doc_id", "rank", "used")


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS INT) AS n_words FROM documents")
def word_split_counts(read):
    return read("documents").select("doc_id", F.size(text.tokenize_words(F.col("text"))).alias("n_words"))


@query("""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-Latn-CH' WHEN 2 THEN lang || '-a-ch' ELSE '' END AS tag FROM documents),
r AS (SELECT unnest(['en', 'DE', '*', 'fr-ch', '*-CH', 'es-*-ch']) AS wanted)
SELECT wanted, count(*) AS documents, CAST(sum(doc_id) AS BIGINT) AS ids FROM t, r
WHERE tag <> '' AND (
  wanted = '*' OR (wanted IN ('en', 'DE') AND split_part(lower(tag), '-', 1) = lower(wanted))
  OR (wanted = 'fr-ch' AND lower(tag) = 'fr-latn-ch') OR (wanted = '*-CH' AND lower(tag) LIKE '%-latn-ch') OR (wanted = 'es-*-ch' AND lower(tag) = 'es-latn-ch'))
GROUP BY wanted""")
def lang_filter(read):
    d, lang = read("documents"), F.col("lang")
    k = F.col("doc_id") % 4
    tag = F.when(k == 0, lang).when(k == 1, F.concat(F.upper(lang), F.lit("-Latn-CH"))).when(k == 2, F.concat(lang, F.lit("-a-ch"))).otherwise("")
    rows = d.select("doc_id", tag.alias("tag"), F.explode(F.array(*[F.lit(x) for x in ("en", "DE", "*", "fr-ch", "*-CH", "es-*-ch")])).alias("wanted"))
    return rows.filter(text.lang_matches(F.col("tag"), F.col("wanted"))).groupBy("wanted").agg(F.count("*").alias("documents"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM documents")
def markup_escape(read):
    return read("documents").select("doc_id", F.sha2(text.escape_markup(F.col("text")), 256).alias("escaped"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '([\\`*_\[\]<&~])', '\\\1', 'g')) AS inline_form, sha256(replace(regexp_replace(text, '([\\`*_\[\]<&~])', '\\\1', 'g'), '|', '\|')) AS cell_form FROM documents")
def markdown_escape(read):
    t = F.col("text")
    return read("documents").select("doc_id", F.sha2(text.escape_markdown_inline(t), 256).alias("inline_form"), F.sha2(text.escape_table_cell(t), 256).alias("cell_form"))


@query(r"""SELECT doc_id, sha256(coalesce(list_aggregate(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '([\\`*_\[\]<&~|])', '\\\1', 'g'), '^(\s{0,3})([#>+=-])', '\1\\\2'), '^(\s{0,3})(\d{1,9})([.)])', '\1\2\\\3')), 'string_agg', chr(10)), '')) AS block_form FROM documents""")
def markdown_block_escape(read):
    return read("documents").select("doc_id", F.sha2(text.escape_markdown(F.col("text")), 256).alias("block_form"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '[\s()]') THEN '<' || regexp_replace(url, '([\\<>])', '\\\1', 'g') || '>' ELSE regexp_replace(url, '([\\<>])', '\\\1', 'g') END AS target FROM pages""")
def link_destination(read):
    return read("pages").select("page_id", text.escape_link_destination(F.col("url")).alias("target"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<(/?)(title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext)([\s/>])')) AS disallowed,
  sha256(regexp_replace(html, '<(/?)(title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext)([\s/>])', '&lt;\1\2\3', 'gi')) AS filtered FROM pages""")
def html_filter(read):
    h = F.col("html")
    out = text.filter_disallowed_html(h)
    n = (F.length(out) - F.length(h)) / 3
    return read("pages").select("page_id", n.cast("long").alias("disallowed"), F.sha2(out, 256).alias("filtered"))


@query(r"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' ```json' || chr(10) || '{"id": ' || doc_id || '}' || chr(10) || '``` ' WHEN 1 THEN '{"id": ' || doc_id || '}' ELSE 'see ```x```' END AS reply FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'see ```x```' ELSE '{"id": ' || doc_id || '}' END AS body, CASE doc_id % 3 WHEN 2 THEN -1 ELSE doc_id END AS id FROM r""")
def json_fence(read):
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 3
    plain = F.concat(F.lit('{"id": '), i, F.lit("}"))
    reply = F.when(k == 0, F.concat(F.lit(" ```json\n"), plain, F.lit("\n``` "))).when(k == 1, plain).otherwise("see ```x```")
    body = text.strip_json_fence(reply)
    return read("documents").select("doc_id", body.alias("body"), F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.id", "bigint"), F.lit(-1)).alias("id"))


@query(r"""WITH l AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '• point' WHEN 1 THEN (doc_id % 90) || '. item' WHEN 2 THEN '(iv) part' WHEN 3 THEN '☑ done' ELSE 'plain text' END AS line FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'bullet' WHEN 1 THEN 'ordinal' WHEN 2 THEN 'ordinal' WHEN 3 THEN 'task' END AS kind, CASE WHEN doc_id % 5 = 1 THEN CAST(doc_id % 90 AS INT) ELSE -1 END AS ordinal,
  CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN length(CAST(doc_id % 90 AS VARCHAR)) + 2 WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 0 END AS length FROM l""")
def list_markers(read):
    i, k = F.col("doc_id"), F.col("doc_id") % 5
    line = F.when(k == 0, "• point").when(k == 1, F.concat((i % 90).cast("string"), F.lit(". item"))).when(k == 2, "(iv) part").when(k == 3, "☑ done").otherwise("plain text")
    return read("documents").select("doc_id", text.marker(line).alias("m")).select("doc_id", "m.kind", F.coalesce("m.ordinal", F.lit(-1)).alias("ordinal"), F.coalesce("m.length", F.lit(0)).alias("length"))


@query("SELECT doc_id, replace(text, 'the', '███') AS text, CAST(len(regexp_extract_all(text, 'the')) AS BIGINT) AS n_redacted FROM documents")
def redact_text(read):
    return hygiene.redact_table(read("documents").select("doc_id", "text"), "the")


@query(r"SELECT conv_id, CAST(sum(len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), lambda x: x = 'the'))) AS BIGINT) AS n_redacted FROM conversations GROUP BY conv_id")
def redact_count(read):
    out = hygiene.redact_table(read("conversations").select("conv_id", "text"), "the", whole_word=True, ignore_case=True)
    return out.groupBy("conv_id").agg(F.sum("n_redacted").alias("n_redacted"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'), lambda x: x = 'anat')) AS INT) AS places, CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_])anat([^\p{L}\p{M}\p{N}_]|$)') THEN CAST(length(regexp_extract(text, '^((?:.|\n)*?[^\p{L}\p{M}\p{N}_])?anat([^\p{L}\p{M}\p{N}_]|$)', 1)) AS INT) ELSE -1 END AS first_start FROM documents")
def whole_word_search(read):
    out = read("documents").select("doc_id", text.find_ranges(F.col("text"), "anat", whole_word=True).alias("r"))
    return out.select("doc_id", F.size("r").alias("places"), F.coalesce(F.get("r", F.lit(0))["start"], F.lit(-1)).alias("first_start"))


@query("""WITH m AS (SELECT doc_id, md5(coalesce(source, '') || chr(0) || text) AS k, octet_length(CAST(text AS BLOB)) AS size FROM documents)
SELECT min_by(doc_id, (size, doc_id)) AS doc_id, count(*) AS copies FROM m GROUP BY k""".replace("octet_length(CAST(text AS BLOB))", "strlen(text)"))
def exact_dedup_keep_smallest(read):
    return hygiene.dedup_exact(read("documents"), ["source", "text"]).select("doc_id", "copies")


@query(r"""WITH l AS (SELECT source, doc_id, regexp_replace(regexp_replace(trim(x), '\s+', ' ', 'g'), '\d+', '#', 'g') AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents))
SELECT source, line, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM l WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3""")
def repeated_lines(read):
    return hygiene.repeated_lines(read("documents"), "source", 3)


@query(f"""WITH i AS (SELECT item_id, unnest(list_distinct({TERMS_SQL})) AS term FROM benchmark), n AS (SELECT item_id, count(*) AS n_terms FROM i GROUP BY item_id),
d AS (SELECT doc_id, unnest(list_distinct({TERMS_SQL})) AS term FROM documents),
h AS (SELECT d.doc_id, i.item_id, count(*) AS shared, min(n.n_terms) AS n_terms FROM d JOIN i ON d.term = i.term JOIN n ON n.item_id = i.item_id GROUP BY d.doc_id, i.item_id)
SELECT doc_id, item_id, shared, n_terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared / n_terms DESC, item_id) AS r FROM h) WHERE r = 1""")
def benchmark_overlap(read):
    return hygiene.benchmark_overlap(read("documents"), read("benchmark"))


@query("SELECT doc_id, crc32_ AS text_crc, length(text) AS n_chars, sha256(source || chr(0) || text) AS image_key FROM (SELECT *, 0 AS crc32_ FROM documents)".replace("crc32_ AS text_crc, ", "").replace("(SELECT *, 0 AS crc32_ FROM documents)", "documents"))
def content_key(read):
    return read("documents").select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.concat("source", F.lit("\x00"), "text"), 256).alias("image_key"))


@query("SELECT doc_id, list_filter(list_transform(string_split(source || ' , ' || lang || ',, x ', ','), lambda x: trim(x)), lambda x: x <> '') AS authors FROM documents")
def author_split(read):
    return read("documents").select("doc_id", text.split_authors(F.concat("source", F.lit(" , "), "lang", F.lit(",, x "))).alias("authors"))


@query(r"SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 7 = 0 THEN chr(57345) ELSE '' END, '[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]') AS private_use FROM documents")
def private_use(read):
    t = F.concat("text", F.when(F.col("doc_id") % 7 == 0, "\ue001").otherwise(""))
    return read("documents").select("doc_id", text.contains_private_use(t).alias("private_use"))


# --- pages ------------------------------------------------------------------------------


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(read):
    return read("pages").select("page_id", F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")).alias("title"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href="[^"]*"')) AS INT) AS links FROM pages""")
def html_links(read):
    return read("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="[^"]*"'), F.lit(0))).alias("links"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS visible FROM pages""")
def html_visible_text(read):
    cut = F.regexp_replace("html", r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<[^>]*>", " ")
    return read("pages").select("page_id", F.trim(F.regexp_replace(cut, r"[ \t\r\n]+", " ")).alias("visible"))


@query("SELECT page_id, CASE WHEN length(CAST(n AS VARCHAR)) >= 6 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 6, '0') END AS bates FROM (SELECT page_id, 1 + 3 * (row_number() OVER (ORDER BY page_id) - 1) AS n FROM pages)")
def bates_numbers(read):
    rows = global_row_number(read("pages").select("page_id"), "page_id")
    return rows.select("page_id", numbers.bates(1 + 3 * (F.col("row_number") - 1)).alias("bates"))


# --- numbers and dates --------------------------------------------------------------------


@query("""SELECT o_orderkey, format('{:,.2f}', v) AS plain, CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || replace(replace(replace(format('{:,.2f}', abs(v)), ',', '_'), '.', ','), '_', '.') AS euro_style,
  CASE WHEN v < 0 THEN '(' ELSE '' END || format('{:,.2f}', abs(v)) || ' CHF' || CASE WHEN v < 0 THEN ')' ELSE '' END AS parentheses
FROM (SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(18, 2))::DOUBLE * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS v FROM orders)""")
def number_format(read):
    v = F.round("o_totalprice", 2) * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    t = v.cast("decimal(18,2)").cast("string")
    return read("orders").select("o_orderkey", numbers.number_format(t, 2, 0, 0, "", False).alias("plain"), numbers.number_format(t, 2, 2, 0, "$", True).alias("euro_style"), numbers.number_format(t, 2, 0, 2, " CHF", False).alias("parentheses"))


@query("SELECT p_partkey, format('{:.1f}', p_size * 100.0) || '%' AS percent FROM part")
def percent_format(read):
    return read("part").select("p_partkey", numbers.percent_format(F.col("p_size").cast("string"), 1, 1).alias("percent"))


@query("""WITH t AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '0') AS d FROM customer)
SELECT c_custkey, substr(d, 1, 5) AS zip, substr(d, 1, 5) || '-' || substr(d, 6, 4) AS zip_long, '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) AS phone, substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6, 4) AS ssn FROM t""")
def special_format(read):
    d = F.lpad((F.col("c_custkey") * 7919 % 10_000_000_000).cast("string"), 10, "0")
    return read("customer").select("c_custkey", *[numbers.special_format(d, k).alias(n) for k, n in enumerate(("zip", "zip_long", "phone", "ssn"))])


@query("SELECT p_partkey, p_size >= 10 AND p_size <= 40 AS ok FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT p_partkey, true FROM part WHERE p_partkey % 9 = 0")
def range_validate(read):
    t = F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    return read("part").select("p_partkey", numbers.range_validate(t, 10, 40).alias("ok"))


@query("""WITH t AS (SELECT l_returnflag, CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE CAST(round(l_extendedprice, 2) AS DECIMAL(28, 6)) END AS v FROM lineitem)
SELECT l_returnflag, CAST(sum(v) AS DOUBLE) AS total, floor(CAST(sum(v) / count(*) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS mean, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS most FROM t GROUP BY l_returnflag""".replace("floor(CAST(sum(v) / count(*) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS mean", "round(CAST(sum(v) AS DOUBLE) / count(*), 2) AS mean"))
def simple_calculate(read):
    t = F.when(F.col("l_orderkey") % 11 == 0, "n/a").otherwise(F.round("l_extendedprice", 2).cast("decimal(18,2)").cast("string"))
    rows = read("lineitem").select("l_returnflag", t.alias("t"))
    out = rows.groupBy("l_returnflag").agg(*[numbers.simple_calculate(k, F.col("t")).alias(n) for k, n in (("SUM", "total"), ("AVG", "mean"), ("MIN", "least"), ("MAX", "most"))])
    return out.withColumn("mean", F.round("mean", 2))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 7 AS k, strftime(o_orderdate, '%Y%m%d%H%M%S') AS s, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS i, epoch_ms(o_orderdate) AS ms, epoch_ms(date_trunc('day', o_orderdate)) AS day, epoch_ms(date_trunc('month', o_orderdate)) AS month FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN i || '+02:00' WHEN 1 THEN i[1:10] WHEN 2 THEN i || 'Z' WHEN 3 THEN i[1:7] END AS iso,
  CASE k WHEN 0 THEN 'D:' || s || '+02''00''' WHEN 1 THEN 'D:' || s[1:8] WHEN 2 THEN 'D:' || s || 'Z' WHEN 3 THEN 'D:' || s[1:6] END AS pdf,
  CAST(CASE k WHEN 0 THEN ms - 7200000 WHEN 1 THEN day WHEN 2 THEN ms WHEN 3 THEN month END AS BIGINT) AS instant FROM t""")
def date_round_trip(read):
    """Whole dates, days without a prefix, zones in words, months; days that no month has, zones that don't exist and zones without a clock are no dates."""
    k, s = F.col("o_orderkey") % 7, F.date_format("o_orderdate", "yyyyMMddHHmmss")
    d = F.when(k == 0, F.concat(F.lit("D:"), s, F.lit("+02'00'"))).when(k == 1, F.substring(s, 1, 8)).when(k == 2, F.concat(F.lit(" D:"), s, F.lit("Z00'00' "))).when(k == 3, F.concat(F.lit("D:"), F.substring(s, 1, 6)))
    d = d.when(k == 4, F.concat(F.lit("D:"), F.substring(s, 1, 4), F.lit("0231"))).when(k == 5, F.concat(F.lit("D:"), F.substring(s, 1, 10), F.lit("+99'99'"))).otherwise(F.concat(F.lit("D:"), F.substring(s, 1, 8), F.lit("Z")))
    iso = dates.pdf_date_to_iso(d)
    return read("orders").select("o_orderkey", iso.alias("iso"), dates.iso_to_pdf_date(iso).alias("pdf"), dates.iso_instant(iso).cast("long").alias("instant"))


# --- joins and aggregates -------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_orderkey % 10 <> 0), n AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'freed' ELSE 'replaced' END AS change
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.p IS DISTINCT FROM n.p""")
def snapshot_delta(read):
    o = read("orders").select("o_orderkey", F.col("o_totalprice").alias("p"))
    return relations.delta(o.filter("o_orderkey % 10 <> 0"), o.filter("o_orderkey % 7 <> 0").withColumn("p", F.col("p") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)), "o_orderkey")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'purchase'""")
def newest_wins(read):
    rows = read("events").select("user_id", "event_id", "event_type", "ts")
    return relations.newest_wins(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").drop("ts")


@query("SELECT doc_id, source, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, source, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 50000")
def budget_prefix(read):
    return relations.budget_prefix(read("documents").select("doc_id", "source", "text"), "source", "doc_id", F.octet_length("text"), 50000).select("doc_id", "source", "used")


@query("""WITH r AS (SELECT conv_id, start_index, CASE conv_id % 3 WHEN 0 THEN 'r' WHEN 1 THEN 'D' ELSE 'A' END AS style, 'p' || start_index || '-' AS prefix, 1 + 26 * (conv_id % 2) AS start
  FROM (SELECT DISTINCT conv_id, unnest([1, 3 + conv_id % 4]) AS start_index FROM conversations WHERE conv_id % 5 <> 0)),
j AS (SELECT c.conv_id, c.turn, r.start_index, r.style, r.prefix, r.start + c.turn - r.start_index AS n FROM conversations c ASOF LEFT JOIN r ON c.conv_id = r.conv_id AND c.turn >= r.start_index)
SELECT conv_id, turn, CASE WHEN style IS NULL THEN CAST(turn + 1 AS VARCHAR) WHEN style = 'D' THEN prefix || n WHEN style = 'A' THEN prefix || repeat(chr(CAST(65 + (n - 1) % 26 AS INT)), CAST(floor((n - 1) / 26) + 1 AS INT))
  ELSE prefix || repeat('x', CAST(floor(n / 10) AS INT)) || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(n % 10 AS INT) + 1] END AS label FROM j""")
def page_label_asof(read):
    c, k = read("conversations").select("conv_id", "turn"), F.col("conv_id")
    r = c.select("conv_id").distinct().filter(k % 5 != 0).select("conv_id", F.explode(F.array(F.lit(1).cast("long"), 3 + k % 4)).alias("start_index"))
    ranges = r.select("conv_id", "start_index", F.when(k % 3 == 0, "r").when(k % 3 == 1, "D").otherwise("A").alias("style"), F.concat(F.lit("p"), F.col("start_index").cast("string"), F.lit("-")).alias("prefix"), (1 + 26 * (k % 2)).alias("start"))
    return relations.label_asof(c, F.col("turn"), ranges, "conv_id").select("conv_id", "turn", "label")


@query("""WITH p AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, e.event_id, CASE WHEN k % 5 = 0 THEN 'five' WHEN k % 2 = 0 THEN 'even' END AS bound FROM events e JOIN p ON p.event_id = e.event_id""")
def bind_left_join(read):
    e = read("events").select("user_id", "event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    fields = e.select(F.col("event_id").alias("field"), F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("name"), F.when(F.col("k") % 5 == 0, "a.five").otherwise("a.none").alias("path"), F.lit("global").alias("match"))
    data = e.sparkSession.createDataFrame([("a.five", "five", 0, "five"), ("b.even", "even", 1, "even"), ("c.even", "even", 2, "later")], "path string, name string, pos int, value string")
    return e.select("user_id", "event_id").join(relations.bind_fields(fields, data).select(F.col("field").alias("event_id"), F.col("value").alias("bound")), "event_id")


@query("""WITH e AS (SELECT doc_id + 5 AS name, CASE WHEN toxic = 1 THEN 'x' ELSE CAST(quality AS VARCHAR) END AS value FROM labels)
SELECT e.name, CASE WHEN d.doc_id IS NULL THEN 'no such field' WHEN d.lang = 'es' THEN 'not settable' WHEN d.lang = 'en' AND value = 'x' THEN 'type mismatch' ELSE 'imported' END AS status FROM e LEFT JOIN documents d ON d.doc_id = e.name""")
def import_report(read):
    entries = read("labels").select((F.col("doc_id") + 5).alias("name"), F.when(F.col("toxic") == 1, "x").otherwise(F.col("quality").cast("string")).alias("value"))
    fields = read("documents").select(F.col("doc_id").alias("name"), F.when(F.col("lang") == "en", "number").otherwise("text").alias("kind"), (F.col("lang") != "es").alias("settable"))
    return relations.import_report(entries, fields)


@query("""SELECT coalesce(s.k, t.k) AS field, CASE WHEN s.k % 6 = 0 THEN 'skip' WHEN s.v IS NULL THEN 'delete' ELSE 'write' END AS action
FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 4 <> 0) s
FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0) t ON s.k = t.k
WHERE coalesce(s.k % 6 = 0, false) OR (s.v IS NULL AND t.v IS NOT NULL) OR (s.v IS NOT NULL AND s.v IS DISTINCT FROM t.v)""")
def metadata_sync(read):
    c, k = read("customer"), F.col("c_custkey")
    s = c.filter(k % 4 != 0).select(k.alias("field"), F.when(k % 5 == 0, None).otherwise(F.col("c_mktsegment")).alias("value"), (k % 6 != 0).alias("readable"))
    t = c.filter(k % 7 != 0).select(k.alias("field"), F.when(k % 3 == 0, "old").otherwise(F.col("c_mktsegment")).alias("value"))
    return relations.sync_plan(s, t)


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey % 97 * 10.0 AS x0, p_partkey % 89 * 10.0 AS y0, p_partkey % 97 * 10.0 + p_size AS x1, p_partkey % 89 * 10.0 + 8 AS y1 FROM part),
r AS (SELECT s_suppkey % 53 * 17.0 AS x0, s_suppkey % 47 * 19.0 AS y0, s_suppkey % 53 * 17.0 + 12 AS x1, s_suppkey % 47 * 19.0 + 12 AS y1 FROM supplier)
SELECT id FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE b.x0 < r.x1 AND r.x0 < b.x1 AND b.y0 < r.y1 AND r.y0 < b.y1)""")
def covered_boxes(read):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    b = read("part").select(k.alias("id"), (k % 97 * 10.0).alias("x0"), (k % 89 * 10.0).alias("y0"), (k % 97 * 10.0 + F.col("p_size")).alias("x1"), (k % 89 * 10.0 + 8).alias("y1"))
    r = read("supplier").select((s % 53 * 17.0).alias("x0"), (s % 47 * 19.0).alias("y0"), (s % 53 * 17.0 + 12).alias("x1"), (s % 47 * 19.0 + 12).alias("y1"))
    return relations.uncovered(b, r, 32.0).select("id")


@query("SELECT p_partkey, CAST(coalesce(uses, 0) AS BIGINT) AS uses, coalesce(highest, 0) AS highest, uses IS NOT NULL AS complete FROM part LEFT JOIN (SELECT l_partkey, count(*) AS uses, max(l_quantity) AS highest FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON l_partkey = p_partkey")
def usage_report(read):
    uses = read("lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return relations.usage_report(read("part"), uses, "p_partkey", "l_quantity")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def prune_unused(read):
    uses = read("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    veto = read("region").select((F.col("r_regionkey") < 0).alias("veto"))
    return relations.prune_unused(read("part").select("p_partkey"), uses, veto)


@query("""SELECT 'empty' AS rule, 'error' AS severity, count(*) FILTER (WHERE length(text) = 0) AS issues, count(*) FILTER (WHERE length(text) = 0) = 0 AS passes FROM documents
UNION ALL SELECT 'long', 'warning', count(*) FILTER (WHERE length(text) > 5000), true FROM documents UNION ALL SELECT 'language', 'error', count(*) FILTER (WHERE lang = 'es'), count(*) FILTER (WHERE lang = 'es') = 0 FROM documents""")
def issue_summary(read):
    return relations.issue_report(read("documents"), {"empty": ("error", F.length("text") > 0), "long": ("warning", F.length("text") <= 5000), "language": ("error", F.col("lang") != "es")})


@query("""WITH h AS (SELECT p_size AS size, sum(length(p_name)) AS weight FROM part GROUP BY p_size), b AS (SELECT size AS body FROM h ORDER BY weight DESC, size LIMIT 1)
SELECT size, CAST(weight AS BIGINT) AS weight, CAST(CASE WHEN size = body THEN 0 WHEN size > body THEN least(6, dense_rank() OVER (ORDER BY size DESC)) ELSE -1 END AS INT) AS rank FROM h, b""")
def heading_histogram(read):
    out = relations.heading_ranks(read("part").withColumn("w", F.length("p_name")), "p_size", "w")
    return out.withColumn("rank", F.coalesce("rank", F.lit(-1)))


@query("SELECT o_custkey, list_sort(list(o_totalprice))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM orders GROUP BY o_custkey")
def upper_median(read):
    return relations.upper_median(read("orders"), "o_custkey", "o_totalprice")


@query("SELECT l_suppkey, CAST(v AS INT) AS mode FROM (SELECT l_suppkey, l_linenumber AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber DESC) AS r FROM lineitem GROUP BY l_suppkey, l_linenumber) WHERE r = 1")
def modal_count(read):
    return relations.modal(read("lineitem"), "l_suppkey", "l_linenumber")


@query("""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 1 END AS level FROM conversations)
SELECT conv_id, turn, CAST(sum(CASE WHEN level = m THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS chapter FROM (SELECT *, min(level) OVER (PARTITION BY conv_id) AS m FROM t)""")
def split_chapters(read):
    level = F.when(F.col("role") == "user", 2).when(F.col("role") == "assistant", 3).otherwise(1)
    return relations.chapters(read("conversations").select("conv_id", "turn", level.alias("level")), "conv_id", "turn", "level").drop("level")


@query("SELECT conv_id, sum(CASE WHEN turn % 2 = 0 THEN length(text) END) AS units FROM conversations GROUP BY conv_id")
def usage_sum(read):
    return read("conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("turn") % 2 == 0, F.char_length("text"))).alias("units"))


@query("""SELECT doc_id, unnest(list_filter(list_distinct(list_concat(range(1, least(3, n) + 1), list_concat([least(2, n)], CASE WHEN n >= 5 THEN range(5, n + 1) ELSE [] END))), lambda x: true)) AS page
FROM (SELECT doc_id, 5 + doc_id % 6 AS n FROM documents)""")
def page_range_expand(read):
    return read("documents").select("doc_id", F.explode(tables.page_range("1-3, 2,5-", 5 + F.col("doc_id") % 6)).alias("page"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, list_transform(string_split(line, ' | '), lambda x: trim(x)) AS cells FROM l WHERE line LIKE '% | % | %')
SELECT doc_id, count(*) AS n_rows, CAST(max(len(cells)) AS INT) AS n_columns, sha256(string_agg(sha256(list_aggregate(cells, 'string_agg', '|')), '' ORDER BY sha256(list_aggregate(cells, 'string_agg', '|')))) AS digest FROM t GROUP BY doc_id""")
def table_rows(read):
    lines = read("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line LIKE '% | % | %'")
    cells = F.transform(F.split("line", r" \| "), lambda x: F.trim(x))
    one = F.sha2(F.array_join("cells", "|"), 256)
    return lines.select("doc_id", cells.alias("cells")).groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_columns"), F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ""), 256).alias("digest"))


# --- page sets and look-ups ------------------------------------------------------------------


@query("""WITH a AS (SELECT page_id + 1 AS page FROM pages), b AS (SELECT page_id + 1 AS page FROM pages WHERE page_id % 3 = 0)
SELECT 0 AS source, page, row_number() OVER (ORDER BY page) AS new_page FROM a UNION ALL SELECT 1, page, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY page) FROM b""")
def page_merge(read):
    a = read("pages").select((F.col("page_id") + 1).alias("page"))
    return pagesets.merge([a, a.filter((F.col("page") - 1) % 3 == 0)])


@query("SELECT page_id + 1 AS page, page_id + 1 - CASE WHEN page_id + 1 > 3 THEN 1 ELSE 0 END - CASE WHEN page_id + 1 > 40 THEN 1 ELSE 0 END AS new_page FROM pages WHERE page_id + 1 NOT IN (3, 40)")
def page_remove(read):
    return pagesets.remove(read("pages").select((F.col("page_id") + 1).alias("page")), [40, 3])


@query("""WITH n AS (SELECT count(*) AS n FROM pages WHERE page_id % 10 = 0)
SELECT 0 AS source, page_id + 1 AS page, page_id + 1 + CASE WHEN page_id + 1 >= 5 THEN n.n ELSE 0 END AS new_page FROM pages, n
UNION ALL SELECT 1, page_id + 1, 4 + row_number() OVER (ORDER BY page_id) FROM pages WHERE page_id % 10 = 0""")
def page_insert(read):
    pages = read("pages").select((F.col("page_id") + 1).alias("page"))
    return pagesets.insert(pages, 5, pages.filter((F.col("page") - 1) % 10 == 0))


@query("SELECT page_id + 1 AS page, CAST(floor(page_id / 7) + 1 AS BIGINT) AS part, page_id % 7 + 1 AS new_page FROM pages")
def page_split(read):
    return pagesets.split(read("pages").select((F.col("page_id") + 1).alias("page")), 7)


@query("SELECT p.page_id AS page, o.new_page, p.url FROM pages p JOIN (VALUES (9, 1), (2, 2), (9, 3)) AS o(page, new_page) ON p.page_id = o.page")
def page_reorder(read):
    return pagesets.extract(read("pages").select(F.col("page_id").alias("page"), "url"), [9, 2, 9])


@query("""SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, coalesce(b.s_name, a.s_name) AS s_name, CASE WHEN b.s_suppkey IS NULL THEN 'kept' WHEN a.s_suppkey IS NULL THEN 'added' ELSE 'replaced' END AS change
FROM (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 <> 0) a FULL JOIN (SELECT s_suppkey, 'new ' || s_name AS s_name FROM supplier WHERE s_suppkey % 3 = 0) b ON a.s_suppkey = b.s_suppkey""")
def annotation_upsert(read):
    s = read("supplier").select("s_suppkey", "s_name")
    return pagesets.upsert(s.filter("s_suppkey % 4 <> 0"), s.filter("s_suppkey % 3 = 0").withColumn("s_name", F.concat(F.lit("new "), "s_name")), ["s_suppkey"])


@query("""SELECT n_name AS name, coalesce((SELECT min(r_regionkey) FROM region WHERE r_name = n_name), (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey)) AS target FROM nation""")
def named_targets(read):
    n = read("nation")
    first = read("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("target"))
    then = read("supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.col("s_suppkey").alias("target"))
    return pagesets.resolve_names(n.select(F.col("n_name").alias("name")), first, then)


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_copies(read):
    return pagesets.first_of_each(read("documents").select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id")


@query("SELECT doc_id, 'characters' AS limit_name, length(text) AS value FROM documents WHERE length(text) > 3000 UNION ALL SELECT doc_id, 'lines', len(string_split(text, chr(10))) FROM documents WHERE len(string_split(text, chr(10))) > 12")
def limit_report(read):
    out = pagesets.over_limits(read("documents"), {"characters": (F.char_length("text"), 3000), "lines": (F.size(F.split("text", "\n")), 12), "off": (F.lit(1), None)}, "doc_id")
    return out.withColumnRenamed("limit", "limit_name")


@query("""WITH w AS (SELECT c_custkey AS name, c_mktsegment AS family, c_custkey % 9 * 100 AS weight FROM customer), f AS (SELECT DISTINCT c_mktsegment || '-' || w AS face, c_mktsegment AS family, w AS weight FROM customer, (VALUES (200), (400), (700)) AS t(w) WHERE c_mktsegment <> 'MACHINERY')
SELECT name, face FROM (SELECT w.name, f.face, row_number() OVER (PARTITION BY w.name ORDER BY abs(w.weight - f.weight), f.face) AS r FROM w LEFT JOIN f ON w.family = f.family) WHERE r = 1""")
def face_substitution(read):
    c = read("customer")
    w = c.select(F.col("c_custkey").alias("name"), F.lower("c_mktsegment").alias("family"), (F.col("c_custkey") % 9 * 100).alias("weight"))
    f = c.filter("c_mktsegment <> 'MACHINERY'").select("c_mktsegment").distinct().withColumn("weight", F.explode(F.array(F.lit(200), F.lit(400), F.lit(700))))
    return pagesets.substitute(w, f.select(F.concat_ws("-", "c_mktsegment", "weight").alias("face"), F.col("c_mktsegment").alias("family"), "weight"))


@query("""WITH c AS (SELECT p_partkey AS cell_id, p_partkey % 31 * 20.0 AS x0, p_partkey % 17 * 10.0 AS y0, p_partkey % 31 * 20.0 + 20 AS x1, p_partkey % 17 * 10.0 + 10 AS y1 FROM part),
f AS (SELECT s_suppkey AS position, 'c' || s_suppkey AS color, s_suppkey % 31 * 20.0 + 0.75 AS x0, s_suppkey % 17 * 10.0 - 0.5 AS y0, s_suppkey % 31 * 20.0 + 20 AS x1, s_suppkey % 17 * 10.0 + 10 AS y1 FROM supplier)
SELECT c.cell_id, max_by(f.color, f.position) AS color FROM c LEFT JOIN f ON abs(c.x0 - f.x0) <= 1 AND abs(c.y0 - f.y0) <= 1 AND abs(c.x1 - f.x1) <= 1 AND abs(c.y1 - f.y1) <= 1 GROUP BY c.cell_id""")
def cell_fills(read):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    c = read("part").select(k.alias("cell_id"), (k % 31 * 20.0).alias("x0"), (k % 17 * 10.0).alias("y0"), (k % 31 * 20.0 + 20).alias("x1"), (k % 17 * 10.0 + 10).alias("y1"))
    f = read("supplier").select(s.alias("position"), F.concat(F.lit("c"), s.cast("string")).alias("color"), (s % 31 * 20.0 + 0.75).alias("x0"), (s % 17 * 10.0 - 0.5).alias("y0"), (s % 31 * 20.0 + 20).alias("x1"), (s % 17 * 10.0 + 10).alias("y1"))
    return pagesets.fill_under(c, f)


@query("SELECT l_orderkey, CAST(v AS INT) AS dominant FROM (SELECT l_orderkey, l_suppkey % 5 AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY sum(l_quantity) DESC, min(l_linenumber), l_suppkey % 5 DESC) AS r FROM lineitem GROUP BY l_orderkey, l_suppkey % 5) WHERE r = 1")
def dominant_size(read):
    rows = read("lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).cast("int").alias("v"), "l_quantity", "l_linenumber")
    return pagesets.dominant(rows, "l_orderkey", "v", "l_quantity", "l_linenumber")


@query("""SELECT p_partkey AS field, CASE WHEN p_partkey % 4 = 0 THEN 'ok' WHEN p_size < 10 THEN 'rejected' WHEN p_partkey % 4 = 1 THEN 'unrecognised' ELSE 'ok' END AS status FROM part""")
def rule_evaluation(read):
    p = read("part")
    rules = p.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("field"), F.lit(1).alias("position"), F.lit("least").alias("rule"))
    rules = rules.union(p.filter("p_partkey % 4 = 1").select("p_partkey", F.lit(2), F.lit("script")))
    return pagesets.evaluate_rules(p.select(F.col("p_partkey").alias("field"), F.col("p_size").cast("string").alias("value")), rules, {"least": numbers.range_validate(F.col("value"), 10)})


from textloom.plans import markup, scalars, sequential, structures, typeset  # noqa: E402  more queries

for part in (sequential, structures, scalars, markup, typeset):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
