"""Line dedup on DataFrame functions alone.

Lines are hashed, dealt out by ranges of the hash and sorted by key, document
and position inside each range. A streaming pass over that order finds the
first occurrence of a key in each document and so counts documents per key; no
text travels. Keys that turn up in ``min_docs`` documents give per-document
drop positions, which fold into a run-length keep bitmap per document. Only
then does a document's text meet its bitmap.

The ranges of a 64-bit hash are known beforehand (its high bits), so no sampling
pass is needed to place their bounds. A heavy-hitter sketch names keys of very
many lines; those are salted by document, so that no task gets a whole hot key.
The sketch decides only where rows go, never what is counted.

Cases: a null text counts as empty; an empty text is one empty line; an empty
key (shorter than ``min_chars``) is never dropped; rows equal in id and text are
one document, and each of them is returned; a null id is an id like any other;
an empty table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import ASCII_SPACE, ascii_lower, materialize, row_key

#: Documents whose lines feed the sketch: one in so many. Only placement depends on it.
SKETCH_ONE_IN = 16
#: A key with this share of the sketched lines is salted; so at most its inverse keys are.
HOT_SHARE = 1 / 1000
SALTS = 64


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(base: DataFrame, min_chars: int) -> DataFrame:
    """One row a line: document key, position, 96-bit hash of the line's key."""
    out = base.select("k1", "k2", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    out = out.select("k1", "k2", "pos", line_key(F.col("line")).alias("key"))
    return out.filter(F.char_length("key") >= max(1, min_chars)).select("k1", "k2", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("src"), t.alias("t"), *row_key(F.col(id_col), t))


def _hot(base: DataFrame, min_chars: int) -> list[int]:
    """Hashes of keys with at least HOT_SHARE of the sketched lines."""
    part = _lines(base.filter(F.pmod("k1", F.lit(SKETCH_ONE_IN)) == 0), min_chars)
    top, n = part.agg(F.expr("approx_top_k(h1, 1000, 10000)"), F.count("*")).first()
    return sorted(x["item"] for x in top or [] if x["count"] >= max(16, n * HOT_SHARE))


def keep_bitmaps(base: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """Run-length keep bitmaps of the documents that lose lines.

    ``base``: k1, k2, t. Returns k1, k2, ``starts`` and ``ends`` (array<int>:
    the runs of dropped lines, end exclusive) and n_dropped.
    """
    hot = _hot(base, min_chars)
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    lines = _lines(base, min_chars).withColumns({
        "hot": is_hot,
        "range": F.shiftrightunsigned("h1", 50),
        "salt": F.when(is_hot, F.pmod("k1", F.lit(SALTS))).otherwise(F.lit(0)),
    })
    by = ["range", "salt", "h1", "h2"]
    order = Window.partitionBy(*by).orderBy("k1", "k2", "pos")
    first = F.lag("k1").over(order).isNull() | (F.lag("k1").over(order) != F.col("k1")) | (F.lag("k2").over(order) != F.col("k2"))
    seen = lines.repartition("range", "salt").withColumn("first", first.cast("int"))
    seen = seen.withColumn("n", F.sum("first").over(Window.partitionBy(*by))).filter(F.col("hot") | (F.col("n") >= min_docs))
    seen = materialize(seen.select("k1", "k2", "pos", "h1", "h2", "hot", "first"), "lines")
    # at most 1 / HOT_SHARE keys are hot, so this side has a bound
    full = seen.filter("hot").groupBy("h1", "h2").agg(F.sum("first").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    dropped = seen.filter(~F.col("hot")).select("k1", "k2", "pos")
    if hot:
        dropped = dropped.union(seen.filter("hot").join(F.broadcast(full), ["h1", "h2"], "left_semi").select("k1", "k2", "pos"))
    runs = dropped.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("d"))
    return runs.select(
        "k1", "k2",
        F.expr("filter(d, (x, i) -> i = 0 OR d[i - 1] < x - 1)").alias("starts"),
        F.expr("transform(filter(d, (x, i) -> i = size(d) - 1 OR d[i + 1] > x + 1), x -> x + 1)").alias("ends"),
        F.size("d").cast("long").alias("n_dropped"),
    )


def _kept(base: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """src, n_lines, n_dropped, kept (text): a document meets its bitmap."""
    maps = keep_bitmaps(base.drop("src"), min_docs, min_chars)
    out = base.join(maps, ["k1", "k2"], "left").withColumn("a", F.split("t", "\n"))
    # kept runs lie between the dropped ones: [0, s0), [e0, s1), ..., [e_last, n)
    kept = F.expr("""array_join(flatten(transform(sequence(0, size(starts)), i ->
        slice(a, if(i = 0, 0, ends[i - 1]) + 1, if(i = size(starts), size(a), starts[i]) - if(i = 0, 0, ends[i - 1])))), '\n')""")
    return out.select("src", F.size("a").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.when(F.col("starts").isNull(), F.col("t")).otherwise(kept).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with its columns, its text without the lines whose key occurs in ``min_docs`` documents."""
    out = _kept(_base(docs, id_col, text_col), min_docs, min_chars)
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"src.`{c}`").alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: id, n_lines, n_dropped, kept_sha256 of the text that stays."""
    out = _kept(_base(docs.select(id_col, text_col), id_col, text_col), min_docs, min_chars)
    return out.select(F.col(f"src.`{id_col}`").alias(id_col), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, p.pos AS pos, p.line AS line, translate(trim(p.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'pos': i, 'line': x})) AS p FROM documents)
), often AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.doc_id, l.pos, l.line, o.key IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
