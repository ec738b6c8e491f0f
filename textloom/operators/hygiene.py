"""Corpus hygiene: exact copies, repeated lines, overlap with a benchmark, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import fold_digits, redact, tokenize
from textloom.scratch import materialize


def dedup_exact(docs: DataFrame, key: list[str], id_col: str = "doc_id", size: str = "text") -> DataFrame:
    """One row for each content key: the smallest payload, ties to the least id; with the number of rows it stands for.

    The key is a digest, so texts don't travel; sums are formed before the shuffle.
    """
    digest = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c), F.lit("\x01")) for c in key]), 256)
    rows = docs.select(digest.alias("digest"), F.struct(F.octet_length(F.coalesce(F.col(size), F.lit(""))).alias("size"), F.col(id_col).alias("id")).alias("s"))
    out = rows.groupBy("digest").agg(F.min("s").alias("s"), F.count("*").alias("copies"))
    return out.select(F.col("s.id").alias(id_col), "copies", "digest")


def dedup_to_fixpoint(objects: DataFrame, refs: DataFrame, passes: int = 8) -> DataFrame:
    """Objects merged by content, and again as their references become equal: id, keep.

    ``objects``: id, payload. ``refs``: src, pos, dst. At most ``passes`` passes; each
    is written, and the next begins with what was written.
    """
    place = objects.select("id", F.col("id").alias("keep"))
    for _ in range(passes):
        to = place.select(F.col("id").alias("dst"), F.col("keep").alias("target"))
        out = refs.join(to, "dst", "left").select("src", F.struct("pos", F.coalesce("target", "dst").alias("to")).alias("r"))
        sig = out.groupBy("src").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("refs"))
        rows = objects.join(sig, objects["id"] == sig["src"], "left").select("id", "payload", F.sha2(F.concat_ws("\x00", "payload", F.coalesce("refs", F.lit(""))), 256).alias("k"))
        least = rows.groupBy("k").agg(F.min(F.struct(F.length("payload").alias("n"), "id")).alias("s"))
        new = materialize(rows.join(least, "k").select("id", F.col("s.id").alias("keep")), "merged")
        changed = new.join(place.withColumnRenamed("keep", "was"), "id").filter("keep <> was")
        stop = changed.isEmpty()
        place = new
        if stop:
            break
    return place


def repeated_lines(docs: DataFrame, group: str, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines, digits folded, on at least ``least`` documents of a group: group, line, documents, occurrences.

    Counted in two steps (a document's copies first), both with sums before the shuffle.
    """
    lines = docs.select(group, id_col, F.explode(F.split(text_col, "\n")).alias("line")).select(group, id_col, fold_digits(F.col("line")).alias("line"))
    per = lines.filter(F.col("line") != "").groupBy(group, "line", id_col).agg(F.count("*").alias("n"))
    return per.groupBy(group, "line").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences")).filter(F.col("documents") >= least)


def benchmark_overlap(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per document the item that shares the largest part of its distinct terms: doc_id, item_id, shared, n_terms.

    Items are few: their terms are broadcast after a check of their number, else joined.
    """
    items = bench.select("item_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    n = items.groupBy("item_id").agg(F.count("*").alias("n_terms"))
    side = items.join(n, "item_id")
    side = F.broadcast(side) if side.count() <= 200_000 else side
    terms = docs.select("doc_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    hits = terms.join(side, "term").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.first("n_terms").alias("n_terms"))
    best = hits.groupBy("doc_id").agg(F.max(F.struct((F.col("shared") / F.col("n_terms")).alias("share"), (-F.col("item_id")).alias("i"), "shared", "n_terms")).alias("b"))
    return best.select("doc_id", (-F.col("b.i")).alias("item_id"), F.col("b.shared").alias("shared"), F.col("b.n_terms").alias("n_terms"))


def redact_table(df: DataFrame, term: str, text_col: str = "text", **how: bool) -> DataFrame:
    """``df`` with the term masked and the number of places (column n_redacted)."""
    text, n = redact(F.col(text_col), term, **how)
    return df.withColumns({text_col: text, "n_redacted": n.cast("long")})
