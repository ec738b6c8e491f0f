"""Blocks and differences as documents: Markdown, HTML, JSON; one text a document, made where its blocks meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import escape_markdown_inline, escape_markup


def _joined(blocks: DataFrame, piece: Column, by: str, mark: str) -> DataFrame:
    held = blocks.select(by, F.struct("ordinal", piece.alias("piece")).alias("s")).groupBy(by).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return held.select(by, F.array_join(F.transform("s", lambda x: x["piece"]), mark).alias("document"))


def to_markdown(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """``by``, document: blocks (ordinal, kind, level, text) as Markdown, a blank line between them.

    Kinds: heading (level 1 to 6), item (level: indentation), quote, code, rule;
    others are paragraphs.
    """
    t, kind = F.coalesce("text", F.lit("")), F.col("kind")
    safe = escape_markdown_inline(t)
    piece = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest("level", F.lit(1)), F.lit(6)).cast("int")), F.lit(" "), safe))
        .when(kind == "item", F.concat(F.repeat(F.lit(" "), F.coalesce("level", F.lit(0)).cast("int")), F.lit("- "), safe))
        .when(kind == "quote", F.concat(F.lit("> "), F.regexp_replace(safe, "\n", "\n> ")))
        .when(kind == "code", F.concat(F.lit("```\n"), t, F.lit("\n```")))
        .when(kind == "rule", "---")
        .otherwise(safe)
    )
    return _joined(blocks, piece, by, "\n\n")


def to_html(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """``by``, document: the same blocks as HTML."""
    safe, kind = escape_markup(F.coalesce("text", F.lit(""))), F.col("kind")
    level = F.least(F.greatest("level", F.lit(1)), F.lit(6)).cast("string")
    tag = F.when(kind == "heading", F.concat(F.lit("h"), level)).when(kind == "item", "li").when(kind == "quote", "blockquote").when(kind == "code", "pre").otherwise("p")
    piece = F.when(kind == "rule", "<hr>").otherwise(F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">")))
    return _joined(blocks, piece, by, "\n")


def save_documents(documents: DataFrame, path: str, by: str = "doc_id") -> None:
    """One folder a document below ``path``, its text inside."""
    documents.select(by, F.col("document").alias("value")).write.partitionBy(by).mode("overwrite").text(path)
