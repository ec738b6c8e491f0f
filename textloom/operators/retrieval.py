"""Ranked retrieval: Okapi BM25 and the selection of passages under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import tokenize

K1, B = 1.2, 0.75


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its score: id, score.

    A document gives one row for each place of a query term (one without a place if
    there is none), which are counted map-side; no other term leaves it. Document
    frequencies and the mean length are sums over those counts, one row, so texts
    are tokenised once for both.
    """
    q = docs.sparkSession.range(1).select(F.array_distinct(tokenize(F.lit(query))).alias("q")).first()["q"]
    held = docs.select(F.col(id_col), tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).select(id_col, F.size("t").alias("len"), F.filter("t", lambda w: w.isin(q)).alias("hits"))
    tf = held.select(id_col, "len", F.explode_outer("hits").alias("w")).groupBy(id_col, "len").agg(*[F.count_if(F.col("w") == w).alias(f"f{i}") for i, w in enumerate(q)])
    sums = tf.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.sum("len") / F.count("*"), F.lit(0.0)), F.lit(1e-9)).alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(q))])
    rows = tf.crossJoin(F.broadcast(sums))  # one row
    score = F.lit(0.0)
    for i in range(len(q)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        f = F.col(f"f{i}").cast("double")
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))).otherwise(0.0)
    return rows.select(id_col, score.alias("score"))


def rank(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The ``k`` best, ties by id, with their rank."""
    top = scored.orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def select_under_budget(scored: DataFrame, budget: int, most: int = 8, id_col: str = "doc_id", size_col: str = "size") -> DataFrame:
    """The passages to send: by rank, as long as their sizes fit together, ``most`` at most.

    Passages that score nothing are left out, unless none scores: then passages
    come in order of id. The first that overflows ends the choice.
    """
    some = scored.orderBy(F.desc("score"), id_col).limit(most)  # scores aren't negative: those of nothing come last, by id
    every = Window.orderBy(F.desc("score"), id_col)  # over ``most`` rows
    some = some.withColumn("best", F.first("score").over(every)).filter("score > 0 OR best = 0").drop("best")
    return some.withColumn("rank", F.row_number().over(every)).withColumn("used", F.sum(size_col).over(every)).filter(F.col("used") <= budget)
