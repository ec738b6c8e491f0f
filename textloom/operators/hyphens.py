"""Break places of words by patterns: pieces of distinct words joined with the pattern table, the greatest level at each gap.

A pattern is letters with digits between them (``.`` stands for a word's edge): where
its letters occur, each gap gets at least that digit. A break may stand where the
greatest digit is odd. Only distinct words are looked at, each cut into its pieces of
the patterns' lengths; the join is on the piece, so a word that a third of all texts
hold costs what a rare one does, and Spark decides whether the patterns are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compiled(patterns: DataFrame) -> DataFrame:
    """letters, levels (one a gap) of ``patterns`` (pattern); nulls, blanks and repeated rows are left out."""
    p = patterns.select(F.lower(F.trim("pattern")).alias("p")).filter("p <> ''").distinct()
    digits = F.regexp_extract_all("p", F.lit(r"([0-9]?)([^0-9]|$)"), 1)
    letters = F.regexp_replace("p", "[0-9]", "")
    levels = F.transform(F.slice(digits, 1, F.length(letters) + 1), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    return p.select(letters.alias("letters"), levels.alias("levels")).filter("letters <> ''")


def break_places(words: DataFrame, patterns: DataFrame, exceptions: DataFrame | None = None, left: int = 2, right: int = 3) -> DataFrame:
    """word, breaks (numbers of letters before each break): one row a distinct word, in lower case.

    ``left`` and ``right``: the fewest letters before the first break and after the
    last. ``exceptions``: word with hyphens where it breaks; these hold instead of
    patterns, at any distance from the edges (of several, the first in order).
    A null word is left out, an empty or short one has no breaks.
    """
    w = words.select(F.lower("word").alias("word")).filter("word IS NOT NULL").distinct()
    table = compiled(patterns)
    longest = table.agg(F.max(F.length("letters"))).first()[0] or 0
    dotted = F.concat(F.lit("."), "word", F.lit("."))
    starts = w.filter(F.length("word") >= left + right).select("word", F.explode(F.sequence(F.lit(1), F.length("word") + 2)).alias("at"))
    room = F.least(F.lit(longest), F.length("word") + 3 - F.col("at"))
    pieces = starts.filter(room >= 1).select("word", "at", F.explode(F.sequence(F.lit(1), room)).alias("size"))
    pieces = pieces.select("word", "at", F.substring(dotted, F.col("at"), F.col("size")).alias("letters"))
    levels = pieces.join(table, "letters").select("word", "at", F.posexplode("levels").alias("gap", "level"))
    best = levels.groupBy("word", (F.col("at") - 2 + F.col("gap")).alias("place")).agg(F.max("level").alias("level"))
    odd = best.filter((F.col("level") % 2 == 1) & F.col("place").between(F.lit(left), F.length("word") - right))
    found = odd.groupBy("word").agg(F.array_sort(F.collect_list("place")).alias("breaks"))
    out = w.join(found, "word", "left")
    none = F.expr("cast(array() as array<int>)")
    if exceptions is None:
        return out.select("word", F.coalesce("breaks", none).alias("breaks"))
    parts = F.col("parts")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.length(F.array_join(F.slice(parts, F.lit(1), k), "")))
    given = exceptions.filter("word IS NOT NULL").select(F.split(F.lower("word"), "-").alias("parts")).select(F.array_join(parts, "").alias("word"), F.slice(ends, F.lit(1), F.size(parts) - 1).alias("given"))
    given = given.groupBy("word").agg(F.min("given").alias("given"))
    return out.join(given, "word", "left").select("word", F.coalesce("given", "breaks", none).alias("breaks"))


def hyphenated(word: Column, breaks: Column, mark: str = "-") -> Column:
    """The word with a mark at each break."""
    before = lambda k: F.coalesce(F.get(breaks, k - 1), F.lit(0))
    part = lambda k: F.substring(word, before(k) + 1, F.coalesce(F.get(breaks, k), F.length(word)) - before(k))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(breaks)), part), mark)
