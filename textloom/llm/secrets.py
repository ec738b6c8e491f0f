"""Secret scans on DataFrame functions alone.

Fixed patterns give base spans. Two character Markov models, of random strings
and of ordinary identifiers, then score every long token by the ratio of its
log-likelihoods; tokens that look far more like random strings add ``markov``
spans where no base span lies. The models are counted by ``groupBy`` over
labelled samples; a table of 68 x 68 log ratios is all that remains.

Offsets: the text is split at the matches, and running sums over the lengths of
gaps and matches give each match's place in code points.

Cases: a null or empty text has no spans (the hash is that of an empty string); a
very long text is one row of matches, whose places are running sums; equal rows
are each returned; spans that begin at one place are listed by kind; without
samples of either kind no token looks random; null ids are allowed; an empty table
gives an empty result; columns of any other name are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import row_key

#: Kinds in the order in which equal starts are listed; pattern, shortest value, group of the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1
#: A token counts as random from this log-likelihood ratio (natural log) for each letter.
THRESHOLD = 1.5

_NOUNS = "access account action array batch block buffer cache channel class client cluster column config count cursor data date default device document element engine entry error event field file filter format frame group handler header index input instance integer item key label length level library line list loader lock log manager map master memory message method model module name node number object offset option order output package page parameter parser partition path pattern point process product profile query queue range reader record reference region request resource response result row schema script section sequence server service session shard signal size source stage state status stream string struct system table target task template text thread time token type update user value vector version view window worker writer the and for with under over between without international responsibility understanding".split()


def labelled_samples(spark: SparkSession, n: int = 20000) -> DataFrame:
    """Built-in labelled samples (value, random): ``n`` of each kind, the same in every run.

    Random: base64, hex and upper-case encodings of hash bytes. Ordinary: two to
    four nouns in snake, kebab, path, camel, joined or upper case, some numbered.
    """
    r = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512))
    raw = F.unhex("h")
    code = F.regexp_replace(F.base64(raw), r"\s", "")
    value = (
        F.when(F.col("id") % 4 == 0, F.substring(F.translate(code, "+/", "-_"), 3, 40))
        .when(F.col("id") % 4 == 1, F.substring(F.regexp_replace(code, "[+/=]", ""), 5, 32))
        .when(F.col("id") % 4 == 2, F.substring("h", 1, 40))
        .otherwise(F.substring(code, 1, 44))
    )
    words = F.array(*[F.lit(w) for w in _NOUNS])
    pick = [F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(_NOUNS))) + 1).cast("int")) for i in range(4)]
    case = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(7))
    some = F.slice(F.array(*pick), 1, (F.pmod(F.xxhash64("id", F.lit(8)), F.lit(3)) + 2).cast("int"))
    ordinary = (
        F.when(case == 0, F.array_join(some, "_"))
        .when(case == 1, F.array_join(some, "-"))
        .when(case == 2, F.array_join(some, "/"))
        .when(case == 3, F.array_join(F.transform(some, F.initcap), ""))
        .when(case == 4, F.upper(F.array_join(some, "_")))
        .when(case == 5, F.concat(F.array_join(some, "_"), F.lit("_"), F.pmod(F.col("id"), F.lit(2040)).cast("string")))
        .otherwise(F.array_join(some, ""))
    )
    return r.select(value.alias("value"), F.lit(1).alias("random")).union(r.select(ordinary.alias("value"), F.lit(0).alias("random")))


def _codes(value: Column) -> Column:
    """Letters as places in ALPHABET, from 1; others 0."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) * (c != "").cast("int"))


def fit_markov(samples: DataFrame) -> list[float]:
    """SIDE x SIDE log ratios of transition probabilities, random over ordinary (add-half smoothing).

    ``samples``: value, random (0/1). State 0 stands before the first letter and
    for letters outside the alphabet. Rows with nulls are left out.
    """
    codes = samples.dropna(subset=["value", "random"]).filter(F.length("value") > 0).select("random", F.concat(F.array(F.lit(0)), _codes(F.col("value"))).alias("c"))
    steps = codes.select("random", F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> c[i - 1] * %d + c[i])" % SIDE)).alias("s"))
    counts = {(r["random"], r["s"]): r["n"] for r in steps.groupBy("random", "s").agg(F.count("*").alias("n")).collect()}  # at most 2 x SIDE x SIDE rows
    out = []
    for a in range(SIDE):
        total = [sum(counts.get((k, a * SIDE + b), 0) for b in range(SIDE)) + 0.5 * SIDE for k in (0, 1)]
        out += [math.log((counts.get((1, a * SIDE + b), 0) + 0.5) / total[1]) - math.log((counts.get((0, a * SIDE + b), 0) + 0.5) / total[0]) for b in range(SIDE)]
    return out


#: kind, pattern, group of the value, shortest value.
PATTERNS = [("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("markov", CANDIDATE, 0, 16)]


def _matches(base: DataFrame) -> DataFrame:
    """One row a match of any kind: k1, k2, kind, start, end, value. One scan of the texts and one shuffle, of what was found."""
    t = F.col("t")
    per_kind = [
        F.when(
            t.rlike(pattern),
            F.struct(
                F.lit(kind).alias("kind"), F.lit(least).alias("least"),
                F.transform(F.split(t, pattern), F.char_length).alias("gaps"),
                F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"),
                F.regexp_extract_all(t, F.lit(pattern), F.lit(group)).alias("v"),
            ),
        )
        for kind, pattern, group, least in PATTERNS
    ]
    found = base.select("k1", "k2", F.array_compact(F.array(*per_kind)).alias("f")).filter(F.size("f") > 0)
    # equal rows give equal matches: each once
    found = found.groupBy("k1", "k2").agg(F.first("f").alias("f")).select("k1", "k2", F.explode("f").alias("f"))
    rows = found.select("k1", "k2", "f.kind", "f.least", F.posexplode(F.expr("transform(f.m, (x, i) -> struct(f.gaps[i] AS gap, char_length(x) AS n, f.v[i] AS value))")).alias("i", "x"))
    upto = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("x.gap") + F.col("x.n")).over(upto))
    rows = rows.select("k1", "k2", "kind", (F.col("end") - F.col("x.n")).alias("start"), "end", F.col("x.value").alias("value"), "least")
    return rows.filter(F.char_length("value") >= F.col("least")).drop("least")


def random_looking(value: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    """Whether the log-likelihood ratio of ``value`` reaches ``threshold`` for each letter."""
    codes = F.concat(F.array(F.lit(0)), _codes(value))
    # a literal array: folded once, not built for each row
    table = "array(" + ", ".join(f"{x:.6f}D" for x in ratios) + ")"
    steps = F.zip_with(codes, F.slice(codes, 2, F.char_length(value)), lambda a, b: a * SIDE + b)
    score = F.aggregate(F.filter(steps, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + F.element_at(F.expr(table), x + 1))
    return score >= threshold * F.char_length(value)


def secret_spans(base: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """All spans of ``base`` (k1, k2, t): k1, k2, kind, start, end (code points, end exclusive), value."""
    both = _matches(base).withColumn("fixed", F.col("kind") != "markov")
    both = both.filter(F.when(F.col("fixed"), True).otherwise(random_looking(F.col("value"), ratios, threshold)))
    # a markov span stays where no base span overlaps it: none that began earlier reaches into it, none begins inside
    w = Window.partitionBy("k1", "k2").orderBy("start")
    reach = F.max(F.when(F.col("fixed"), F.col("end"))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("fixed"), F.col("start"))).over(w.rangeBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"reach": reach, "ahead": ahead})
    clear = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    return both.filter(F.col("fixed") | clear).select("k1", "k2", "kind", "start", "end", "value")


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), t.alias("t"), *row_key(F.col(id_col), t))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, counts of base kinds, n_markov, base_sha256, spans (string), span_list (array of structs)."""
    ratios = fit_markov(samples if samples is not None else labelled_samples(docs.sparkSession))
    base = _base(docs, id_col, text_col)
    spans = secret_spans(base.drop("doc_id"), ratios, threshold)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    per = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "end", "kind"))).alias("s"))
    out = base.select("doc_id", "k1", "k2").join(per, ["k1", "k2"], "left").withColumn("s", F.coalesce("s", F.expr("array()").cast(per.schema["s"].dataType)))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(said(F.filter("s", lambda x: x["kind"] != "markov")), 256).alias("base_sha256"), said(F.col("s")).alias("spans"),
        count("markov").alias("n_markov"), F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("span_list"),
    )
