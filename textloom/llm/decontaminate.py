"""Benchmark decontamination with a broadcast set of test n-gram hashes.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Every
item's windows of ``window`` words (a shorter item: all its words) go into a
sorted hash array that is broadcast with the items' words in one byte buffer. Each
task rolls the same hash over its documents' words, looks the windows up, and
compares the words themselves at each hit, so a hash collision never counts.

The benchmark's bytes are summed first. Items beyond ``BLOCK_BYTES`` are taken in
blocks of about that size (one item at least), one after the other: each pass over
the texts writes its hits, and only the last one meets the documents. The index of
a block takes 16 bytes a window and 4 a word beside the words, so 11 times the
block's bytes at most; no other index exists at the time.

Cases: null or empty texts have no words and no hits; a very long text is read in
pieces; a null or wordless item is never found; equal items under several ids are
all reported; an item id that occurs twice counts once (its texts are windows of
one item); items with a null id are found too, as one item without a name in
``items_sha256``; rows of equal content are each reported; empty tables are fine;
columns of any name pass through ``decontaminate`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_bytes, byte_slices, discard, materialize, release, row_key, windows, words

BLOCK_BYTES = 8 << 20

WORD_LUT = np.arange(256, dtype=np.uint8)
WORD_LUT[0x41:0x5B] += 32
WORD_LUT[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0

HIT = "struct<n_words: bigint, starts: array<bigint>, ends: array<bigint>, items: array<string>>"


class WindowIndex:
    """Sorted window hashes of benchmark items, with the words to verify a hit."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.names = [name for name, _ in items]
        texts = [(text or "").encode() for _, text in items]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        s, e, item, h = words(data, off, WORD_LUT)
        # the words, one space after each
        size = e - s
        self.begin = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int32)
        buf = np.full(int(self.begin[-1]), 0x20, np.uint8)
        for i, j in byte_slices(np.concatenate([[0], np.cumsum(size)])):
            own = np.arange(size[i:j].sum()) - np.repeat(np.cumsum(size[i:j]) - size[i:j], size[i:j])
            buf[own + np.repeat(self.begin[i:j], size[i:j])] = WORD_LUT[data[own + np.repeat(s[i:j], size[i:j])]]
        self.words = buf.tobytes()
        #: by number of words: hashes in order, first word and item of each, whether each equals the one before
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        k_of = np.minimum(np.bincount(item, minlength=len(items)), window)
        for k in np.unique(k_of[k_of > 0]).tolist():
            w = windows(h, k)
            first = np.flatnonzero((item[: len(w)] == item[k - 1 :]) & (k_of[item[: len(w)]] == k))
            first = first[np.argsort(w[first], kind="stable")]
            keys = w[first]
            same = np.zeros(len(keys), bool)
            for i in np.flatnonzero(keys[1:] == keys[:-1]).tolist():
                same[i + 1] = self.at(first[i], k) == self.at(first[i + 1], k)
            seen = np.zeros(1 << 16, bool)
            seen[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.by_size[k] = keys, first.astype(np.int32), item[first].astype(np.int32), same, seen

    def at(self, first: int, k: int) -> bytes:
        """The ``k`` words from word ``first`` on."""
        return self.words[self.begin[first] : self.begin[first + k] - 1]

    def found(self, k: int, lo: int, hi: int, said: bytes) -> np.ndarray:
        """Items of the windows ``lo`` to ``hi`` of one hash that are the words ``said``."""
        _, first, item, same, _ = self.by_size[k]
        if same[lo + 1 : hi].all():
            return item[lo:hi] if self.at(first[lo], k) == said else item[:0]
        return item[[i for i in range(lo, hi) if self.at(first[i], k) == said]]

    def hits(self, data: np.ndarray, off: np.ndarray):
        """For each text: number of words, hit ranges (word numbers, end exclusive), item numbers."""
        n = len(off) - 1
        s, e, doc, h = words(data, off, WORD_LUT)
        count = np.bincount(doc, minlength=n)
        base = np.concatenate([[0], np.cumsum(count)])
        ranges: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        names: list[dict[tuple[int, int], np.ndarray]] = [{} for _ in range(n)]
        for k, (keys, _, _, _, seen) in self.by_size.items():
            w = windows(h, k)
            if not len(w):
                continue
            at = np.flatnonzero(seen[(w >> np.uint64(48)).astype(np.int64)])
            at = at[doc[at] == doc[at + k - 1]]
            lo = np.searchsorted(keys, w[at])
            hi = np.searchsorted(keys, w[at], side="right")
            hit = lo < hi
            for i, a, b in zip(at[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True):
                got = self.found(k, a, b, b" ".join(WORD_LUT[data[s[j] : e[j]]].tobytes() for j in range(i, i + k)))
                if len(got):
                    d = int(doc[i])
                    ranges[d].append((i - int(base[d]), i - int(base[d]) + k))
                    names[d][k, a] = got
        return count.tolist(), ranges, [np.unique(np.concatenate(list(x.values()))).tolist() if x else [] for x in names]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges, sorted; touching ranges are joined."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``ranges``, and without what stands between the words of one range."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, _, _ = words(data, np.array([0, len(data)]), WORD_LUT)
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at : s[a]])
        at = int(e[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def find(share, text: Column, before: tuple[Column, Column, Column]) -> Column:
    """HIT of ``text`` by a broadcast index; ``before``: starts, ends and items that other blocks have found."""

    def scan(texts: pa.Array, starts: pa.Array, ends: pa.Array, items: pa.Array) -> pa.Array:
        index = share.value
        data, off = arrow_bytes(texts)
        had = [zip(a, b, strict=True) for a, b in zip(starts.to_pylist(), ends.to_pylist(), strict=True)]
        said = items.to_pylist()
        count, out = [], []
        for i, j in byte_slices(off):
            c, r, x = index.hits(data[off[i] : off[j]], off[i : j + 1] - off[i])
            count += c
            out += [(merge([*new, *old]), sorted({*(index.names[t] for t in own), *known}, key=lambda s: (s is None, s or ""))) for new, old, own, known in zip(r, had[i:j], x, said[i:j], strict=True)]
        release()
        lists = lambda rows, kind: pa.array(rows, pa.list_(kind))
        return pa.StructArray.from_arrays(
            [pa.array(count, pa.int64()), lists([[a for a, _ in r] for r, _ in out], pa.int64()), lists([[b for _, b in r] for r, _ in out], pa.int64()), lists([x for _, x in out], pa.string())],
            names=["n_words", "starts", "ends", "items"],
        )

    # not deterministic, as far as the optimizer may know: a filter on the result must not bring a second scan
    return F.arrow_udf(scan, HIT).asNondeterministic()(text, *before)


def without(text: Column, hit: Column) -> Column:
    """``text`` without its hit words."""

    def cut_all(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)
        return pa.array([t if not a else cut(t, list(zip(a, b, strict=True))) for t, a, b in rows], pa.string())

    return F.arrow_udf(cut_all, "string")(text, hit["starts"], hit["ends"])


def blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items of the benchmark as lists of (id, text), each list of about ``block_bytes`` at most; one list at least."""
    b = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna(subset=["text"])
    total = b.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        yield [(r["item"], r["text"]) for r in b.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()]


def scan(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``src`` (a row of ``docs``) and ``hit`` (HIT: words, hit word ranges, ids of the items found)."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    none = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<string>)")
    src = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("src")
    found, last = [], None
    for items in blocks(bench, item_col, item_text_col, block_bytes):
        if last is not None:  # a block before the last: its hits are written
            found.append(materialize(_hits(docs, text, last, none), "hits"))
            last.unpersist()
        last = spark.sparkContext.broadcast(WindowIndex(items, window))
    if not found:
        return docs.select(src, find(last, text, none).alias("hit"))
    hits = found[0]
    for x in found[1:]:
        hits = hits.union(x)
    all_ = lambda c: F.flatten(F.collect_list(f"hit.{c}")).alias(c)
    hits = materialize(hits.groupBy("k1", "k2").agg(all_("starts"), all_("ends"), all_("items")), "hits")
    discard(*found)
    rows = docs.select(src, text.alias("text"), *row_key(text)).join(hits, ["k1", "k2"], "left")
    before = tuple(F.coalesce(c, x) for c, x in zip(("starts", "ends", "items"), none, strict=True))
    return rows.select("src", find(last, F.col("text"), before).alias("hit"))


def _hits(docs: DataFrame, text: Column, share, none: tuple) -> DataFrame:
    """k1, k2 (of the text), hit: of the texts with hits, each once."""
    rows = docs.select(*row_key(text), find(share, text, none).alias("hit"))
    return rows.filter(F.size("hit.starts") > 0).dropDuplicates(["k1", "k2"])


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without its hit documents, or (``remove="spans"``) with hit words cut out of texts."""
    out = scan(docs, bench, text_col, **kw)
    if remove == "documents":
        return out.filter(F.size("hit.starts") == 0).select("src.*")
    new = without(F.col(f"src.`{text_col}`"), F.col("hit"))
    return out.select(*[new.alias(c) if c == text_col else F.col(f"src.`{c}`") for c in docs.columns])


def contamination_report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), bench, "text", **kw)
    n_hit = F.aggregate(F.zip_with("hit.starts", "hit.ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(
        "src.doc_id", "hit.n_words", n_hit.alias("n_hit"), F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit.items"), ","), 256).alias("items_sha256"), (F.size("hit.starts") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, list_aggregate(w[i : i + least(10, len(w)) - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k
), hits AS (
  SELECT p.doc_id, p.i, p.k, g.item_id FROM (SELECT doc_id, i, k, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') AS g FROM places) p JOIN grams g ON p.k = g.k AND p.g = g.g
), hit_words AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM low l LEFT JOIN hit_words h ON l.doc_id = h.doc_id LEFT JOIN found f ON l.doc_id = f.doc_id
"""
