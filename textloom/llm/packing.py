"""Best-fit packing by exact-complement hashing.

Documents become token ids and an end token; a document longer than a sequence
is cut so that only its first piece may be shorter. Packing looks at lengths
alone: how many pieces there are of each length is a table of at most
``capacity`` rows, whatever the size of the corpus. Over it the driver makes a
plan. The gap that a length leaves is looked up in an index of single lengths, of
sums of two and of sums of three; combinations that fill the gap exactly are
consumed as often as their availability counts allow. Singles come first, for all
lengths; then pairs, then triples, from the lengths with the largest gaps on, as
those are the hardest to fill, and of the combinations for a gap the most even one
first, which spares short pieces. The shortest pieces, ``RESERVE`` of all tokens,
take no part in pairs and triples: they level what is left, which is packed best
fit, largest first. Each step of the plan uses up a length, so the plan is short
too.

A piece's rank among those of its length says which place of the plan it takes.
Ranks are found per length and bucket, so a length that a third of all pieces
share is spread over many tasks.

Cases: a null or empty text is the end token alone; equal rows are packed each;
null ids are allowed; a special string inside a text is its token, as the
tokenizer's default has it; a text of any length is encoded, runs of more than
``LONG_RUN`` spaces by the tokenizers library itself; pieces of equal length are
ranked by id, number and checksum; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, tidy

BUCKETS = 128
#: Splits text into the units inside which bytes are merged (fixed, as the vocabulary was made with it).
UNITS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Share of the tokens that short pieces keep back for what no combination fills.
RESERVE = 0.06
#: The faster coder's pattern recurses over a run of white space; longer ones than this go to the library.
LONG_RUN = 1 << 16
_SPACES = re.compile(r"\s{%d}" % LONG_RUN)

_KEPT: dict = {}


def encoder(path: str):
    """text -> ids for a byte-level BPE tokenizer file, as the tokenizers library gives them.

    The file's vocabulary is in order of merging, so it serves as ranks for a
    faster coder of the same kind; special strings are found as by default.
    """
    if path not in _KEPT:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the printable stand-ins of bytes in such files
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(stand[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        coder = tiktoken.Encoding("file", pat_str=UNITS, mergeable_ranks=ranks, special_tokens=special)
        names = frozenset(special)

        @cache
        def library():
            """The library's tokenizer; made only where a text needs it, as every worker would keep it."""
            import tokenizers

            return tokenizers.Tokenizer.from_file(path)

        def encode(text: str) -> list[int]:
            if len(text) > LONG_RUN and _SPACES.search(text):
                return library().encode(text, add_special_tokens=False).ids
            if any(x in text for x in names):
                return coder.encode(text, allowed_special=names, disallowed_special=())
            return coder._core_bpe.encode_ordinary(text)

        _KEPT[path] = encode
    return _KEPT[path]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        import pyarrow as pa

        encode = encoder(path)
        for batch in batches:
            src, num, start, size, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                n = len(ids)
                cuts = [0, *range(n - (n - 1) // capacity * capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    src.append(row)
                    num.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            ids_of = batch.column(0).take(pa.array(src, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(num, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return tidy(run)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many such sequences), using every piece once."""
    n = np.zeros(capacity + 1, np.int64)
    for length, k in counts.items():
        n[length] = k
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*parts: int) -> None:
        """Consume a combination as often as its lengths allow."""
        k = int(min(n[x] // parts.count(x) for x in parts))
        if k > 0:
            for x in parts:
                n[x] -= k
            out.append((parts, k))

    weight = np.cumsum(n * np.arange(capacity + 1))
    # lengths below this are kept back
    least = int(np.searchsorted(weight, RESERVE * weight[-1])) if weight[-1] else 1
    take(capacity)
    for size in range(capacity - 1, (capacity - 1) // 2, -1):
        take(size, capacity - size)
    for size in np.flatnonzero(n).tolist():
        gap = capacity - size
        a = np.arange((gap + 1) // 2, min(gap - least, size) + 1)
        for x in a[(n[a] > 0) & (n[gap - a] > 0)].tolist():
            if not n[size]:
                break
            take(size, x, gap - x)
    for size in np.flatnonzero(n).tolist():
        gap = capacity - size
        # the largest of the three from a third of the gap on
        for x in range(-(-gap // 3), min(gap - 2 * least, size) + 1):
            if not n[size]:
                break
            if not n[x]:
                continue
            rest = gap - x
            b = np.arange((rest + 1) // 2, min(rest - least, x) + 1)
            for y in b[(n[b] > 0) & (n[rest - b] > 0)].tolist():
                take(size, x, y, rest - y)
    n = n.tolist()
    # best fit, largest first, on what no combination fills: bins of equal make-up are kept together
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    gaps: list[int] = []
    for size in range(capacity, 0, -1):
        left = n[size]
        while left:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                fits = capacity // size
                whole, part = divmod(left, fits)
                made = [((size,) * fits, whole)] * (whole > 0) + [((size,) * part, 1)] * (part > 0)
                left = 0
            else:
                gap = gaps[i]
                kinds = open_[gap]
                parts, k = next(iter(kinds.items()))
                fits = gap // size
                whole = min(k, left // fits)
                made = [(parts + (size,) * fits, whole)] if whole else [(parts + (size,) * left, 1)]
                used = whole or 1
                left -= whole * fits or left
                kinds[parts] -= used
                if not kinds[parts]:
                    del kinds[parts]
                if not kinds:
                    del open_[gap]
                    gaps.pop(i)
            for parts, k in made:
                gap = capacity - sum(parts)
                if gap not in open_:
                    open_[gap] = {}
                    gaps.insert(bisect_left(gaps, gap), gap)
                open_[gap][parts] = open_[gap].get(parts, 0) + k
        n[size] = 0
    out += [(parts, k) for kinds in open_.values() for parts, k in kinds.items()]
    return out


def places(steps: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which places begin, their first sequence, their offset."""
    at: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for parts, k in steps:
        offset = 0
        for x in parts:
            at.setdefault(x, []).append((used.get(x, 0), first, offset))
            used[x] = used.get(x, 0) + k
            offset += x
        first += k
    return {x: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for x, v in at.items()}


def _place(share):
    def run(batches):
        import pyarrow as pa

        table = share.value
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for x in np.unique(size).tolist():
                mine = np.flatnonzero(size == x)
                begin, first, offset = table[x]
                i = np.searchsorted(begin, rank[mine], side="right") - 1
                seq[mine] = first[i] + rank[mine] - begin[i]
                off[mine] = offset[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    cut = materialize(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), schema), "pieces")
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(BUCKETS)).cast("int"))
    cut = materialize(cut.repartition("length", "bucket"), "dealt")
    held = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect()  # at most capacity x BUCKETS rows
    counts: dict[int, int] = {}
    base = []
    for r in sorted(held, key=lambda r: (r["length"], r["bucket"])):
        base.append((r["length"], r["bucket"], counts.get(r["length"], 0)))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    share = spark.sparkContext.broadcast(places(plan(counts, capacity), capacity))
    base_rows = spark.createDataFrame(base, "length long, bucket int, base long")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("r", rank).join(F.broadcast(base_rows), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_place(share), schema + ", sequence_id long, offset long")
