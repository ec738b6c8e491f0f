"""Character maps as interval tables: strings of codes to text.

A map's ranges are never written out code by code. A range becomes the aligned blocks
of two to the k codes that it is made of (two a level at most), a code asks for the
blocks it lies in, of the levels that its map has; so the look-up is a join on equal
keys however wide ranges are and however they overlap. Of all ranges over a code the
one written last holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.scratch import materialize

#: Codes have four bytes at most.
LEVELS = 32
#: Code length of a map without code spaces (fixed value).
WIDTH = 2
LAST_CHARACTER = 0x10FFFF
#: Looked-up codes of no more bytes than this are sent to every task.
KNOWN_BYTES = 64 << 20

_HEX = r"<([^<>]*)>"
_SECTION = r"(?s)begin(codespacerange|bfchar|bfrange)\b(.*?)(?=\b(?:begin|end)[a-z])"
_PAIR = rf"{_HEX}\s*{_HEX}"
_RANGE = rf"{_HEX}\s*{_HEX}\s*(?:{_HEX}|\[([^\]]*)\])"


def _digits(c: Column) -> Column:
    """Hex digits in capitals, an odd last one filled up with 0."""
    d = F.upper(F.regexp_replace(c, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(d) % 2 == 1, F.concat(d, F.lit("0"))).otherwise(d)


def _number(digits: Column) -> Column:
    return F.coalesce(F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long"), F.lit(0))


def utf16_text(digits: Column) -> Column:
    """The text of big-endian UTF-16 in hex digits; a last odd byte is a character, half a pair U+FFFD."""
    odd = F.length(digits) % 4 == 2
    even = F.when(odd, F.regexp_replace(digits, "(..)$", "00$1")).otherwise(digits)
    units = F.regexp_replace(even, "(.{4})", "$1 ")
    units = F.regexp_replace(units, r"D[89AB]..\ (?!D[C-F])", "FFFD ")
    units = F.regexp_replace(units, r"(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    return F.decode(F.unhex(F.replace(units, F.lit(" "), F.lit(""))), "UTF-16BE")


def character(code_point: Column) -> Column:
    """The character of a code point; a surrogate's is U+FFFD."""
    whole = F.when(code_point.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(code_point)
    return F.decode(F.unhex(F.lpad(F.hex(whole.cast("long")), 8, "0")), "UTF-32")


def _sections(maps: DataFrame) -> DataFrame:
    clean = F.regexp_replace("body", r"%[^\r\n]*", "")
    parts = maps.select("map", F.posexplode(F.regexp_extract_all(F.concat(clean, F.lit(" endcmap")), F.lit(_SECTION), F.lit(0))).alias("section", "s"))
    return parts.select("map", "section", F.regexp_extract("s", "^begin([a-z]+)", 1).alias("kind"), "s")


def code_spaces(maps: DataFrame) -> DataFrame:
    """map, width, lo, hi (hex digits): code spaces as written; a map without any has one of two bytes.

    ``maps``: map, body (the map's text). A null body is an empty one. A space whose
    ends differ in length, or without digits, or of more than four bytes, is none.
    """
    pairs = _sections(maps).filter("kind = 'codespacerange'").select("map", F.explode(F.regexp_extract_all("s", F.lit(_PAIR), F.lit(0))).alias("p"))
    said = pairs.select("map", _digits(F.regexp_extract("p", _PAIR, 1)).alias("lo"), _digits(F.regexp_extract("p", _PAIR, 2)).alias("hi"))
    said = said.filter("length(lo) = length(hi) AND length(lo) BETWEEN 2 AND 8").select("map", (F.length("lo") / 2).cast("int").alias("width"), "lo", "hi")
    whole = maps.select("map").distinct().join(said.select("map").distinct(), "map", "left_anti")
    return said.unionByName(whole.select("map", F.lit(WIDTH).alias("width"), F.lit("00" * WIDTH).alias("lo"), F.lit("FF" * WIDTH).alias("hi")))


def ranges(maps: DataFrame) -> DataFrame:
    """map, width, place, lo, hi, text, base: what the maps say, later places before earlier ones.

    ``text``: of a single code. ``base``: the code point of ``lo``, and so on
    upward, never past the last character; of a longer destination only the first
    character counts. Where all of a map's code spaces are of one width, its codes
    are numbers of that width, however they are written; else a code has the
    length it is written in. An entry without an end, or whose range runs
    backwards, says nothing.
    """
    parts = _sections(maps)
    chars = parts.filter("kind = 'bfchar'").select("map", "section", F.posexplode(F.regexp_extract_all("s", F.lit(_PAIR), F.lit(0))).alias("entry", "e"))
    singles = chars.select("map", "section", "entry", F.lit(0).alias("item"), _digits(F.regexp_extract("e", _PAIR, 1)).alias("code"), F.lit(0).alias("shift"), _digits(F.regexp_extract("e", _PAIR, 2)).alias("target"))
    runs = parts.filter("kind = 'bfrange'").select("map", "section", F.posexplode(F.regexp_extract_all("s", F.lit(_RANGE), F.lit(0))).alias("entry", "e"))
    listed = runs.filter(F.contains("e", F.lit("["))).select("map", "section", "entry", "e", F.posexplode(F.regexp_extract_all(F.regexp_extract("e", _RANGE, 4), F.lit(_HEX), F.lit(1))).alias("item", "t"))
    listed = listed.select("map", "section", "entry", "item", _digits(F.regexp_extract("e", _RANGE, 1)).alias("code"), F.col("item").alias("shift"), _digits(F.col("t")).alias("target"))
    at = F.struct("section", "entry", "item").alias("place")
    one = singles.unionByName(listed).select("map", (F.length("code") / 2).cast("int").alias("own"), at, (_number(F.col("code")) + F.col("shift")).alias("lo"), utf16_text(F.col("target")).alias("text"))
    one = one.select("map", "own", "place", "lo", F.col("lo").alias("hi"), "text", F.lit(None).cast("long").alias("base"))
    spread = runs.filter(~F.contains("e", F.lit("["))).select("map", "section", "entry", F.lit(0).alias("item"), *[_digits(F.regexp_extract("e", _RANGE, i)).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))])
    first = F.coalesce(F.conv(F.left(F.hex(F.encode(utf16_text(F.col("c")), "UTF-32")), F.lit(8)), 16, 10).cast("long"), F.lit(0))
    spread = spread.select("map", (F.length("a") / 2).cast("int").alias("own"), at, _number(F.col("a")).alias("lo"), _number(F.col("b")).alias("hi"), F.lit(None).cast("string").alias("text"), first.alias("base"))
    spread = spread.withColumn("hi", F.least("hi", F.col("lo") + (LAST_CHARACTER - F.col("base"))))
    widths = code_spaces(maps).groupBy("map").agg(F.min("width").alias("least"), F.max("width").alias("most"))
    both = one.unionByName(spread).filter("lo <= hi").join(widths, "map")
    return both.select("map", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.col("own")).alias("width"), "place", "lo", "hi", "text", "base")


def blocks(lo: Column, hi: Column) -> Column:
    """The aligned blocks (level, number) that make up the codes from ``lo`` to ``hi``: a block of level k has two to the k codes."""

    def level(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("long")
        first, last = F.ceil(lo / size), F.floor((hi + 1) / size) - 1
        some = first <= last  # a block whose neighbour is inside too belongs to the level above
        ends = F.array(F.when(some & (first % 2 == 1), first), F.when(some & (last % 2 == 0), last))
        return F.transform(F.array_distinct(F.array_compact(ends)), lambda b: F.struct(k.alias("level"), b.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), level))


def look_up(codes: DataFrame, spans: DataFrame) -> DataFrame:
    """map, width, code, text: the distinct ``codes`` (map, width, code) that a range holds. ``spans``: see ``ranges``."""
    cut = spans.select("map", "width", "place", "lo", "text", "base", F.explode(blocks(F.col("lo"), F.col("hi"))).alias("b")).select("map", "width", "b.level", "b.block", "place", "lo", "text", "base")
    # of ranges over the same block the last holds, so a block is one row
    cut = cut.groupBy("map", "width", "level", "block").agg(F.max(F.struct("place", "lo", "text", "base")).alias("r"))
    levels = cut.groupBy("map", "width").agg(F.collect_set("level").alias("levels"))
    asked = codes.select("map", "width", "code").distinct().join(levels, ["map", "width"]).select("map", "width", "code", F.explode("levels").alias("level"))
    asked = asked.withColumn("block", F.floor(F.col("code") / F.pow(F.lit(2.0), "level")))
    held = asked.join(cut, ["map", "width", "level", "block"]).groupBy("map", "width", "code").agg(F.max("r").alias("r"))
    return held.select("map", "width", "code", F.coalesce("r.text", character(F.col("r.base") + F.col("code") - F.col("r.lo"))).alias("text"))


def _splitter(spaces: DataFrame) -> DataFrame:
    """map, pattern, even: what a code is, over characters that stand for bytes; shorter codes first, else so many bytes as the shortest code has.

    ``even``: the length of all codes of the map, null if they differ in length.
    """
    at = lambda digits, i: F.concat(F.lit(r"\x"), F.substring(digits, 2 * i + 1, F.lit(2)))
    one = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.concat(F.lit("["), at(F.col("lo"), i), F.lit("-"), at(F.col("hi"), i), F.lit("]")))
    backwards = F.exists(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.substring("lo", 2 * i + 1, F.lit(2)) > F.substring("hi", 2 * i + 1, F.lit(2)))
    said = spaces.select("map", "width", F.when(~backwards, F.array_join(one, "")).alias("p"))
    per = said.groupBy("map").agg(F.array_sort(F.collect_set(F.when(F.col("p").isNotNull(), F.struct("width", "p")))).alias("ps"), F.min("width").alias("least"), F.max("width").alias("most"))
    rest = F.concat(F.lit(".{1,"), F.col("least").cast("string"), F.lit("}"))
    return per.select("map", F.concat(F.lit("(?s)"), F.array_join(F.concat(F.transform("ps", lambda s: s["p"]), F.array(rest)), "|")).alias("pattern"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("even"))


def splitters(maps: DataFrame) -> DataFrame:
    """``_splitter`` of the maps' code spaces, written; small ones are broadcast to the strings, which stay in their tasks."""
    out = materialize(_splitter(code_spaces(maps)), "splitters")
    return F.broadcast(out) if _size(out, "pattern") <= KNOWN_BYTES else out


def _size(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0


def codes(strings: DataFrame, key: list[str], cutters: DataFrame) -> DataFrame:
    """``key``, map, ordinal, width, code: binary ``data`` cut at its map's code spaces. ``cutters``: see ``splitters``.

    Bytes that no space holds are taken as one code of the shortest length, a
    shorter rest at the end as one code. Null or empty data, and data without a map,
    are one row without a code.
    """
    cut = F.regexp_extract_all(F.decode("data", "ISO-8859-1"), "pattern", F.lit(0))
    rows = strings.select(*key, "map", "data").join(cutters, "map", "left").select(*key, "map", F.posexplode_outer(cut).alias("ordinal", "c"))
    code = F.when(F.col("c").isNotNull(), _number(F.hex(F.encode("c", "ISO-8859-1"))))
    return rows.select(*key, "map", "ordinal", F.length("c").alias("width"), code.alias("code"))


def _cut(data: bytes, pattern: str, even: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and numbers of the codes in ``data``."""
    if not even:
        pieces = re.findall(pattern.encode("latin-1"), data)
        return np.array([len(p) for p in pieces], np.int64), np.array([int.from_bytes(p, "big") for p in pieces], np.int64)
    n, rest = divmod(len(data), even)
    if even == 3:
        numbers = np.frombuffer(data, np.uint8, n * 3).reshape(n, 3).astype(np.int64) @ np.array([65536, 256, 1])
    else:
        numbers = np.frombuffer(data, f">u{even}", n).astype(np.int64)
    widths = np.full(n + (rest > 0), even)
    if rest:
        widths[-1], numbers = rest, np.append(numbers, int.from_bytes(data[-rest:], "big"))
    return widths, numbers


def _keys(widths: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return widths.astype(np.int64) << 32 | numbers


def used_codes(strings: DataFrame, cutters: DataFrame) -> DataFrame:
    """map, width, code: the different codes of strings, told apart in each batch before they become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for i, (m, data, pattern, even) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if data and pattern:
                    found.setdefault(m, (i, []))[1].append(np.unique(_keys(*_cut(data, pattern, even))))
            for i, parts in found.values():
                keys = np.unique(np.concatenate(parts))
                names = batch.column(0).take(pa.array(np.full(len(keys), i)))
                yield pa.RecordBatch.from_arrays([names, pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int64())], ["map", "width", "code"])

    rows = strings.select("map", "data").join(cutters, "map", "left").select("map", "data", "pattern", "even")
    return rows.mapInArrow(run, f"map {rows.schema['map'].dataType.simpleString()}, width int, code long").distinct()


def _map_tables(known: pa.Table) -> dict:
    """The codes of each map (lengths and numbers as one, sorted), and their texts, U+FFFD after the last."""
    out, names = {}, known.column("map").to_pylist()
    starts = [i for i, m in enumerate(names) if not i or m != names[i - 1]]
    for a, b in zip(starts, [*starts[1:], len(names)][: len(starts)], strict=True):
        part = known.slice(a, b - a)
        texts = part.column("text").cast(pa.large_string()).combine_chunks()
        out[names[a]] = _keys(part.column("width").to_numpy(), part.column("code").to_numpy()), pa.concat_arrays([texts, _LOST])
    return out


_LOST = pa.array(["\ufffd"], pa.large_string())


def _read_string(data: bytes | None, pattern: str | None, even: int | None, table: tuple[np.ndarray, pa.Array] | None) -> tuple[bytes, int, int]:
    """Text in UTF-8, number of codes, number of those without a text."""
    if not data or not pattern:
        return b"", 0, 0
    known, texts = table or (np.zeros(0, np.int64), _LOST)
    asked = _keys(*_cut(data, pattern, even))
    at = np.searchsorted(known, asked)
    if len(known):
        at[known[np.minimum(at, len(known) - 1)] != asked] = len(known)
    _, ends, text = texts.take(pa.array(at)).buffers()
    end = int(np.frombuffer(ends, np.int64, len(at) + 1)[-1])
    return text[:end].to_pybytes() if end else b"", len(at), int((at == len(known)).sum())


def _decode_in_place(strings: DataFrame, key: list[str], cutters: DataFrame, known: pa.Table) -> DataFrame:
    """``decode_strings`` with what was looked up in every task: a string is read where it lies."""
    sent = strings.sparkSession.sparkContext.broadcast(known.sort_by([("map", "ascending"), ("width", "ascending"), ("code", "ascending")]))
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _map_tables(sent.value)
        for batch in batches:
            rows = [_read_string(data, pattern, even, tables.get(m)) for m, data, pattern, even in zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True)]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [*key, "text", "n_codes", "n_unmapped"])

    rows = strings.select(*key, "map", "data").join(cutters, "map", "left").select(*key, "map", "data", "pattern", "even")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*key).schema)
    return rows.mapInArrow(run, f"{kept}text string, n_codes long, n_unmapped long")


def decode_strings(strings: DataFrame, key: list[str], maps: DataFrame) -> DataFrame:
    """``key``, text, n_codes, n_unmapped: strings read through their maps; a code without text is U+FFFD.

    ``strings``: key, map, data (binary). ``maps``: map, body; a map is given once.
    Each string has a key of its own. Codes are looked up once a map, not once for
    each place; if what was found has no more than ``KNOWN_BYTES``, every task gets it
    and reads strings where they lie, else it is joined with a row for each code.
    """
    cutters = splitters(maps)
    known = materialize(look_up(used_codes(strings, cutters), ranges(maps)), "charmap")
    if _size(known, "text") <= KNOWN_BYTES:
        return _decode_in_place(strings, key, cutters, known.filter("map IS NOT NULL AND text IS NOT NULL").toArrow())
    found = codes(strings, key, cutters).join(known, ["map", "width", "code"], "left")
    said = F.when(F.col("code").isNotNull(), F.struct("ordinal", F.coalesce("text", F.lit("\ufffd")).alias("text")))
    put = found.groupBy(*key).agg(F.array_sort(F.collect_list(said)).alias("s"), F.count("code").alias("n_codes"), F.count_if(F.col("code").isNotNull() & F.col("text").isNull()).alias("n_unmapped"))
    return put.select(*key, F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), "n_codes", "n_unmapped")
