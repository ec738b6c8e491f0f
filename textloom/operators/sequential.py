"""Value-at-a-time algorithms as DataFrame operators: Arrow batches in, rows out.

Every function here keeps its input's partitions: a document, a pair or a
conversation is worked on where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import sequences
from textloom.functions.inlines import inlines
from textloom.operators import selectors
from textloom.sources import parsers


def explode_rows(df: DataFrame, keep: list[str], inputs: list[str], make: Callable, schema: str) -> DataFrame:
    """``keep`` columns with each row that ``make(*inputs)`` gives (tuples in the order of ``schema``)."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    out = f"{kept}, {schema}"
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(out)

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for batch in batches:
            n = len(keep)
            at, rows = [], []
            for i, args in enumerate(zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True)):
                got = make(*args)
                at += [i] * len(got)
                rows += got
            columns = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
            columns += [pa.array([r[j] for r in rows], arrow.field(n + j).type) for j in range(len(fields) - n)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([(f.name, c.type) for f, c in zip(fields, columns, strict=True)]))

    return df.select(*keep, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)]).mapInArrow(run, fields)


def windows(docs: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """doc_id, ordinal, window."""
    return explode_rows(docs, ["doc_id"], ["text"], lambda t: list(enumerate(sequences.window_text(t or "", size, overlap))), "ordinal int, window string")


def conversation_chunks(turns: DataFrame, most: int) -> DataFrame:
    """conv_id, ordinal, turns, text: a conversation's turns packed in order."""
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    make = lambda t: [(i, p, x) for i, (p, x) in enumerate(sequences.pack_pages([(r["turn"], r["text"] or "") for r in t], most))]
    return explode_rows(held, ["conv_id"], ["t"], make, "ordinal int, turns array<long>, text string")


def compare(pairs: DataFrame, keep: list[str], semantic: bool = True) -> DataFrame:
    """Statistics of the differences between columns ``old`` and ``new``, word by word; ``minimal``: no shorter script exists."""

    def make(a, b):
        runs, minimal = sequences.compared(sequences.word_keys(a or ""), sequences.word_keys(b or ""), semantic)
        s = sequences.diff_stats(runs)
        return [(s["equal"], s["deleted"], s["inserted"], s["changes"], s["similarity"], minimal)]

    return explode_rows(pairs, keep, ["old", "new"], make, "equal int, deleted int, inserted int, changes int, similarity double, minimal boolean")


def compare_report(pairs: DataFrame, keep: list[str], form: str, context: int | None = None) -> DataFrame:
    """A marked-up report of the differences (html or markdown)."""
    make = lambda a, b: [(sequences.report(sequences.diff((a or "").split(), (b or "").split(), True), form, context),)]
    return explode_rows(pairs, keep, ["old", "new"], make, "report string")


def html_nodes(pages: DataFrame) -> DataFrame:
    """page_id, node_id, parent_id, ordinal, kind, name, text, attrs."""
    names = ("node_id", "parent_id", "ordinal", "kind", "name", "text", "attrs")
    make = lambda h: [tuple(r[n] for n in names) for r in parsers.html_nodes(h)]
    return explode_rows(pages, ["page_id"], ["html"], make, "node_id int, parent_id int, ordinal int, kind string, name string, text string, attrs map<string,string>")


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, href, text."""
    return explode_rows(pages, ["page_id"], ["html"], parsers.html_links, "href string, text string")


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, text."""
    return explode_rows(pages, ["page_id"], ["html"], lambda h: [(parsers.html_text(h),)], "text string")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, kind, level, text."""
    make = lambda t: [(b["ordinal"], b["kind"], b["level"], b["text"]) for b in parsers.markdown_blocks(t)]
    return explode_rows(docs, ["doc_id"], ["text"], make, "ordinal int, kind string, level int, text string")


def markdown_inlines(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ordinal, depth, kind, text, target: the inline nodes of each ``text``."""
    return explode_rows(leaves, keep, ["text"], inlines, "ordinal int, depth int, kind string, text string, target string")


def html_elements(pages: DataFrame) -> DataFrame:
    """page_id, node, parent, last, name, attrs: elements in document order, with the last node below each."""

    def make(h):
        rows = parsers.html_nodes(h)
        return [(r["node_id"], r["parent_id"], z, r["name"], r["attrs"]) for r, z in zip(rows, selectors.with_last(rows), strict=True) if r["kind"] == "element"]

    return explode_rows(pages, ["page_id"], ["html"], make, "node int, parent int, last int, name string, attrs map<string,string>")
