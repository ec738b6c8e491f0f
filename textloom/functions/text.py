"""Text functions as Spark columns: words, escapes, markers, language ranges, fences.

All are built-in expressions, so they stay inside code generation and can be
pushed through projections. A null input gives null unless stated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores (array<string>)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokenize_words(text: Column) -> Column:
    """Words between white space, punctuation kept."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def escape_markup(text: Column) -> Column:
    """& < > and double quotes as entities (HTML text or attribute, XML)."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def escape_markdown_inline(text: Column) -> Column:
    """A backslash before each character that is structural inside a line."""
    return F.regexp_replace(text, r"([\\`*_\[\]<&~])", r"\\$1")


def escape_markdown(text: Column) -> Column:
    """Literal text for a block: the inline set, pipes, and what opens a block at a line's start."""

    def line(x: Column) -> Column:
        x = F.regexp_replace(x, r"([\\`*_\[\]<&~|])", r"\\$1")
        x = F.regexp_replace(x, r"^(\s{0,3})([#>+=-])", r"$1\\$2")
        return F.regexp_replace(x, r"^(\s{0,3})(\d{1,9})([.)])", r"$1$2\\$3")

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def escape_table_cell(text: Column) -> Column:
    """Literal text for a table cell: the inline set and pipes."""
    return F.replace(escape_markdown_inline(text), F.lit("|"), F.lit("\\|"))


def escape_link_destination(url: Column) -> Column:
    """A link target: in angle brackets where white space or a parenthesis would end it."""
    safe = F.regexp_replace(url, r"([\\<>])", r"\\$1")
    return F.when(url.rlike(r"[\s()]"), F.concat(F.lit("<"), safe, F.lit(">"))).otherwise(safe)


def emphasize(escaped: Column, bold: bool = False, italic: bool = False, script: str | None = None) -> Column:
    """Escaped text in emphasis marks; white space at its ends stays outside; blank text stays as it is."""
    marks = "***" if bold and italic else "**" if bold else "*" if italic else ""
    if not marks and not script:
        return escaped
    tag = {"sub": "sub", "super": "sup"}.get(script or "", "")
    before, after = (f"<{tag}>{marks}", f"{marks}</{tag}>") if tag else (marks, marks)
    lead = F.regexp_extract(escaped, r"^(\s*)", 1)
    core = F.regexp_extract(escaped, r"(?s)^\s*(.*?)\s*$", 1)
    tail = F.regexp_extract(escaped, r"(\s*)$", 1)
    return F.when(core == "", escaped).otherwise(F.concat(lead, F.lit(before), core, F.lit(after), tail))


#: Tags that a renderer of untrusted Markdown must not pass (fixed by the GFM specification).
DISALLOWED_TAGS = ("title", "textarea", "style", "xmp", "iframe", "noembed", "noframes", "script", "plaintext")


def filter_disallowed_html(html: Column) -> Column:
    """The opening ``<`` of a disallowed tag as an entity."""
    return F.regexp_replace(html, r"(?i)<(/?)(%s)([\s/>])" % "|".join(DISALLOWED_TAGS), "&lt;$1$2$3")


def strip_json_fence(reply: Column) -> Column:
    """A reply without the one code fence around the whole of it; trimmed."""
    t = F.regexp_replace(reply, r"^\s+|\s+$", "")
    body = F.regexp_extract(t, r"^```[A-Za-z]*[ \t]*\r?\n([\s\S]*?)\r?\n?```$", 1)
    return F.when(t.rlike(r"^```[A-Za-z]*[ \t]*\r?\n[\s\S]*?\r?\n?```$"), body).otherwise(t)


def contains_private_use(text: Column) -> Column:
    """Whether the text holds a private-use code point; false for null."""
    return F.coalesce(text.rlike(r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"), F.lit(False))


def strip_non_xml(text: Column) -> Column:
    """Text without characters that XML 1.0 does not allow."""
    return F.regexp_replace(text, r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def split_authors(text: Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def lang_matches(tag: Column, wanted: Column) -> Column:
    """Extended filtering of a language tag by a language range (RFC 4647); a blank or null tag matches nothing.

    The fold's state is the number of range parts used up, or -1 once the match
    has failed. A ``*`` needs nothing; a tag part that a range part skips must not
    be a single character.
    """
    t, r = F.split(F.lower(F.trim(tag)), "-"), F.split(F.lower(F.trim(wanted)), "-")
    skip = lambda k: F.coalesce(F.aggregate(F.sequence(k, F.size(r)), k, lambda at, _: F.when((at < F.size(r)) & (F.get(r, at) == "*"), at + 1).otherwise(at)), k)
    first = (F.get(r, F.lit(0)) == "*") | (F.get(r, F.lit(0)) == F.get(t, F.lit(0)))
    start = skip(F.lit(1))

    def step(at: Column, part: Column) -> Column:
        return (
            F.when((at < 0) | (at >= F.size(r)), at)
            .when(F.get(r, at) == part, skip(at + 1))
            .when(F.length(part) == 1, F.lit(-1))
            .otherwise(at)
        )

    done = F.aggregate(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), start, step)
    return F.coalesce((F.trim(tag) != "") & first & (done >= F.size(r)), F.lit(False))


def marker(text: Column) -> Column:
    """The list marker that opens a line: struct<kind, ordinal, length>; kind null where there is none.

    Kinds: task, bullet, ordinal. ``length`` counts the marker and the space after it.
    """
    task = F.regexp_extract(text, r"^([☐☑](?:\s+|$))", 1)
    bullet = F.regexp_extract(text, r"^([•◦▪‣·–—*+-](?:\s+|$))", 1)
    number = r"^(\(?(\d{1,9}|[ivxlcdm]{1,7}|[IVXLCDM]{1,7}|[a-zA-Z])[.)](?:\s+|$))"
    whole, value = F.regexp_extract(text, number, 1), F.regexp_extract(text, number, 2)
    kind = F.when(task != "", F.lit("task")).when(bullet != "", F.lit("bullet")).when(whole != "", F.lit("ordinal"))
    length = F.when(task != "", F.length(task)).when(bullet != "", F.length(bullet)).when(whole != "", F.length(whole))
    return F.struct(kind.alias("kind"), F.when(kind == "ordinal", value.try_cast("int")).alias("ordinal"), length.alias("length"))


def word_pattern(term: str, whole_word: bool = False, ignore_case: bool = False) -> str:
    """A Java pattern for a literal term; whole words do not touch letters, marks, digits or underscores."""
    body = r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"
    if whole_word:
        body = r"(?<![\p{L}\p{M}\p{N}_])" + body + r"(?![\p{L}\p{M}\p{N}_])"
    return ("(?iu)" if ignore_case else "") + body


def find_ranges(text: Column, term: str, whole_word: bool = False, ignore_case: bool = False) -> Column:
    """array<struct<start, end>> of a literal term's places (code points, end exclusive).

    From the lengths of what stands between the matches.
    """
    p = word_pattern(term, whole_word, ignore_case)
    gaps, found = F.transform(F.split(text, p), F.char_length), F.regexp_extract_all(text, F.lit(p), F.lit(0))
    upto = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda s, x: s + x) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda s, x: s + F.char_length(x))
    return F.transform(found, lambda x, i: F.struct(upto(i).alias("start"), (upto(i) + F.char_length(x)).alias("end")))


def redact(text: Column, term: str, mask: str = "█", whole_word: bool = False, ignore_case: bool = False) -> tuple[Column, Column]:
    """(text with each match masked, number of matches)."""
    p = word_pattern(term, whole_word, ignore_case)
    return F.regexp_replace(text, p, mask * len(term)), F.regexp_count(text, F.lit(p))


def fold_digits(line: Column) -> Column:
    """A line as a key: trimmed, white space collapsed, digit runs as ``#``."""
    return F.regexp_replace(F.regexp_replace(F.trim(line), r"\s+", " "), r"\d+", "#")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``{token}`` as its value, unknown ones and nulls as nothing; ``{{`` is a brace."""
    parts = []
    for m in re.finditer(r"\{\{|\{([^{}]*)\}|[^{]+|\{", template):
        if m[1] is None:
            parts.append(F.lit("{" if m[0] == "{{" else m[0]))
        elif m[1] in values:
            parts.append(F.coalesce(values[m[1]].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
