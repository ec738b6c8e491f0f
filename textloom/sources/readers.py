"""Tables from files: text, archives, forms, data URIs; and the writers that answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.sequential import explode_rows
from textloom.sources import parsers
from textloom.shipping import ship

FORM_SCHEMA = "file string, id string, fields array<struct<name string, type string, value array<string>, options array<string>, richText string>>"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def read_text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """path, text, status: strict UTF-8, or UTF-16 with a byte order mark; other bytes are reported, not repaired."""
    c = F.col("content")
    mark = F.hex(F.substring(c, 1, 3))
    utf8 = F.when(mark == "EFBBBF", F.expr("substring(content, 4)")).otherwise(c)
    wide = mark.startswith("FEFF") | mark.startswith("FFFE")
    text = F.when(mark.startswith("FEFF"), F.decode(F.expr("substring(content, 3)"), "UTF-16BE")).when(mark.startswith("FFFE"), F.decode(F.expr("substring(content, 3)"), "UTF-16LE")).otherwise(F.try_validate_utf8(utf8.cast("string")))
    out = read_files(spark, path, glob).select("path", text.alias("text"), wide.alias("w"))
    return out.select("path", "text", F.when(F.col("text").isNull(), "malformed").otherwise("ok").alias("status"))


def read_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """path, name, data of the files inside archives."""
    ship(spark)
    return explode_rows(read_files(spark, path, glob), ["path"], ["content"], parsers.zip_entries, "name string, data binary")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, text of paragraphs."""
    ship(spark)
    return explode_rows(read_files(spark, path, "*.docx"), ["path"], ["content"], lambda b: list(enumerate(parsers.docx_paragraphs(b))), "ordinal int, text string")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """path, html: bytes decoded in the charset they declare."""
    ship(spark)
    return explode_rows(read_files(spark, path, "*.htm*"), ["path"], ["content"], lambda b: [(parsers.decode_html(b),)], "html string")


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """name, type, value, ... of form fields in JSON files; a file of another shape fails the read."""
    forms = spark.read.schema(FORM_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return forms.select("file", "id", F.explode("fields").alias("f")).select("file", "id", "f.*")


def write_forms(fields: DataFrame, path: str, form_col: str = "form") -> None:
    """One JSON line for each form: {id, fields: [{name, value}, ...]}."""
    fields.groupBy(F.col(form_col).cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("fields")).write.mode("overwrite").json(path)


def write_xfdf(fields: DataFrame, form_col: str = "form") -> DataFrame:
    """form, xfdf: each form's fields as XFDF."""
    held = fields.groupBy(form_col).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("f"))
    return explode_rows(held, [form_col], ["f"], lambda f: [(parsers.write_xfdf([(x["name"], x["value"] or "") for x in f]),)], "xfdf string")


def data_uri(uri: Column) -> Column:
    """The bytes of a data URI; null without the prefix, the comma, or with a bad escape."""
    meta, body = F.regexp_extract(uri, r"(?s)^data:([^,]*),(.*)$", 1), F.regexp_extract(uri, r"(?s)^data:([^,]*),(.*)$", 2)
    plain = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary")
    b64 = F.try_to_binary(body, F.lit("base64"))
    return F.when(uri.rlike(r"(?s)^data:[^,]*,"), F.when(F.lower(meta).endswith(";base64"), b64).otherwise(plain))


def ascii_hex(text: Column) -> Column:
    """Hexadecimal text up to ``>`` as bytes, white space skipped, an odd digit filled with 0; null for other characters."""
    t = F.regexp_replace(F.regexp_extract(text, r"(?s)^([^>]*)", 1), r"\s", "")
    return F.when(t.rlike(r"^[0-9A-Fa-f]*$"), F.unhex(F.when(F.length(t) % 2 == 1, F.concat(t, F.lit("0"))).otherwise(t)))
