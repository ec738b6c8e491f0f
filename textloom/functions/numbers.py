"""Number formats, masks, bounds and sums over text values, as Spark columns."""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thousands and decimal separators of the separator styles 0 to 4 (fixed values).
SEPARATORS = [(",", "."), ("", "."), (".", ","), ("", ","), ("'", ".")]


def make_number(text: Column) -> Column:
    """The number that a trimmed text begins with, its first comma read as a dot; null if none."""
    t = F.regexp_replace(F.trim(text), r"^([^,]*),", "$1.")
    return F.regexp_extract(t, r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double")


def printf_fixed(value: Column, decimals: int, style: int) -> Column:
    """A double with a fixed number of decimals in one of the separator styles."""
    thousands, point = SEPARATORS[min(max(style, 0), 4)]
    plain = F.format_number(F.abs(value), decimals)
    plain = F.translate(plain, ",.", "\x01\x02")
    plain = F.replace(F.replace(plain, F.lit("\x01"), F.lit(thousands)), F.lit("\x02"), F.lit(point))
    zero = ~plain.rlike("[1-9]")
    return F.concat(F.when((value < 0) & ~zero, "-").otherwise(""), plain)


def number_format(text: Column, decimals: int, style: int, negative: int = 0, currency: str = "", prepend: bool = True) -> Column:
    """A text value as a formatted amount; unparsable gives ''. Negative styles: 0 minus, 1 bare, 2 and 3 in parentheses."""
    v = make_number(text)
    below = v < 0
    # every part stands outside the branches, so that the number is read once a row
    body = printf_fixed(F.abs(v) if negative != 0 or prepend else v, decimals, style)
    out = F.concat(F.lit(currency), body) if prepend else F.concat(body, F.lit(currency))
    if negative in (2, 3):
        out = F.concat(F.when(below, "(").otherwise(""), out, F.when(below, ")").otherwise(""))
    elif negative == 0 and prepend:
        out = F.concat(F.when(below, "-").otherwise(""), out)
    return F.coalesce(out, F.lit(""))


def percent_format(text: Column, decimals: int, style: int, prepend: bool = False) -> Column:
    """A text value times 100 with a percent sign; unparsable gives '%'."""
    v = make_number(text)
    s = printf_fixed(v * 100, decimals, style)
    return F.when(v.isNull(), F.lit("%")).otherwise(F.concat(F.lit("%"), s) if prepend else F.concat(s, F.lit("%")))


def number_keystroke(text: Column, style: int) -> Column:
    """Whether a text is a number in the separator style; blank passes."""
    point = "," if style > 1 else r"\."
    return (F.coalesce(text, F.lit("")) == "") | F.trim(text).rlike(rf"^[+-]?(\d+({point}\d*)?|{point}\d+)$")


def special_format(text: Column, kind: int) -> Column:
    """Digits in a mask: 0 postcode, 1 long postcode, 2 telephone, 3 social security; stops where digits run out."""
    d = F.regexp_replace(text, r"\D", "")

    def mask(*parts: tuple[str, int, int]) -> Column:
        """(literal, first digit, digits): the literal is written as long as a digit before it was."""
        return F.concat(*[F.when(F.length(d) >= first, F.concat(F.lit(lit), F.substring(d, first, n))).otherwise("") for lit, first, n in parts])

    masks = {
        0: lambda: mask(("", 1, 5)),
        1: lambda: mask(("", 1, 5), ("-", 6, 4)),
        2: lambda: F.when(F.length(d) >= 10, mask(("(", 1, 3), (") ", 4, 3), ("-", 7, 4))).otherwise(mask(("", 1, 3), ("-", 4, 4))),
        3: lambda: mask(("", 1, 3), ("-", 4, 2), ("-", 6, 4)),
    }
    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(masks[kind]())


def special_keystroke(text: Column, kind: int) -> Column:
    """Whether a text has the mask's form, with or without its punctuation."""
    exact = {0: r"^\d{5}$", 1: r"^\d{5}-\d{4}$", 2: r"^(\d{3}-\d{4}|\(\d{3}\) \d{3}-\d{4})$", 3: r"^\d{3}-\d{2}-\d{4}$"}[kind]
    digits = {0: r"^\d{5}$", 1: r"^\d{9}$", 2: r"^(\d{7}|\d{10})$", 3: r"^\d{9}$"}[kind]
    return text.rlike(exact) | F.regexp_replace(text, r"[-()\s]+", "").rlike(digits)


def range_validate(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Whether a text value lies within the bounds; blank and unparsable pass."""
    v = make_number(value)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.coalesce((F.trim(value) == "") | ok, F.lit(True))


def half_up_6(x: Column) -> Column:
    """Six decimals, halves towards plus infinity."""
    return F.when(F.abs(x) < 9e12, F.floor(x * 1e6 + 0.5) / 1e6).otherwise(x)  # larger ones have no six decimals


def simple_calculate(kind: str, text: Column) -> Column:
    """SUM, AVG, PRD, MIN or MAX over text values in a group; unparsable counts as 0, no rows as 0; another kind is null.

    Twelve decimals of values below 1e18 are summed exactly; what lies beyond either
    end is summed in double precision, and so is all where the exact sum has no room.
    """
    v = F.coalesce(make_number(text), F.lit(0.0))
    fixed = v.try_cast("decimal(30,12)")
    total = F.coalesce(F.try_sum(fixed).cast("double") + F.sum(v - F.coalesce(fixed.cast("double"), F.lit(0.0))), F.sum(v))
    agg = {"SUM": total, "AVG": total / F.count(F.lit(1)), "PRD": F.product(v), "MIN": F.min(v), "MAX": F.max(v)}
    return half_up_6(F.coalesce(agg[kind], F.lit(0.0))) if kind in agg else F.lit(None).cast("double")


def bates(number: Column, digits: int = 6) -> Column:
    """A number padded with zeros to a least width; longer ones stay whole."""
    s = number.cast("string")
    return F.when(F.length(s) >= digits, s).otherwise(F.lpad(s, digits, "0"))


def roman(n: Column) -> Column:
    """Lower-case roman numerals; '' below 1."""
    digit = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]

    def place(one: str, five: str, ten: str, unit: int) -> Column:
        values = F.array(*[F.lit(x.translate(str.maketrans("ivx", one + five + ten))) for x in digit])
        return F.element_at(values, (F.pmod(F.floor(n / unit), F.lit(10)) + 1).cast("int"))

    thousands = F.repeat(F.lit("m"), F.floor(n / 1000).cast("int"))
    return F.when(n < 1, "").otherwise(F.concat(thousands, place("c", "d", "m", 100), place("x", "l", "c", 10), place("i", "v", "x", 1)))


def alpha(n: Column) -> Column:
    """a to z, then aa, bb, ...; '' below 1."""
    letter = F.char(F.pmod(n - 1, F.lit(26)) + 97)
    return F.when(n < 1, "").otherwise(F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int")))


def numeral(style: Column, n: Column) -> Column:
    """A number in a page-label style: D decimal, r R roman, a A letters, else nothing."""
    return F.when(style == "D", n.cast("string")).when(style == "r", roman(n)).when(style == "R", F.upper(roman(n))).when(style == "a", alpha(n)).when(style == "A", F.upper(alpha(n))).otherwise("")


def exact_sum(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``by`` and the exactly rounded sum of ``value`` (double); nulls are left out, no values give 0.

    A double is a whole number times a power of two. Whole numbers are summed
    exactly for each power (map-side, as any sum); a group's sums, a few hundred at
    most, are then added as integers and rounded once. Not-a-number and infinities
    are summed as usual.
    """
    x = F.col(value).cast("double")
    finite = F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    power = F.when(finite & (x != 0), F.floor(F.log2(F.abs(x))) - 54).otherwise(0).cast("int")
    half = F.floor(-F.col("_p") / 2)  # two steps: one power of two may lie outside the range of doubles
    whole = (F.col("_x") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -F.col("_p") - half)).cast("bigint").cast("decimal(38,0)")
    held = rows.select(*by, F.when(finite, x).alias("_x"), F.when(~finite, x).alias("_odd"), power.alias("_p"))
    sums = held.groupBy(*by, "_p").agg(F.sum(whole).alias("_n"), F.sum("_odd").alias("_odd"))
    each = sums.groupBy(*by).agg(F.collect_list(F.struct("_p", "_n")).alias("_s"), F.sum("_odd").alias("_odd"))

    def rounded(s: pa.Array) -> pa.Array:
        out = []
        for terms in s.to_pylist():
            terms = [(t["_p"], int(t["_n"])) for t in terms or [] if t["_n"] is not None]
            least = min((p for p, _ in terms), default=0)
            total = sum(n << (p - least) for p, n in terms)
            try:
                out.append(float(Fraction(total) * Fraction(2) ** least))
            except OverflowError:
                out.append(float("inf") if total > 0 else float("-inf"))
        return pa.array(out, pa.float64())

    return each.select(*by, F.coalesce("_odd", F.arrow_udf(rounded, "double")("_s")).alias(name))


def exponential(x: Column, c0: float, c1: float, n: float) -> Column:
    """c0 + x ** n * (c1 - c0), x held between 0 and 1."""
    return c0 + F.pow(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.lit(n)) * (c1 - c0)


def stitched(x: Column, bounds: list[float], parts: list, encode: list[tuple[float, float]], low: float = 0.0, high: float = 1.0) -> Column:
    """A function in pieces: x between two bounds is carried to the piece's own range and given to it. ``parts``: functions of a column."""
    x = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    edges = [low, *bounds, high]
    out = None
    for k in reversed(range(len(parts))):
        a, b = edges[k], edges[k + 1]
        own = encode[k][0] + (x - a) / (b - a) * (encode[k][1] - encode[k][0]) if b > a else F.lit(encode[k][0])
        out = parts[k](own) if out is None else F.when(x < b, parts[k](own)).otherwise(out)
    return out


def number_form(n: Column, form: Column) -> Column:
    """A counter in a list's number form: decimal, decimalZero, lower and upper Roman and Letter, none; null for another form."""
    plain = n.cast("string")
    letters = F.when(n > 0, alpha(n)).otherwise(plain)
    numerals = F.when(n > 0, roman(n)).otherwise(plain)
    return (
        F.when(form == "decimal", plain)
        .when(form == "decimalZero", F.when((n >= 0) & (n < 10), F.concat(F.lit("0"), plain)).otherwise(plain))
        .when(form == "lowerRoman", numerals).when(form == "upperRoman", F.upper(numerals))
        .when(form == "lowerLetter", letters).when(form == "upperLetter", F.upper(letters))
        .when(form == "none", "")
    )
