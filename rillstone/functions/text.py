"""Text functions. Positions are code points from 0; what is not found is -1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charset as charsets

WHITE = " \t\n\r\u000b\f"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def coded(data: bytes | Column, charset: str = "utf8") -> Column:
    """The text of bytes in a charset, for any argument of these functions: a literal of the driver's bytes, or of a binary column."""
    return charsets.decode(data, charset) if isinstance(data, Column) else F.lit(charsets.decoded(bytes(data), charset))


def size(s: Column) -> Column:
    return F.length(s)


def empty(s: Column) -> Column:
    return s == ""


def at(s: Column, i) -> Column:
    """The letter at a position; an error outside the text."""
    i = lit(i)
    return F.when((i >= 0) & (i < F.length(s)), F.substring(s, i + 1, F.lit(1))).otherwise(F.raise_error(F.lit("position out of range")))


def sub(s: Column, start, length) -> Column:
    """Held to the text; never fails."""
    start, length = lit(start), lit(length)
    return F.when((start < 0) | (start >= F.length(s)) | (length <= 0), F.lit("")).otherwise(F.substring(s, start + 1, length))


def repeat(s: Column, n) -> Column:
    return F.repeat(s, lit(n).cast("int"))


def concat(*parts) -> Column:
    return F.concat(*[lit(p) for p in parts])


def starts_with(s: Column, x) -> Column:
    return F.startswith(s, lit(x))


def ends_with(s: Column, x) -> Column:
    return F.endswith(s, lit(x))


def contains(s: Column, x) -> Column:
    return F.contains(s, lit(x))


def index_of(s: Column, x, start=0) -> Column:
    """The first place of x from ``start`` on; an empty x stands at 0."""
    x, start = lit(x), lit(start)
    return F.when(x == "", 0).otherwise(F.call_function("locate", x, s, (start + 1).cast("int")) - 1)


def last_index_of(s: Column, x, start=None) -> Column:
    """The last place of x, at ``start`` or before; an empty x stands at the end."""
    x = lit(x)
    if start is not None:
        s = F.substring(s, F.lit(1), lit(start) + F.length(x))
    back = F.call_function("locate", F.reverse(x), F.reverse(s), F.lit(1))
    return F.when(x == "", F.length(s)).when(back == 0, -1).otherwise(F.length(s) - F.length(x) - (back - 1))


def replace(s: Column, target, by, most: int | None = None) -> Column:
    """All places of a literal target, or the first ``most``; an empty target changes nothing."""
    target, by = lit(target), lit(by)
    if most is None:
        return F.when(target == "", s).otherwise(F.replace(s, target, by))
    if most <= 0:
        return s
    parts = split_all(s, target)
    swapped = F.concat_ws("", F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, most), lambda p: F.concat(by, p)), ""), F.array_join(F.transform(F.slice(parts, most + 2, 1 << 30), lambda p: F.concat(target, p)), ""))
    return F.when(target == "", s).otherwise(swapped)


def count(s: Column, x) -> Column:
    """Places of x that do not overlap; none of an empty x."""
    x = lit(x)
    return F.when(x == "", 0).otherwise(((F.length(s) - F.length(F.replace(s, x, F.lit("")))) / F.length(x)).cast("int"))


def trim(s: Column) -> Column:
    """Without blanks, tabs, line, form feeds and returns at its ends."""
    return F.btrim(s, F.lit(WHITE))


def to_upper(s: Column) -> Column:
    """a-z alone."""
    return F.translate(s, LOWER, UPPER)


def to_lower(s: Column) -> Column:
    """A-Z alone."""
    return F.translate(s, UPPER, LOWER)


def reverse(s: Column) -> Column:
    return F.reverse(s)


def split_all(s: Column, delimiter: Column) -> Column:
    """Fields between a literal delimiter, empty ones too."""
    quoted = F.concat(F.lit("\\Q"), F.replace(delimiter, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.split(s, quoted, -1)


def split(s: Column, delimiter) -> Column:
    """Fields between a literal delimiter, empty ones too; an empty text has none."""
    if isinstance(delimiter, str) and delimiter == "":
        raise ValueError("an empty delimiter splits nothing")
    return F.when(s == "", F.expr("cast(array() as array<string>)")).otherwise(split_all(s, lit(delimiter)))


def join(parts: Column, delimiter: str = "") -> Column:
    return F.array_join(parts, delimiter)


def compare(a: Column, b) -> Column:
    """-1, 0 or 1 by code points."""
    b = lit(b)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def code_points(s: Column) -> Column:
    """The code points as integers."""
    return F.when(s == "", F.expr("cast(array() as array<int>)")).otherwise(F.transform(F.split(s, ""), lambda c: F.ascii(c)))


def of_code_points(points: Column) -> Column:
    """The text of code points: each is written as its UTF-8 bytes."""

    def one(p: Column) -> Column:
        low = lambda k: F.lit(0x80) + F.shiftright(p, k) % 64
        chars = (
            F.when(p < 0x80, F.hex(p))
            .when(p < 0x800, F.concat(F.hex(F.lit(0xC0) + F.shiftright(p, 6)), F.hex(low(0))))
            .when(p < 0x10000, F.concat(F.hex(F.lit(0xE0) + F.shiftright(p, 12)), F.hex(low(6)), F.hex(low(0))))
            .otherwise(F.concat(F.hex(F.lit(0xF0) + F.shiftright(p, 18)), F.hex(low(12)), F.hex(low(6)), F.hex(low(0))))
        )
        return F.lpad(chars, F.ceil(F.length(chars) / 2).cast("int") * 2, F.lit("0"))

    return F.decode(F.unhex(F.array_join(F.transform(points, one), "")), "UTF-8")


def is_surrogate(point: Column) -> Column:
    return (point >= 0xD800) & (point <= 0xDFFF)


def is_valid_code_point(point: Column) -> Column:
    return (point >= 0) & (point <= 0x10FFFF) & ~is_surrogate(point)


def byte_values(s: Column) -> Column:
    """The UTF-8 bytes as integers 0 to 255."""
    return bytes_of(F.encode(s, "UTF-8"))


def bytes_of(b: Column) -> Column:
    """The bytes of a binary as integers 0 to 255."""
    hexed = F.hex(b)
    n = F.octet_length(b)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


def number_text(v: Column, kind: str) -> Column:
    """How a value reads in joined text: whole numbers plain, booleans as words, floats with six significant digits, anything that is no text or number as nothing."""
    if kind == "string":
        return v
    if kind == "boolean":
        return v.cast("string")
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return v.cast("string")
    if kind in ("float", "double"):
        return six_digits(v.cast("double"))
    return F.lit(None).cast("string")


def six_digits(v: Column) -> Column:
    """A double with six significant digits, without trailing zeros, in exponents below 1e-4 and from 1e6 on."""
    sci = F.format_string("%.5e", v)
    exponent = F.substring_index(sci, "e", -1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(sci, "e", 1), "0+$", ""), r"\.$", "")
    wide = F.concat(mantissa, F.lit("e"), F.substring_index(sci, "e", -1))
    plain = F.when(exponent >= 5, F.format_string("%.0f", v))
    for places in range(1, 10):
        plain = plain.when(exponent == 5 - places, F.format_string(f"%.{places}f", v))
    short = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").when(v == 0, "0").when((exponent < -4) | (exponent >= 6), wide).otherwise(short)
