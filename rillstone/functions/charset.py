"""Charsets of text: encoding with replacements, decoding that never fails, conversion.

Encoding is Column expressions. Decoding bytes that are known to be valid is too,
and so is decoding ascii, latin1 and valid UTF-8. Malformed UTF needs a state
machine whose count of replacement letters no Spark function has, and runs as an
Arrow function; UTF-16 and UTF-32 of unknown validity go there whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BAD = "�"
# The charsets and what Spark calls them. Plain utf16 and utf32 are little-endian, without a byte order mark.
NAMES = {
    "ascii": "US-ASCII",
    "latin1": "ISO-8859-1",
    "utf8": "UTF-8",
    "utf16": "UTF-16LE",
    "utf16le": "UTF-16LE",
    "utf16be": "UTF-16BE",
    "utf32": "UTF-32",
    "utf32le": "UTF-32",
    "utf32be": "UTF-32",
}


def known(charset: str) -> str:
    name = charset.lower().replace("-", "").replace("_", "")
    if name not in NAMES:
        raise ValueError(f"the charset {charset} is not known")
    return name


def turned(b: Column) -> Column:
    """The bytes from last to first; as letters of Latin-1, which each are one byte."""
    return F.encode(F.reverse(F.decode(b, "ISO-8859-1")), "ISO-8859-1")


def encode(s: Column, charset: str = "utf8") -> Column:
    """The bytes of a text; letters that ascii or latin1 do not have become ``?``."""
    name = known(charset)
    if name == "ascii":
        s = F.regexp_replace(s, r"[^\x00-\x7F]", "?")
    elif name == "latin1":
        s = F.regexp_replace(s, r"[^\x00-\xFF]", "?")
    if name in ("utf32", "utf32le"):
        return turned(F.encode(F.reverse(s), NAMES[name]))  # the letters are turned twice, the bytes of each once
    return F.encode(s, NAMES[name])


def decode_valid(b: Column, charset: str = "utf8") -> Column:
    """The text of bytes that are known to be valid; an error otherwise."""
    name = known(charset)
    if name in ("utf32", "utf32le"):
        return F.reverse(F.decode(turned(b), NAMES[name]))
    return F.decode(b, NAMES[name])


def sequence_length(first: int, charset: str) -> int:
    """How many bytes a letter that starts with this byte has; 0 if none can."""
    name = known(charset)
    if name in ("ascii", "latin1"):
        return 1
    if name.startswith("utf16"):
        return 2
    if name.startswith("utf32"):
        return 4
    for mask, lead, n in ((0x80, 0, 1), (0xE0, 0xC0, 2), (0xF0, 0xE0, 3), (0xF8, 0xF0, 4)):
        if first & mask == lead:
            return n
    return 0


def valid_point(p: int) -> bool:
    return 0 <= p <= 0x10FFFF and not 0xD800 <= p <= 0xDFFF


# What Python calls the charsets of more than one byte.
CODECS = {"utf16": "utf-16-le", "utf16le": "utf-16-le", "utf16be": "utf-16-be", "utf32": "utf-32-le", "utf32le": "utf-32-le", "utf32be": "utf-32-be"}


def decoded(raw: bytes, charset: str = "utf8") -> str:
    """The text of any bytes. In UTF-8 a wrong lead or following byte costs one byte, a cut-off end all that is left, an overlong form or surrogate its whole length; each is one U+FFFD."""
    name = known(charset)
    if name == "latin1":
        return raw.decode("latin-1")
    if name == "ascii":
        return "".join(chr(x) if x < 0x80 else BAD for x in raw)
    out, at, end = [], 0, len(raw)
    if name == "utf8":
        try:
            return raw.decode()
        except UnicodeDecodeError:
            pass
        least = (0, 0, 0x80, 0x800, 0x10000)
        while at < end:
            n = sequence_length(raw[at], name)
            if n == 0:
                out.append(BAD)
                at += 1
            elif at + n > end:
                out.append(BAD)
                break
            elif any(x & 0xC0 != 0x80 for x in raw[at + 1 : at + n]):
                out.append(BAD)
                at += 1
            else:
                p = raw[at] if n == 1 else raw[at] & (0xFF >> n + 1)
                for x in raw[at + 1 : at + n]:
                    p = p << 6 | x & 0x3F
                out.append(chr(p) if p >= least[n] and valid_point(p) else BAD)
                at += n
        return "".join(out)
    try:
        return raw.decode(CODECS[name])
    except UnicodeDecodeError:
        pass
    order = "big" if name.endswith("be") else "little"
    width = 2 if name.startswith("utf16") else 4
    while at < end:
        if at + width > end:
            out.append(BAD)
            break
        p = int.from_bytes(raw[at : at + width], order)
        at += width
        if width == 2 and 0xD800 <= p <= 0xDBFF:
            low = int.from_bytes(raw[at : at + 2], order) if at + 2 <= end else 0
            if 0xDC00 <= low <= 0xDFFF:
                p = 0x10000 + (p - 0xD800 << 10) + low - 0xDC00
                at += 2
        out.append(chr(p) if valid_point(p) else BAD)
    return "".join(out)


def decode(b: Column, charset: str = "utf8") -> Column:
    """The text of any bytes; see decoded()."""
    name = known(charset)
    if name == "latin1":
        return F.decode(b, "ISO-8859-1")
    if name == "ascii":
        return F.regexp_replace(F.decode(b, "ISO-8859-1"), r"[\x80-\xFF]", BAD)

    @F.pandas_udf("string")
    def repaired(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else decoded(bytes(x), name))

    if name == "utf8":
        return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(repaired(b))
    return repaired(b)


def convert(b: Column, source: str, target: str) -> Column:
    """Bytes from one charset to another; the same charset copies them as they are."""
    return b if known(source) == known(target) else encode(decode(b, source), target)
