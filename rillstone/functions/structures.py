"""Order and hash of nested values, alike for values that are equal as containers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(v: Column, kind: T.DataType, unordered: bool = False) -> Column:
    """A value that compares and hashes by content: maps as sorted entries, unordered containers sorted, nested ones within."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(canonical(e["key"], kind.keyType).alias("key"), canonical(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(v), entry))
    if isinstance(kind, T.ArrayType):
        items = F.transform(v, lambda x: canonical(x, kind.elementType)) if nested(kind.elementType) else v
        return F.array_sort(items) if unordered else items
    if isinstance(kind, T.StructType) and nested(kind):
        return F.struct(*[canonical(v[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return v


def nested(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(nested(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.ArrayType))


def structural_hash(v: Column, kind: T.DataType, unordered: bool = False) -> Column:
    """64 bits that equal containers share."""
    return F.xxhash64(canonical(v, kind, unordered))


def less(a: Column, b: Column, kind: T.DataType, unordered: bool = False) -> Column:
    """a before b: field by field, element by element, null first."""
    x, y = F.struct(canonical(a, kind, unordered).alias("v")), F.struct(canonical(b, kind, unordered).alias("v"))
    return x < y


def buffer_order(b: Column) -> Column:
    """Byte buffers go by length, then by bytes."""
    return F.struct(F.octet_length(b).alias("length"), b.alias("bytes"))


def variant_order(tag: Column, *alternatives: Column) -> Column:
    """A tagged union goes by tag, then by value."""
    return F.struct(tag.alias("tag"), *[a.alias(f"v{k}") for k, a in enumerate(alternatives)])


def bits_order(bits: Column, width: int) -> Column:
    """Bit sets of one width go by their highest bits first."""
    return F.lpad(F.bin(bits), width, "0")


def complex_order(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))
