"""Texts, files, bytes and code points as streams."""

from __future__ import annotations

import sys

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import charset as charsets
from ..functions.text import bytes_of, split_all
from ..functions.text import code_points as points_of
from ..operators.stream import Stream
from ..plans.index import IDX, VALUE
from .generated import numbered


def one(spark: SparkSession, value: Column) -> Stream:
    return numbered(spark.range(1).select(F.lit(0).cast("long").alias(IDX), value.alias(VALUE)))


def exploded(spark: SparkSession, array: Column) -> Stream:
    return numbered(spark.range(1).select(F.posexplode(array).alias(IDX, VALUE)).select(F.col(IDX).cast("long").alias(IDX), VALUE))


def blob(spark: SparkSession, data: str | bytes, start: int | None = None, end: int | None = None) -> Stream:
    """One value per byte, 0 to 255, of a text's UTF-8 or of bytes; a slice is held to them and numbered from 0."""
    raw = data.encode() if isinstance(data, str) else bytes(data)
    part = raw[max(0, start or 0) : len(raw) if end is None else max(0, end)]
    return exploded(spark, bytes_of(F.lit(part)))


def text(spark: SparkSession, data: str, delimiter: str | None = None) -> Stream:
    """A whole text as one value, or its fields between a literal delimiter; an empty text has no fields."""
    if delimiter is None:
        return one(spark, F.lit(data))
    if not delimiter:
        raise ValueError("an empty delimiter splits nothing")
    s = exploded(spark, split_all(F.lit(data), F.lit(delimiter)))
    return s if data else s.limit(0)


def code_points(spark: SparkSession, data: str | bytes, start: int = 0, end: int | None = None, charset: str = "utf8") -> Stream:
    """One whole number per code point; bytes are decoded first."""
    whole = data if isinstance(data, str) else charsets.decoded(bytes(data), charset)
    return exploded(spark, points_of(F.lit(whole[max(0, start) : len(whole) if end is None else max(0, end)])))


def code_point_file(spark: SparkSession, path: str, charset: str = "utf8") -> Stream:
    """One whole number per code point of files in a charset, one file after another."""
    return text_file(spark, path, charset=charset).flat_map(points_of)


def standard_input(spark: SparkSession, delimiter: str | None = "\n", charset: str = "utf8", stream=None) -> Stream:
    """What the driver's standard input holds, whole, or its fields between a delimiter; a last field without content is none."""
    whole = charsets.decoded((stream or sys.stdin.buffer).read(), charset)
    return text(spark, whole, None) if delimiter is None else text(spark, whole.removesuffix(delimiter), delimiter)


def file_rows(df, columns: list[str]) -> Stream:
    """Rows of a file source in file order: by path, then by place, which a scan numbers without a shuffle."""
    rows = df.withColumn("_o0", F.col("_metadata.file_path")).withColumn("_o1", F.col("_metadata.file_block_start")).withColumn("_o2", F.monotonically_increasing_id())
    return Stream(rows.select("_o0", "_o1", "_o2", F.col(columns[0]).alias(VALUE)), ["_o0", "_o1", "_o2"])


def lines(spark: SparkSession, path: str) -> Stream:
    """One value per line of text files."""
    return file_rows(spark.read.text(path), ["value"])


def records(spark: SparkSession, path: str, delimiter: str) -> Stream:
    """One value per record of text files that end records with a delimiter."""
    return file_rows(spark.read.option("lineSep", delimiter).text(path), ["value"])


def text_file(spark: SparkSession, path: str, delimiter: str | None = None, charset: str = "utf8") -> Stream:
    """Whole files, decoded, as values; or their fields between a delimiter."""
    if charsets.known(charset) == "utf8":
        df = spark.read.text(path, wholetext=True)
    else:
        df = spark.read.format("binaryFile").load(path)
        df = df.withColumn("value", charsets.decode(F.col("content"), charset))
    s = Stream(df.select(F.input_file_name().alias("_o0"), F.col("value").alias(VALUE)), ["_o0"])
    if delimiter is None:
        return s
    if not delimiter:
        raise ValueError("an empty delimiter splits nothing")
    whole = F.lit(delimiter)
    return s.filter(lambda v: v != "").flat_map(lambda v: split_all(v, whole))
