"""Count windows over stream positions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.index import IDX, VALUE
from .ordered import Ordered
from .stream import Stream


class Windowed(Ordered):
    """A materialised stream that can be cut into windows by position."""

    def slide(self, size: int, step: int) -> Windows:
        """Windows of ``size`` positions, one every ``step`` of them; those at the end may be short."""
        if step <= 0:
            raise ValueError("a window moves on by 1 at least")
        rows = self.s.positioned()
        pos = F.col("_pos")
        first = F.greatest(F.lit(0), F.ceil((pos - size + 1) / step)).cast("long")
        last = F.floor(pos / step).cast("long")
        if size == step:
            out = rows.withColumn("_win", last)
        else:
            out = rows.where((first <= last) & F.lit(size > 0)).withColumn("_win", F.explode(F.when(first <= last, F.sequence(first, last))))
        return Windows(out.withColumn(IDX, pos - F.col("_win") * step).drop("_pos"), self.s.by, (rows, size, step))

    def tumble(self, size: int) -> Windows:
        return self.slide(size, size)


class Windows:
    """Rows of windows: by columns, _win, _idx in the window, value."""

    def __init__(self, df: DataFrame, by: tuple[str, ...], cut: tuple[DataFrame, int, int]):
        self.df, self.by, self.cut = df, tuple(by), cut

    def agg(self, *columns: Column) -> DataFrame:
        """Aggregates of ``value`` per window."""
        return self.df.groupBy(*self.by, "_win").agg(*columns)

    def summary(self) -> DataFrame:
        """count, sum, average, minimum, maximum per window. Rows are summed up once, in panes as long as the greatest common divisor of size and step; only panes are dealt to all their windows."""
        rows, size, step = self.cut
        pane = math.gcd(max(0, size), step)
        at = F.col("_pane") * pane
        panes = rows.groupBy(*self.by, F.floor(F.col("_pos") / pane).cast("long").alias("_pane")).agg(F.count(VALUE).alias("_n"), F.sum(VALUE).alias("_s"), F.min(VALUE).alias("_low"), F.max(VALUE).alias("_high"))
        first = F.greatest(F.lit(0), F.ceil((at + pane - size) / step)).cast("long")
        last = F.floor(at / step).cast("long")
        dealt = panes.where((first <= last) & F.lit(size > 0)).withColumn("_win", F.explode(F.when(first <= last, F.sequence(first, last))))
        out = dealt.groupBy(*self.by, "_win").agg(F.sum("_n").alias("count"), F.sum("_s").alias("sum"), F.min("_low").alias("minimum"), F.max("_high").alias("maximum"))
        return out.select(*self.by, "_win", "count", "sum", (F.col("sum") / F.col("count")).alias("average"), "minimum", "maximum")

    def values(self, name: str = "values") -> DataFrame:
        """_win and its values in order."""
        return self.agg(F.transform(F.array_sort(F.collect_list(F.struct(IDX, VALUE))), lambda x: x[VALUE]).alias(name))

    def stream(self) -> Stream:
        """A stream of windows: each value is the array of a window's values."""
        v = self.values(VALUE)
        return Stream(v.select(*self.by, F.col("_win").alias("_o0"), VALUE), ["_o0"], by=self.by)

    def inner(self) -> Stream:
        """The windows as one keyed stream, so that every operator and terminal works per window."""
        return Stream(self.df.select(*self.by, "_win", F.col(IDX).alias("_o0"), VALUE), ["_o0"], by=(*self.by, "_win"))

    def map(self, f: Callable[[Ordered], DataFrame]) -> DataFrame:
        """f of each window as a materialised stream, e.g. lambda w: w.to_statistics().average()."""
        return f(self.inner())

    def flat(self) -> Stream:
        """The windows' values one after another."""
        return Stream(self.df.select(*self.by, F.col("_win").alias("_o0"), F.col(IDX).alias("_o1"), VALUE), ["_o0", "_o1"], by=self.by)


__all__ = ["Windowed", "Windows"]
