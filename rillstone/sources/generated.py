"""Ranges, literals, iterations, random values."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.stream import Stream
from ..plans.index import IDX, VALUE, Index


def numbered(df) -> Stream:
    """A stream of rows with a dense _idx: its numbers are known, so none are ever counted."""
    return Stream(df.select(F.col(IDX).alias("_o0"), IDX, VALUE), ["_o0"], Index(stored=True))


def counted(spark: SparkSession, n: int, value: Callable[[Column], Column]) -> Stream:
    return numbered(spark.range(max(0, n)).select(F.col("id").alias(IDX), value(F.col("id")).alias(VALUE)))


def from_range(spark: SparkSession, start, end, step=None) -> Stream:
    """start up to but without end. Without a step the bounds may come in either order; a step of 0, or away from end, gives nothing."""
    if step is None:
        start, end, step = min(start, end), max(start, end), 1
    n = 0 if step == 0 else max(0, math.ceil((end - start) / step))
    return counted(spark, n, lambda i: F.lit(start) + i * F.lit(step))


def from_range_closed(spark: SparkSession, start, end, step=None) -> Stream:
    """start up to and with end."""
    if step is None:
        start, end, step = min(start, end), max(start, end), 1
    n = 0 if step == 0 else max(0, math.floor((end - start) / step) + 1)
    return counted(spark, n, lambda i: F.lit(start) + i * F.lit(step))


def empty(spark: SparkSession, kind: str = "long") -> Stream:
    return numbered(spark.createDataFrame([], f"{IDX} long, {VALUE} {kind}"))


def of(spark: SparkSession, *values, kind: str | None = None) -> Stream:
    """Literal values, or those of one list; ``kind`` is their SQL type where it cannot be seen from them."""
    listed = list(values[0]) if len(values) == 1 and isinstance(values[0], Iterable) and not isinstance(values[0], (str, bytes, dict)) else list(values)
    if not listed:
        return empty(spark, kind or "long")
    rows = list(enumerate(listed))
    return numbered(spark.createDataFrame(rows, f"{IDX} long, {VALUE} {kind}" if kind else [IDX, VALUE]))


def repeat(spark: SparkSession, value, n: int) -> Stream:
    return counted(spark, n, lambda _: F.lit(value))


class Unbounded:
    """A rule for an endless stream, and the operators that follow it. limit(n), sub, take_while and find_first bound it; it cannot be run before.

    ``make(n)`` is the stream of the rule's first n values. Operators that keep
    every value need no more of them than are asked for; with others the rule is
    drawn on for twice as many until there are enough, ``most`` at most.
    """

    #: Operators that give one value for each.
    EACH = ("map", "redirect", "peek", "observe")
    #: Operators that may drop values, or make more of them; their first results follow from the first values.
    SOME = ("filter", "flat_map", "flat", "distinct", "skip", "drop_while")

    def __init__(self, spark: SparkSession, make: Callable[[int], Stream], steps: tuple = (), most: int = 1 << 30):
        self.spark, self.make, self.steps, self.most = spark, make, steps, most

    def __getattr__(self, name: str):
        if name in self.EACH + self.SOME:
            return lambda *a, **k: Unbounded(self.spark, self.make, (*self.steps, (name, a, k)), self.most)
        if name.startswith("__"):
            raise AttributeError(name)
        raise ValueError(f"an endless stream must be bounded by limit, sub, take_while or find_first before {name}")

    def _first(self, n: int) -> Stream:
        out = self.make(n)
        for name, a, k in self.steps:
            out = getattr(out, name)(*a, **k)
        return out

    def _until(self, n: int, enough: Callable[[Stream], Stream | None]) -> Stream:
        while n <= self.most:
            out = enough(self._first(n))
            if out is not None:
                return out
            n *= 2
        raise ValueError(f"the first {self.most} values are not enough")

    def limit(self, n: int) -> Stream:
        """The first n values of all operators so far."""
        n = max(0, n)
        if n == 0 or all(name in self.EACH for name, _, _ in self.steps):
            return self._first(n).limit(n)
        return self._until(max(16, n), lambda s: s.limit(n) if s.df.limit(n).count() >= n else None)

    def sub(self, start: int, end: int) -> Stream:
        return self.limit(end).sub(start, end)

    def take_while(self, p: Callable, first: int = 16) -> Stream:
        """The values before the first that fails p."""

        def enough(s: Stream) -> Stream | None:
            out = s.take_while(p)
            return out if out.df.count() < s.df.count() else None

        return self._until(first, enough)

    def find_first(self, name: str = "found"):
        """The first value, as a DataFrame of one row."""
        return self.limit(1).to_ordered().find_first(name)


def infinite(spark: SparkSession) -> Unbounded:
    """0, 1, 2, ... without an end."""
    return Unbounded(spark, lambda n: counted(spark, n, lambda i: i))


#: Values of a chain that are made in one go.
CHAIN = 512


def iterate(spark: SparkSession, seed, f: Callable[[Column], Column], limit: int | None = None):
    """seed, f(seed), f(f(seed)) ... where f takes and gives a Column. Endless without a limit.

    The chain is followed once to every CHAIN-th value, which are rows then; each
    row makes the values up to the next, wherever it is.
    """

    def make(n: int) -> Stream:
        kind = spark.range(1).select(F.lit(seed).alias(VALUE)).dtypes[0][1]
        # no value beyond the n-th is worked out, as it may not exist
        grown = lambda first, g, most, times: F.reduce(F.slice(F.sequence(F.lit(1), F.lit(max(1, most))), F.lit(1), times), F.array(first), lambda s, _: F.array_append(s, g(F.element_at(s, -1))))
        leap = lambda v: F.reduce(F.sequence(F.lit(1), F.lit(CHAIN)), v, lambda x, _: f(x).cast(kind))
        leaps = max(0, -(-n // CHAIN) - 1)
        heads = spark.range(1).select(F.posexplode(grown(F.lit(seed).cast(kind), leap, leaps, F.lit(leaps))).alias("_head", "_v"))
        rows = heads.repartition("_head") if leaps else heads
        left = F.least(F.lit(CHAIN - 1), F.greatest(F.lit(0), F.lit(n - 1) - F.col("_head") * CHAIN)).cast("int")
        rows = rows.select("_head", F.posexplode(grown(F.col("_v"), lambda v: f(v).cast(kind), CHAIN - 1, left)).alias("_at", VALUE))
        return numbered(rows.select((F.col("_head").cast("long") * CHAIN + F.col("_at")).alias(IDX), VALUE).where(F.col(IDX) < n))

    return make(max(0, limit)) if limit is not None else Unbounded(spark, make)


def generate(spark: SparkSession, supplier: Callable[[], Column] | Callable[[], object], limit: int | None = None):
    """supplier() per element: a Column expression, or a Python function that is called on the executors once for each, by Arrow batches."""

    def make(n: int) -> Stream:
        made = supplier()
        if isinstance(made, Column):
            return counted(spark, n, lambda _: made)
        kind = spark.createDataFrame([(made,)], ["v"]).dtypes[0][1]

        @F.pandas_udf(kind)
        def supplied(i: pd.Series) -> pd.Series:
            return pd.Series([supplier() for _ in range(len(i))])

        return counted(spark, n, lambda i: supplied.asNondeterministic()(i))

    return make(limit) if limit is not None else Unbounded(spark, make)


def random_values(spark: SparkSession, low=None, high=None, count: int | None = None, seed: int | None = None):
    """Uniform values: whole numbers of [low, high], reals of [low, high), bounds in either order; without bounds, whole numbers from 0 to 2^31 - 1."""
    if low is None:
        low, high = 0, (1 << 31) - 1
    low, high = min(low, high), max(low, high)
    u = F.rand(random.getrandbits(62) if seed is None else seed)  # a stream's values are the same whenever it is read
    whole = isinstance(low, int) and isinstance(high, int)
    value = F.least((F.lit(low) + F.floor(u * (high - low + 1))).cast("long"), F.lit(high)) if whole else F.lit(float(low)) + u * float(high - low)

    def make(n: int) -> Stream:
        return counted(spark, n, lambda _: value)

    return make(count) if count is not None else Unbounded(spark, make)


def randomly(low=None, high=None):
    """One uniform value on the driver; without bounds, a fair coin."""
    if low is None:
        return random.random() < 0.5
    low, high = min(low, high), max(low, high)
    return random.randint(low, high) if isinstance(low, int) and isinstance(high, int) else random.uniform(low, high)
