"""The lazy stream: a DataFrame of values, the columns that order it, and a description of its index."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.index import IDX, SMALL, VALUE, Index, dense_index, ordering
from ..plans.index import descending as downwards


def arity(f: Callable) -> int:
    """How many of (value, index) a function takes."""
    try:
        kinds = [p for p in inspect.signature(f).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    except (TypeError, ValueError):
        return 1
    return 2 if len(kinds) >= 2 else 1


class Stream:
    """Values with logical indices. Every operator gives a new stream and runs nothing but, where rows must be numbered, a count.

    ``df`` has the column ``value``, the columns ``order`` that put rows in
    stream order (together unique), the columns ``by`` if the stream is one per
    key, and ``_idx`` if the index is stored. Functions get Columns and give
    Columns: f(value) or f(value, index).
    """

    def __init__(self, df: DataFrame, order: Iterable[str], index: Index | None = None, by: Iterable[str] = ()):
        self.df, self.order, self.index, self.by = df, tuple(order), index or Index(), tuple(by)

    @classmethod
    def of(cls, df: DataFrame, value: Column | str, order: Column | str | list, by: list[str] | str = ()) -> Stream:
        """A stream of any DataFrame: its value, what orders it (unique, per key if ``by`` is given), and its keys."""
        cols = order if isinstance(order, (list, tuple)) else [order]
        keys = [by] if isinstance(by, str) else list(by)
        named = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{k}") for k, c in enumerate(cols)]
        v = F.col(value) if isinstance(value, str) else value
        return cls(df.select(*keys, *named, v.alias(VALUE)), [f"_o{k}" for k in range(len(cols))], Index(), keys)

    # ---- plumbing

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def columns(self) -> list[str]:
        return [*self.by, *self.order]

    def _with(self, df: DataFrame, index: Index | None = None, order: Iterable[str] | None = None) -> Stream:
        return Stream(df, self.order if order is None else order, self.index if index is None else index, self.by)

    def numbered(self) -> DataFrame:
        """The rows with their index in ``_idx``."""
        if self.index.stored:
            return self.df.withColumn(IDX, self.index.column(F.col(IDX)))
        return dense_index(self.df, self.order, self.by).withColumn(IDX, self.index.column(F.col(IDX)))

    def positioned(self) -> DataFrame:
        """The rows with their position in stream order in ``_pos``, whatever their index."""
        return dense_index(self.df, self.order, self.by, "_pos")

    def stored(self) -> Stream:
        """The same stream, its index written out."""
        return self._with(self.numbered(), Index(stored=True))

    def _apply(self, f: Callable) -> tuple[Stream, Column]:
        """The stream to work on, and f's result there: numbered only if f asks for the index."""
        if arity(f) == 2:
            s = self.stored()
            return s, f(F.col(VALUE), F.col(IDX))
        return self, f(F.col(VALUE))

    def _dense(self, df: DataFrame, order: Iterable[str] | None = None) -> Stream:
        return self._with(df.drop(IDX), Index(), order)

    def _per_key(self, df: DataFrame, *aggs: Column) -> DataFrame:
        return df.groupBy(*self.by).agg(*aggs) if self.by else df.agg(*aggs)

    # ---- element by element

    def map(self, f: Callable) -> Stream:
        """f of each value; indices stay."""
        s, out = self._apply(f)
        return s._with(s.df.withColumn(VALUE, out))

    def redirect(self, f: Callable) -> Stream:
        """f(value, index) as the new value; indices stay."""
        return self.map(f)

    def reindex(self, f: Callable) -> Stream:
        """f(value, index) as the new index."""
        s = self.stored()
        return s._with(s.df.withColumn(IDX, f(F.col(VALUE), F.col(IDX)).cast("long")))

    def filter(self, p: Callable) -> Stream:
        """Values for which p holds, numbered anew; p sees the index before."""
        s, keep = self._apply(p)
        return s._dense(s.df.where(keep))

    def peek(self, consumer: Callable) -> Stream:
        """Calls consumer(value) or (value, index) on the executors as rows pass."""
        s = self.stored() if arity(consumer) == 2 else self
        both = arity(consumer) == 2

        def run(batches):
            for pdf in batches:
                for row in zip(pdf[VALUE], pdf[IDX]) if both else ((v,) for v in pdf[VALUE]):
                    consumer(*row)
                yield pdf

        return s._with(s.df.mapInPandas(run, s.df.schema))

    def observe(self, observation, *metrics: Column) -> Stream:
        """Metrics of the rows that pass, without a callback."""
        return self._with(self.df.observe(observation, *metrics))

    # ---- containers as values

    def flat_map(self, f: Callable) -> Stream:
        """The elements of the arrays f(value), in order, numbered anew."""
        s, out = self._apply(f)
        at = f"_o{len(s.order)}"
        return s._dense(s.df.select(*s.columns, F.posexplode(out).alias(at, VALUE)), [*s.order, at])

    def flat(self, f: Callable | None = None) -> Stream:
        """The elements of values that are arrays."""
        return self.flat_map(f or (lambda v: v))

    def distinct(self, key: Callable | None = None, compare: Callable | None = None) -> Stream:
        """The first of equal values, of values with equal keys, or of values between which compare(a, b) is 0, numbered anew; counted per task before the shuffle, but for a comparison, which see in sort()."""
        if compare is not None:
            whole = self._compared(compare)
            first = F.filter("_all", lambda x, i: (i == 0) | (compare(F.get("_all", F.greatest(i - 1, F.lit(0)))["_v"], x["_v"]) != 0))
            out = whole.select(*self.by, F.explode(first).alias("_x")).select(*self.by, F.col("_x._i").alias("_o0"), F.col("_x._v").alias(VALUE))
            return Stream(out, ["_o0"], Index(), self.by)
        k = (key or (lambda v: v))(F.col(VALUE))
        rows = self.df.drop(IDX).withColumn("_key", k)
        first = rows.groupBy(*self.by, "_key").agg(F.min_by(F.struct(*self.order, VALUE), ordering(self.order)).alias("_row"))
        return self._with(first.select(*self.by, "_row.*"), Index())

    # ---- by position

    def limit(self, n: int) -> Stream:
        """The first n values."""
        if self.by:
            return self._dense(self.positioned().where(F.col("_pos") < n).drop("_pos"))
        return self._dense(self.df.orderBy(*self.order).limit(max(0, n)))

    def sub(self, start: int, end: int) -> Stream:
        """Positions start up to end, which they keep as indices. Only the first ``end`` rows are put in order, where those are few."""
        if self.by or end > SMALL:
            return self._kept((F.col("_pos") >= start) & (F.col("_pos") < end))
        first = self.df.drop(IDX).orderBy(*self.order).limit(max(0, end))
        rows = first.withColumn(IDX, (F.row_number().over(Window.orderBy(*self.order)) - 1).cast("long"))
        return self._with(rows.where(F.col(IDX) >= start), Index(stored=True))

    def skip(self, n: int) -> Stream:
        """All but the first n; the rest keep their positions as indices. A few are found by their order alone, and nothing is numbered before somebody asks."""
        if self.by or not 0 < n <= SMALL:
            return self._kept(F.col("_pos") >= n)
        here = ordering(self.order)
        last = self.df.orderBy(*self.order).limit(n).agg(F.max(here)).scalar()
        return self._with(self.df.drop(IDX).where(here > last), Index(shift=n))

    def _kept(self, keep: Column) -> Stream:
        rows = self.positioned().where(keep)
        return self._with(rows.withColumn(IDX, F.col("_pos")).drop("_pos"), Index(stored=True))

    def _first_fail(self, p: Callable) -> tuple[Stream, DataFrame, Column]:
        s, ok = self._apply(p)
        here = ordering(s.order)
        failed = s.df.where(~F.coalesce(ok, F.lit(False)))
        if s.by:
            ends = failed.groupBy(*s.by).agg(F.min(here).alias("_end"))
            rows = s.df.join(ends, list(s.by), "left")
            return s, rows, F.col("_end")
        return s, s.df, failed.agg(F.min(here)).scalar()

    def take_while(self, p: Callable) -> Stream:
        """What stands before the first value that fails p; indices stay."""
        s, rows, end = self._first_fail(p)
        return s._with(rows.where(end.isNull() | (ordering(s.order) < end)).drop("_end"))

    def drop_while(self, p: Callable) -> Stream:
        """From the first value that fails p on, numbered anew."""
        s, rows, end = self._first_fail(p)
        return s._dense(rows.where(end.isNotNull() & (ordering(s.order) >= end)).drop("_end"))

    # ---- index arithmetic

    def reverse(self) -> Stream:
        """Indices change sign; rows stay where they are until to_ordered()."""
        return self._with(self.df, self.index.reversed())

    def translate(self, k: int) -> Stream:
        """Indices move by k."""
        return self._with(self.df, self.index.moved(k))

    # ---- several streams

    def concatenate(self, other) -> Stream:
        """This stream, then another: a stream, a list of values, or a single value; numbered anew."""
        kind = self.df.schema[VALUE].dataType
        if not isinstance(other, Stream):
            if self.by:
                raise ValueError("a keyed stream can only be followed by a stream")
            values = list(other) if isinstance(other, (list, tuple, set, frozenset, range)) else [other]
            rows = self.spark.createDataFrame(list(enumerate(values)), "_o0 long, value " + kind.simpleString())
            other = Stream(rows, ["_o0"])
        a, b = self, other
        types = lambda s: [t for c, t in s.df.select(*s.order).dtypes]
        if types(a) != types(b):
            a, b = (Stream(s.positioned().select(*s.by, F.col("_pos").alias("_o0"), VALUE), ["_o0"], Index(), s.by) for s in (a, b))
        names = [f"_o{k + 1}" for k in range(len(a.order))]
        parts = [s.df.select(*s.by, F.lit(k).alias("_o0"), *[F.col(c).alias(n) for c, n in zip(s.order, names)], VALUE) for k, s in enumerate((a, b))]
        return Stream(parts[0].unionAll(parts[1]), ["_o0", *names], Index(), self.by)

    # ---- physical hints

    def parallel(self, n: int | None = None) -> Stream:
        """Asks for n partitions; no result depends on it."""
        return self._with(self.df.repartition(max(1, n or 1)))

    @property
    def concurrency(self) -> int:
        return self.df.rdd.getNumPartitions()

    # ---- materialisations

    def to_unordered(self):
        from .ordered import Unordered

        return Unordered(self)

    def to_ordered(self):
        """Sorted by index modulo the number of elements, then by stream order."""
        from .ordered import Ordered

        return Ordered(self.normalised())

    def normalised(self) -> Stream:
        """The stream in the order of its index modulo its size. Nothing is to be done where the index is the rank."""
        if self.index.is_rank:
            return self
        rows = self.numbered()
        if self.by:
            rows = rows.join(self.df.groupBy(*self.by).agg(F.count("*").alias("_n")), list(self.by))
            n = F.col("_n")
        else:
            n = self.df.agg(F.count("*")).scalar()
        rows = rows.withColumn("_norm", F.pmod(F.col(IDX), n))
        names = [f"_p{k}" for k in range(len(self.order))]
        rows = rows.select(*self.by, F.col("_norm").alias("_o0"), *[F.col(c).alias(x) for c, x in zip(self.order, names)], F.col("_norm").alias(IDX), VALUE)
        return Stream(rows, ["_o0", *names], Index(stored=True), self.by)

    def sort(self, key: Callable | None = None, descending: bool = False, compare: Callable | None = None):
        """Ordered by value, by key(value), or by compare(a, b), a Column that is negative where a goes first; equals keep their order. Numbered anew.

        A comparison says nothing of a value alone, so all values of the stream,
        or of a key, stand in one row for it; a key has no such bound.
        """
        from .ordered import Ordered

        if compare is not None:
            return Ordered(self.by_comparison(compare))
        k = (key or (lambda v: v))(F.col(VALUE))
        if descending:  # an order is ascending throughout
            k = downwards(k, dict(self.df.select(k.alias("k")).dtypes)["k"])
        names = [f"_p{j}" for j in range(len(self.order))]
        rows = self.df.select(*self.by, k.alias("_o0"), *[F.col(c).alias(x) for c, x in zip(self.order, names)], VALUE)
        return Ordered(Stream(rows, ["_o0", *names], Index(), self.by))

    def by_comparison(self, compare: Callable) -> Stream:
        """In the order of compare(a, b); equals keep theirs."""
        out = self._compared(compare).select(*self.by, F.posexplode(F.transform("_all", lambda x: x["_v"])).alias("_o0", VALUE))
        return Stream(out, ["_o0"], Index(), self.by)

    def _compared(self, compare: Callable) -> DataFrame:
        """A row, or one per key, whose ``_all`` holds the values, and their places before, in the order of compare(a, b)."""
        rows = F.array_sort(F.collect_list(F.struct(*self.order, F.col(VALUE).alias("_v"))))
        numbered = F.transform(rows, lambda x, i: F.struct(i.alias("_i"), x["_v"].alias("_v")))

        def goes_first(a: Column, b: Column) -> Column:
            c = compare(a["_v"], b["_v"]).cast("int")
            return F.when(c == 0, F.when(a["_i"] < b["_i"], -1).otherwise(1)).otherwise(c)

        return self._per_key(self.df, numbered.alias("_all")).withColumn("_all", F.array_sort("_all", goes_first))

    def to_window(self):
        from .windows import Windowed

        return Windowed(self.normalised())

    def to_statistics(self):
        from .stats import Statistics

        return Statistics(self.normalised())

    def rows(self) -> DataFrame:
        """by columns, _idx, value."""
        return self.numbered().select(*self.by, IDX, VALUE)
