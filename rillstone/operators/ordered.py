"""Materialised streams and their terminals.

A terminal is one aggregation: it gives a DataFrame of one row, or of one row
per key of a keyed stream, with a column of the name asked for. ``value()`` of
that row is the driver's result. Containers hold whole streams (or groups), as
the callers of those terminals ask for them; everything else is aggregated with
map-side partial results.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_text
from ..plans.index import IDX, VALUE, descending, ordering
from .stream import Stream, arity


#: Values that a combined fold takes in one run.
CHUNK = 10_000


def value(df: DataFrame):
    """The single value of a one-row result; None if there is no row."""
    row = df.first()
    return None if row is None else row[-1]


class Unordered:
    """A materialised stream without an order of its own; terminals that need one use the stream's."""

    def __init__(self, stream: Stream):
        self.s = stream

    def stream(self) -> Stream:
        """Back to a lazy stream."""
        return self.s

    source = stream

    def cache(self):
        self.s = self.s._with(self.s.df.cache())
        return self

    def rows(self) -> DataFrame:
        return self.s.rows()

    # ---- helpers

    def _agg(self, out: Column, name: str, df: DataFrame | None = None) -> DataFrame:
        return self.s._per_key(self.s.df if df is None else df, out.alias(name))

    def _apply(self, f: Callable | None) -> tuple[DataFrame, Column]:
        if f is None:
            return self.s.df, F.col(VALUE)
        s, out = self.s._apply(f)
        return s.df, out

    def _listed(self, of: Column | None = None) -> Column:
        """All values in stream order."""
        of = F.col(VALUE) if of is None else of
        return F.transform(F.array_sort(F.collect_list(F.struct(*self.s.order, of.alias("_v")))), lambda x: x["_v"])

    # ---- match

    def all_match(self, p: Callable, name: str = "all_match") -> DataFrame:
        df, ok = self._apply(p)
        return self._agg(F.coalesce(F.bool_and(ok), F.lit(True)), name, df)

    def any_match(self, p: Callable, name: str = "any_match") -> DataFrame:
        df, ok = self._apply(p)
        return self._agg(F.coalesce(F.bool_or(ok), F.lit(False)), name, df)

    def none_match(self, p: Callable, name: str = "none_match") -> DataFrame:
        df, ok = self._apply(p)
        return self._agg(~F.coalesce(F.bool_or(ok), F.lit(False)), name, df)

    # ---- count and find

    def count(self, name: str = "count") -> DataFrame:
        return self._agg(F.count("*"), name)

    def empty(self, name: str = "empty") -> DataFrame:
        return self._agg(F.count("*") == 0, name)

    def find_first(self, name: str = "found") -> DataFrame:
        return self._agg(F.min_by(VALUE, ordering(self.s.order)), name)

    def find_last(self, name: str = "found") -> DataFrame:
        return self._agg(F.max_by(VALUE, ordering(self.s.order)), name)

    def find_any(self, name: str = "found") -> DataFrame:
        """Some value, always, if there is one."""
        return self._agg(F.any_value(VALUE), name)

    def find_at(self, k: int, name: str = "found") -> DataFrame:
        """The value of index k; from the end, and around it, if k is negative."""
        if k >= 0:
            rows = self.s.numbered()
            return self._agg(F.min_by(F.when(F.col(IDX) == k, F.col(VALUE)), F.when(F.col(IDX) == k, ordering(self.s.order))), name, rows)
        rows = self.s.positioned()
        if self.s.by:
            rows = rows.join(self.s.df.groupBy(*self.s.by).agg(F.count("*").alias("_n")), list(self.s.by))
            n = F.col("_n")
        else:
            n = self.s.df.agg(F.count("*")).scalar()
        hit = F.col("_pos") == F.pmod(F.lit(k).cast("long"), n)
        return self._agg(F.max_by(F.when(hit, F.col(VALUE)), F.when(hit, F.lit(1))), name, rows)

    def find_maximum(self, key: Callable | None = None, name: str = "found", compare: Callable | None = None) -> DataFrame:
        """The value of the largest key, or the largest by compare(a, b), see sort(); the first of equals. Null keys are passed over."""
        if compare is not None:
            return Ordered(self.s.by_comparison(lambda a, b: compare(b, a))).find_first(name)
        df, k = self._apply(key)
        return self._extreme(df, k, True, name)

    def find_minimum(self, key: Callable | None = None, name: str = "found", compare: Callable | None = None) -> DataFrame:
        if compare is not None:
            return Ordered(self.s.by_comparison(compare)).find_first(name)
        df, k = self._apply(key)
        return self._extreme(df, k, False, name)

    def _extreme(self, df: DataFrame, k: Column, largest: bool, name: str) -> DataFrame:
        """One aggregation with partial results: the least, or largest, of the key and the order after it."""
        return self.s._per_key(df, self._extreme_of(df, k, largest).alias(name))

    def _extreme_of(self, df: DataFrame, k: Column, largest: bool) -> Column:
        kinds = dict(df.dtypes)
        order = [descending(F.col(c), kinds[c]).alias(c) if largest else F.col(c) for c in self.s.order]
        by = F.when(k.isNotNull(), F.struct(k.alias("_k"), *order))
        return (F.max_by if largest else F.min_by)(F.struct(VALUE), by)[VALUE]

    def ends(self, key: Callable | None = None) -> DataFrame:
        """first, last, smallest, largest: what find_first, find_last, find_minimum and find_maximum find, in one aggregation."""
        df, k = self._apply(key)
        here = ordering(self.s.order)
        return self.s._per_key(df, F.min_by(VALUE, here).alias("first"), F.max_by(VALUE, here).alias("last"), self._extreme_of(df, k, False).alias("smallest"), self._extreme_of(df, k, True).alias("largest"))

    def matches(self, **tests: tuple[str, Callable]) -> DataFrame:
        """A column for each test, in one aggregation: name=("all" | "any" | "none", predicate of the value)."""
        of = {"all": lambda p: F.coalesce(F.bool_and(p), F.lit(True)), "any": lambda p: F.coalesce(F.bool_or(p), F.lit(False)), "none": lambda p: ~F.coalesce(F.bool_or(p), F.lit(False))}
        return self.s._per_key(self.s.df, *[of[kind](p(F.col(VALUE))).alias(name) for name, (kind, p) in tests.items()])

    # ---- sums

    def summate(self, f: Callable | None = None, name: str = "sum") -> DataFrame:
        df, v = self._apply(f)
        return self._agg(F.coalesce(F.sum(v), F.lit(0)), name, df)

    def average(self, f: Callable | None = None, name: str = "average") -> DataFrame:
        df, v = self._apply(f)
        return self._agg(F.coalesce(F.avg(v), F.lit(0.0)), name, df)

    def range(self, f: Callable | None = None, name: str = "range") -> DataFrame:
        df, v = self._apply(f)
        return self._agg(F.coalesce(F.max(v) - F.min(v), F.lit(0)), name, df)

    def minimum(self, f: Callable | None = None, name: str = "minimum") -> DataFrame:
        df, v = self._apply(f)
        return self._agg(F.min(v), name, df)

    def maximum(self, f: Callable | None = None, name: str = "maximum") -> DataFrame:
        df, v = self._apply(f)
        return self._agg(F.max(v), name, df)

    # ---- folds

    def reduce(self, op: Callable, identity=None, finish: Callable | None = None, name: str = "reduced", combine: Callable | None = None) -> DataFrame:
        """A left fold in stream order with op(state, value); without an identity the first value begins, and an empty stream gives null.

        The values of a stream, or of a key, stand in one row for it. With
        combine(state, state) only CHUNK of them do: runs of so many are folded
        wherever they are, each from the identity, and their states combined in order.
        """
        if combine is not None:
            rows = self.s.positioned().withColumn("_chunk", F.floor(F.col("_pos") / CHUNK).cast("long"))
            runs = Ordered(Stream(rows, self.s.order, by=(*self.s.by, "_chunk"))).reduce(op, identity, name=VALUE)
            states = Ordered(Stream(runs.withColumnRenamed("_chunk", "_o0"), ["_o0"], by=self.s.by))
            return states.reduce(combine, identity, finish, name)
        listed = self._listed()
        fold, end = (lambda a, x: op(a, x)), finish or (lambda x: x)
        if identity is not None:
            start = identity if isinstance(identity, Column) else F.lit(identity)
            out = F.reduce(listed, start, fold, end)
        else:
            out = F.when(F.size(listed) > 0, F.reduce(F.slice(listed, 2, F.greatest(F.size(listed) - 1, F.lit(0))), listed[0], fold, end))
        return self._agg(out, name)

    def collect(self, collector, name: str = "collected") -> DataFrame:
        """A Collector over the stream."""
        return collector.apply(self, name)

    # ---- containers

    def to_vector(self, name: str = "values") -> DataFrame:
        return self._agg(self._listed(), name)

    to_list = to_deque = to_forward_list = to_queue = to_vector

    def to_array(self, n: int, name: str = "values") -> DataFrame:
        """n slots by index; null where no index is, larger indices left out."""
        rows = self.s.numbered().where((F.col(IDX) >= 0) & (F.col(IDX) < n))
        slot = F.map_from_entries(F.collect_list(F.struct(IDX, "_last")))
        last = rows.groupBy(*self.s.by, IDX).agg(F.max_by(VALUE, ordering(self.s.order)).alias("_last"))
        return self.s._per_key(last, slot.alias("_m")).select(*self.s.by, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("_m")[k.cast("long")]).alias(name)) if n > 0 else self._agg(F.expr("array()"), name)

    def to_set(self, name: str = "values") -> DataFrame:
        return self._agg(F.array_sort(F.collect_set(VALUE)), name)

    def to_unordered_set(self, name: str = "values") -> DataFrame:
        return self._agg(F.collect_set(VALUE), name)

    def to_multiset(self, name: str = "values") -> DataFrame:
        return self._agg(F.array_sort(F.collect_list(VALUE)), name)

    def to_unordered_multiset(self, name: str = "values") -> DataFrame:
        return self._agg(F.collect_list(VALUE), name)

    def to_stack(self, name: str = "values") -> DataFrame:
        """Last in, first out."""
        return self._agg(F.reverse(self._listed()), name)

    def to_priority_queue(self, name: str = "values") -> DataFrame:
        """Largest first."""
        return self._agg(F.sort_array(F.collect_list(VALUE), asc=False), name)

    # ---- maps and groups, as rows: key, value(s)

    def _keyed(self, key: Callable, of: Callable | None) -> tuple[DataFrame, Column, Column]:
        s = self.s.stored() if arity(key) == 2 or (of and arity(of) == 2) else self.s
        call = lambda f: f(F.col(VALUE), F.col(IDX)) if arity(f) == 2 else f(F.col(VALUE))
        return s.df, call(key), call(of) if of else F.col(VALUE)

    def map_rows(self, key: Callable, of: Callable | None = None) -> DataFrame:
        """key, value with the last value of each key; the distributed form of to_map."""
        df, k, v = self._keyed(key, of)
        return df.groupBy(*self.s.by, k.alias("key")).agg(F.max_by(v, ordering(self.s.order)).alias("value"))

    def to_map(self, key: Callable, of: Callable | None = None, name: str = "map") -> DataFrame:
        rows = self.map_rows(key, of)
        return self.s._per_key(rows, F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name))

    to_unordered_map = to_map

    def group_by(self, key: Callable, of: Callable | None = None, name: str = "values") -> DataFrame:
        """key, values in stream order."""
        df, k, v = self._keyed(key, of)
        return df.groupBy(*self.s.by, k.alias("key")).agg(self._listed(v).alias(name))

    def group(self, key: Callable, name: str = "values") -> DataFrame:
        return self.group_by(key, None, name)

    def to_multimap(self, key: Callable, of: Callable | None = None, name: str = "values") -> DataFrame:
        return self.group_by(key, of, name)

    to_unordered_multimap = to_multimap

    def partition(self, size: int, name: str = "values") -> DataFrame:
        """chunk, values: runs of ``size`` positions; single values if it is 1 or less."""
        rows = self.s.positioned().withColumn("chunk", F.floor(F.col("_pos") / max(1, size)).cast("long"))
        return rows.groupBy(*self.s.by, "chunk").agg(self._listed().alias(name))

    def partition_by(self, key: Callable, of: Callable | None = None, name: str = "values") -> DataFrame:
        """key, values: one chunk per whole-number key; sort by key for the chunks' order."""
        df, k, v = self._keyed(key, of)
        return df.groupBy(*self.s.by, k.cast("long").alias("key")).agg(self._listed(v).alias(name))

    # ---- text

    def join(self, delimiter: str = ",", prefix: str = "[", suffix: str = "]", convert: Callable | None = None, name: str = "joined") -> DataFrame:
        """The values' texts between prefix and suffix. Empty texts before the first other one leave no delimiter."""
        df, v = self._apply(convert)
        kind = dict(df.select(v.alias("v")).dtypes)["v"]
        listed = self._listed(number_text(v, kind))
        first = F.array_position(F.transform(listed, lambda x: x != ""), True)
        body = F.when(first > 0, F.array_join(F.slice(listed, F.greatest(first.cast("int"), F.lit(1)), F.greatest(F.size(listed), F.lit(1))), delimiter)).otherwise("")
        return self._agg(F.concat(F.lit(prefix), body, F.lit(suffix)), name, df)

    def out(self, *args, file=None, **kw) -> str:
        """Prints join() on the driver and returns it."""
        text = value(self.join(*args, **kw))
        print(text, file=file or sys.stdout)
        return text

    def error(self, *args, **kw) -> None:
        self.out(*args, file=sys.stderr, **kw)

    def for_each(self, consumer: Callable) -> None:
        """Calls consumer(value) or (value, index) on the executors."""
        both = arity(consumer) == 2
        df = self.s.numbered().select(VALUE, IDX) if both else self.s.df.select(VALUE)
        df.foreach(lambda row: consumer(*row))

    def for_each_partition(self, consumer: Callable) -> None:
        self.s.df.select(VALUE).foreachPartition(lambda rows: consumer(row[0] for row in rows))


class Ordered(Unordered):
    """A materialised stream in the order of its index."""

    def sorted_rows(self) -> DataFrame:
        return self.s.rows().orderBy(*self.s.by, IDX)
