"""Custom aggregates: identity, accumulator, combiner, finisher, and an optional stop."""

from __future__ import annotations

import functools
import inspect
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.index import IDX, VALUE


class Collector:
    """A fold over a stream.

    With Column functions (``columns=True``) it is one expression over each
    group's values in order, which stand in one row. With Python functions each
    range of the stream is folded to one state, and the states, one a range, are
    combined in order on the driver and finished there. A stop depends on all
    that came before, so with one, or without a combiner, the ranges are folded
    one after another, and the state goes from each to the next.
    """

    def __init__(self, identity: Callable, accumulate: Callable, combine: Callable | None = None, finish: Callable | None = None, interrupt: Callable | None = None, columns: bool = False):
        self.identity, self.accumulate, self.combine = identity, accumulate, combine
        self.finish, self.interrupt, self.columns = finish or (lambda x: x), interrupt, columns

    @classmethod
    def full(cls, identity, accumulate, combine=None, finish=None, columns=False) -> Collector:
        """Without a stop."""
        return cls(identity, accumulate, combine, finish, None, columns)

    @classmethod
    def shortable(cls, identity, interrupt, accumulate, combine=None, finish=None, columns=False) -> Collector:
        """interrupt(state, value, index) ends the fold before a value is taken."""
        return cls(identity, accumulate, combine, finish, interrupt, columns)

    def apply(self, over, name: str = "collected"):
        """A DataFrame for Column functions; the finished Python value otherwise."""
        return self._expression(over, name) if self.columns else self._folded(over)

    def _call(self, f: Callable, state, value, index):
        return f(state, value, index) if len(inspect.signature(f).parameters) >= 3 else f(state, value)

    def _expression(self, over, name: str) -> DataFrame:
        s = over.s.stored()
        rows = F.array_sort(F.collect_list(F.struct(*s.order, F.col(IDX).alias("_i"), F.col(VALUE).alias("_v"))))
        return s._per_key(s.df, self._over(rows).alias(name))

    def _over(self, rows: Column) -> Column:
        """The fold of an array of _i, _v."""
        start = self.identity()
        start = start if isinstance(start, Column) else F.lit(start)
        if self.interrupt is None:
            return F.reduce(rows, start, lambda a, x: self._call(self.accumulate, a, x["_v"], x["_i"]), self.finish)

        def step(a: Column, x: Column) -> Column:
            done = a["done"] | self._call(self.interrupt, a["state"], x["_v"], x["_i"])
            return F.struct(F.when(done, a["state"]).otherwise(self._call(self.accumulate, a["state"], x["_v"], x["_i"])).alias("state"), done.alias("done"))

        return F.reduce(rows, F.struct(start.alias("state"), F.lit(False).alias("done")), step, lambda a: self.finish(a["state"]))

    def of(self, values, name: str = "collected"):
        """The fold of an array Column, as a Column (with Column functions), or of any Python iterable, at once."""
        if isinstance(values, Column):
            indexed = F.transform(values, lambda v, i: F.struct(i.cast("long").alias("_i"), v.alias("_v")))
            return self._over(indexed).alias(name)
        state = self.identity()
        for i, v in enumerate(values):
            if self.interrupt is not None and self._call(self.interrupt, state, v, i):
                break
            state = self._call(self.accumulate, state, v, i)
        return self.finish(state)

    def _folded(self, over):
        if over.s.by:
            raise ValueError("a keyed stream is folded by Column functions")
        rows, order = over.s.numbered(), over.s.order
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("_part"), IDX, VALUE)
        if self.combine is None or self.interrupt is not None:
            return self.finish(self._in_turn(rows, n))
        me = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, part = me.identity(), None
            for pdf in batches:
                for part, i, v in zip(pdf["_part"], pdf[IDX], pdf[VALUE]):
                    state = me._call(me.accumulate, state, v, i)
            if part is not None:
                yield pd.DataFrame({"part": [int(part)], "state": [pickle.dumps(state)]})

        states = [pickle.loads(bytes(r["state"])) for r in rows.mapInPandas(run, "part long, state binary").orderBy("part").collect()]
        return self.finish(functools.reduce(self.combine, states) if states else self.identity())

    def _in_turn(self, rows: DataFrame, n: int):
        """The state after all ranges, each folded on the executors from the state that the one before has left; the ranges behind a stop are not folded."""
        me, state = self, self.identity()
        rows = rows.persist()
        try:
            for p in sorted(r["_part"] for r in rows.select("_part").distinct().collect()):
                given = pickle.dumps(state)

                def run(batches: Iterator[pd.DataFrame], given: bytes = given) -> Iterator[pd.DataFrame]:
                    state, some = pickle.loads(given), False
                    for pdf in batches:
                        for i, v in zip(pdf[IDX], pdf[VALUE]):
                            some = True
                            if me.interrupt is not None and me._call(me.interrupt, state, v, i):
                                yield pd.DataFrame({"state": [pickle.dumps(state)], "stopped": [True]})
                                return
                            state = me._call(me.accumulate, state, v, i)
                    if some:
                        yield pd.DataFrame({"state": [pickle.dumps(state)], "stopped": [False]})

                row = rows.where(F.col("_part") == p).mapInPandas(run, "state binary, stopped boolean").first()
                state = pickle.loads(bytes(row["state"]))
                if row["stopped"]:
                    break
        finally:
            rows.unpersist()
        return state
