"""Logical indices: symbolic while nobody reads them, numbered without a single-task window when somebody does.

A stream knows its order by columns, not by numbers. Its index is described by
``Index``: the rank in that order or a stored column, times a sign, plus a
shift. Filters, limits and explodes only change the description; rows are
numbered once, where an operator asks for the numbers.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDX = "_idx"
VALUE = "value"
#: Rows up to which one sorted task numbers everything.
SMALL = 500_000
#: Rows that each numbering task should get, and the sample rows per task that its bounds are taken from.
PER_TASK, SAMPLED = 250_000, 32
MOST_TASKS = 10_000


@dataclass(frozen=True)
class Index:
    """sign * base + shift, where base is the rank in stream order, or the column ``_idx`` if ``stored``."""

    stored: bool = False
    sign: int = 1
    shift: int = 0

    @property
    def is_rank(self) -> bool:
        return not self.stored and self.sign == 1 and self.shift == 0

    def reversed(self) -> Index:
        return replace(self, sign=-self.sign, shift=-self.shift)

    def moved(self, k: int) -> Index:
        return replace(self, shift=self.shift + k)

    def column(self, base: Column) -> Column:
        return base * self.sign + self.shift


def descending(c: Column, kind: str) -> Column:
    """A value that rises where c, of the SQL type ``kind``, falls."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.bitwise_not(c)  # unlike the negative, there is one of the least number too
    if kind in ("float", "double") or kind.startswith("decimal"):
        return -c
    if kind == "boolean":
        return ~c
    if kind == "date":
        return F.bitwise_not(F.unix_date(c))
    if kind in ("timestamp", "timestamp_ntz"):
        return F.bitwise_not(F.unix_micros(c.cast("timestamp")))
    if kind in ("string", "binary"):
        # its bytes with all bits turned; the end of a text stands behind whatever goes on
        return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    raise ValueError(f"values of type {kind} have no descending order here")


def place_among(bounds: list[Column], x: Column) -> Column:
    """How many of the rising bounds are at most x: first among every so many of them, then among those between."""
    step = max(1, round(len(bounds) ** 0.5))
    count = lambda a: F.size(F.filter(a, lambda b: b <= x))
    if step == 1:
        return count(F.array(*bounds))
    coarse = count(F.array(*bounds[::step]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + count(F.slice(F.array(*bounds), (coarse - 1) * step + 1, F.lit(step))))


def ordering(order: tuple[str, ...]) -> Column:
    """The order columns as one comparable value."""
    return F.struct(*[F.col(c) for c in order])


def dense_index(df: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = (), name: str = IDX, small: int = SMALL) -> DataFrame:
    """df with the position 0.. of each row in the order of the columns ``order``, per group of ``by``.

    Up to ``small`` rows are numbered by one sorted task, or by a window for each
    group; beyond that, rows are cut into ranges at bounds taken from a sample
    (the rows of least hash, a bounded number), each range is numbered by its own
    task, and the counts before it are added. Equal orders fall in one range. The
    ranges and counts are literals of the plan, so a recomputed task numbers its
    rows alike. Many rows in groups are numbered together, group by group, less
    the number that their group starts with, so that no group is one task's work.
    """
    n = df.count()
    if by and n <= small:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
        return df.withColumn(name, rank.cast("long"))
    if by:
        whole = dense_index(df, (*by, *order), (), name, small)
        starts = whole.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min(name).alias("_start"))
        same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
        return whole.join(starts, same).withColumn(name, F.col(name) - F.col("_start")).select(*df.columns, name)
    if n <= small:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    tasks = min(MOST_TASKS, -(-n // PER_TASK))
    keys = df.select(*order)
    sample = keys.orderBy(F.xxhash64(*order), *order).limit(tasks * SAMPLED).orderBy(*order).collect()
    cuts = sorted({SAMPLED * k for k in range(1, tasks) if SAMPLED * k < len(sample)})
    types = dict(df.select(*order).dtypes)
    part = place_among([F.struct(*[F.lit(sample[c][o]).cast(types[o]).alias(o) for o in order]) for c in cuts], ordering(order))
    dealt = df.withColumn("_range", part)
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    before, total = [], 0
    for k in range(len(cuts) + 1):
        before.append(total)
        total += counts.get(k, 0)
    starts = F.array(*[F.lit(b).cast("long") for b in before])
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(name, rank + starts[F.col("_range")]).drop("_range")
