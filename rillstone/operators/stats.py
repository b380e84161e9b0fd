"""Statistics and signal transforms of a materialised stream."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.index import IDX, VALUE
from .ordered import Ordered

#: Values up to which a transform is made in one task; longer ones are cut into two rounds of short ones.
ONE_TASK = 1 << 16
#: Parameters that a descent on the driver may have.
PARAMETERS = 100_000
#: Rows of an unkeyed stream up to which one aggregation holds all value counts; beyond it, the rank is closed in on.
COUNTED = 500_000
#: Parts that a range of values is cut into at once.
BINS = 1024


def variance_of(v: Column) -> Column:
    return F.coalesce(F.var_pop(v), F.lit(0.0))


def skewness_of(v: Column) -> Column:
    """n / ((n-1)(n-2)) * sum((v-mean)^3) / sd^3 with the population's sd; 0 under three values or without variance."""
    n = F.count(v)
    return F.when((n < 3) | (F.var_pop(v) == 0), 0.0).otherwise(n * n / ((n - 1) * (n - 2)) * F.skewness(v))


def kurtosis_of(v: Column) -> Column:
    """Excess kurtosis without bias; 0 under four values or without variance."""
    n = F.count(v)
    return F.when((n < 4) | (F.var_pop(v) == 0), 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))


def percentile_of(v: Column, p: float) -> Column:
    """Exact, linear between ranks; p from 0 to 100."""
    if not 0 <= p <= 100:
        raise ValueError("a percentile is between 0 and 100")
    return F.percentile(v, p / 100)


def value_of_rank(rows: DataFrame, k: int, few: int = 100_000) -> float | None:
    """The value of rank k, from 0, of a column ``v`` of doubles: the range that holds it is cut into BINS parts until few rows are left in one, which alone reach the driver."""
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return None
    left = k
    while low < high:
        inside = rows.where((F.col("v") >= low) & (F.col("v") <= high))
        width = high / BINS - low / BINS
        part = F.least(F.greatest(F.floor((F.col("v") - low) / width), F.lit(0)), F.lit(BINS - 1)) if width > 0 else F.when(F.col("v") > low, 1).otherwise(0)
        found = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("part").collect()
        for r in found:
            if left < r["n"]:
                break
            left -= r["n"]
        low, high = r["low"], r["high"]
        if r["n"] <= few:
            return sorted(x["v"] for x in rows.where((F.col("v") >= low) & (F.col("v") <= high)).collect())[left]
    return low


class Statistics(Ordered):
    """Numeric terminals. Each takes an optional function of the value; summary() makes all moments in one pass."""

    def _stat(self, f: Callable | None, of: Callable[[Column], Column], name: str) -> DataFrame:
        df, v = self._apply(f)
        return self._agg(of(v), name, df)

    def variance(self, f: Callable | None = None, name: str = "variance") -> DataFrame:
        return self._stat(f, variance_of, name)

    def standard_deviation(self, f: Callable | None = None, name: str = "standard_deviation") -> DataFrame:
        return self._stat(f, lambda v: F.sqrt(variance_of(v)), name)

    def skewness(self, f: Callable | None = None, name: str = "skewness") -> DataFrame:
        return self._stat(f, skewness_of, name)

    def kurtosis(self, f: Callable | None = None, name: str = "kurtosis") -> DataFrame:
        return self._stat(f, kurtosis_of, name)

    def median(self, f: Callable | None = None, name: str = "median") -> DataFrame:
        return self.percentile(50, f, name)

    def quartiles(self, f: Callable | None = None) -> DataFrame:
        """first_quartile, median, third_quartile, interquartile_range: one aggregation."""
        df, v = self._apply(f)
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        names = ("first_quartile", "median", "third_quartile")
        out = self.s._per_key(df, q.alias("_q"))
        return out.select(*self.s.by, *[F.col("_q")[k].alias(x) for k, x in enumerate(names)], (F.col("_q")[2] - F.col("_q")[0]).alias("interquartile_range"))

    def percentile(self, p: float, f: Callable | None = None, name: str = "percentile") -> DataFrame:
        """Exact, linear between ranks. A long stream without keys is read some times: its range of values is cut into BINS parts again and again around the rank, so that no task holds its values."""
        if not 0 <= p <= 100:
            raise ValueError("a percentile is between 0 and 100")
        df, v = self._apply(f)
        if self.s.by or df.count() <= COUNTED:
            return self._stat(f, lambda v: percentile_of(v, p), name)
        rows = df.select(v.cast("double").alias("v")).where("v is not null")
        n = rows.count()
        at = (n - 1) * p / 100
        low, high = (value_of_rank(rows, k) for k in (math.floor(at), math.ceil(at)))
        return df.sparkSession.range(1).select(F.lit(low + (high - low) * (at - math.floor(at)) if n else None).cast("double").alias(name))

    def first_quartile(self, f: Callable | None = None, name: str = "first_quartile") -> DataFrame:
        return self.percentile(25, f, name)

    def third_quartile(self, f: Callable | None = None, name: str = "third_quartile") -> DataFrame:
        return self.percentile(75, f, name)

    def interquartile_range(self, f: Callable | None = None, name: str = "interquartile_range") -> DataFrame:
        return self._stat(f, lambda v: percentile_of(v, 75) - percentile_of(v, 25), name)

    def mode(self, f: Callable | None = None, name: str = "mode") -> DataFrame:
        """The most frequent value, the smallest of equals."""
        df, v = self._apply(f)
        counts = df.groupBy(*self.s.by, v.alias("_v")).agg(F.count("*").alias("_n")).where("_v is not null")
        return self.s._per_key(counts, F.max("_n").alias("_most")).join(counts, list(self.s.by)).where("_n = _most").groupBy(*self.s.by).agg(F.min("_v").alias(name)) if self.s.by else counts.where(F.col("_n") == counts.agg(F.max("_n")).scalar()).agg(F.min("_v").alias(name))

    def summary(self, f: Callable | None = None) -> DataFrame:
        """count, sum, average, minimum, maximum, range, variance, standard deviation, skewness, kurtosis: one aggregation."""
        df, v = self._apply(f)
        parts = {"count": F.count(v), "sum": F.coalesce(F.sum(v), F.lit(0)), "average": F.coalesce(F.avg(v), F.lit(0.0)), "minimum": F.min(v), "maximum": F.max(v), "range": F.coalesce(F.max(v) - F.min(v), F.lit(0)), "variance": variance_of(v), "standard_deviation": F.sqrt(variance_of(v)), "skewness": skewness_of(v), "kurtosis": kurtosis_of(v)}
        return self.s._per_key(df, *[c.alias(k) for k, c in parts.items()])

    # ---- frequency and distribution

    def frequency(self, key: Callable | None = None) -> DataFrame:
        """key, counts (array of index, 1), spans (array of index, length): where each key stands; the length is the stream's last index + 1."""
        s = self.s.stored()
        k = (key or (lambda v: v))(F.col(VALUE))
        got = s.df.groupBy(*s.by, k.alias("key")).agg(F.array_sort(F.collect_list(IDX)).alias("_at"))
        length = (F.max(IDX) + 1).cast("double").alias("_length")
        got = got.join(s.df.groupBy(*s.by).agg(length), list(s.by)) if s.by else got.withColumn("_length", s.df.agg(length).scalar())
        part = lambda x: F.transform("_at", lambda i: F.struct(i.cast("double").alias("re"), x.alias("im")))
        return got.select(*s.by, "key", part(F.lit(1.0)).alias("counts"), part(F.col("_length")).alias("spans"))

    def distribute(self, key: Callable | None = None) -> DataFrame:
        """key, re, im: how far the sum of a key's indices, and its count, stand from the most frequent of either, in root mean squares over the keys (1 if below 0.001). Two aggregations; the centres are scalars."""
        s = self.s.stored()
        k = (key or (lambda v: v))(F.col(VALUE))
        keys = s.df.groupBy(*s.by, k.alias("key")).agg(F.sum(IDX).cast("double").alias("_s"), F.count("*").cast("double").alias("_c"))
        if s.by:
            centre = keys.groupBy(*s.by).agg(F.mode("_s", True).alias("_ms"), F.mode("_c", True).alias("_mc"))
            keys = keys.join(centre, list(s.by))
            over = Window.partitionBy(*s.by)
            scale = lambda c, m: F.sqrt(F.avg((F.col(c) - F.col(m)) ** 2).over(over))
            keys = keys.withColumns({"_ds": scale("_s", "_ms"), "_dc": scale("_c", "_mc")})
        else:
            ms, mc = keys.agg(F.mode("_s", True)).scalar(), keys.agg(F.mode("_c", True)).scalar()
            keys = keys.withColumns({"_ms": ms, "_mc": mc})
            scale = lambda c, m: keys.agg(F.sqrt(F.avg((F.col(c) - F.col(m)) ** 2))).scalar()
            keys = keys.withColumns({"_ds": scale("_s", "_ms"), "_dc": scale("_c", "_mc")})
        z = lambda c: (F.col(f"_{c}") - F.col(f"_m{c}")) / F.when(F.col(f"_d{c}") < 0.001, 1.0).otherwise(F.col(f"_d{c}"))
        return keys.select(*s.by, "key", z("s").alias("re"), z("c").alias("im"))

    # ---- signals

    def _signal(self, padded: bool, inverse: bool) -> DataFrame:
        """k, re, im of the transform. A keyed stream transforms each key's values in a task of its own."""
        rows = self.s.positioned().select(*self.s.by, "_pos", F.col(VALUE).cast("double").alias("x"))

        def spectrum(x: np.ndarray) -> np.ndarray:
            n = len(x)
            p = 1 << max(0, (n - 1).bit_length()) if padded else n
            return np.fft.ifft(x, p)[:n] * p / n if inverse else np.fft.fft(x, p)[:n]

        fields = "".join(f"{c} {t}, " for c, t in rows.select(*self.s.by).dtypes) + "k long, re double, im double"
        by = list(self.s.by)

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            out = spectrum(pdf.sort_values("_pos")["x"].to_numpy())
            return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(out) for c in by}, "k": np.arange(len(out)), "re": out.real, "im": out.imag})

        if by:
            return rows.groupBy(*by).applyInPandas(whole, fields)
        n = rows.count()
        if n <= ONE_TASK:
            return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(whole, fields)
        size = 1 << (n - 1).bit_length() if padded else n
        if size // shorter(size) > ONE_TASK:
            return chirped_transform(rows, n, inverse)
        return long_transform(rows, n, padded, inverse)

    def dft(self) -> DataFrame:
        """k, re, im with X_k = sum x_n e^(-2 pi i k n / N)."""
        return self._signal(False, False)

    def idft(self) -> DataFrame:
        return self._signal(False, True)

    def fft(self) -> DataFrame:
        """The first N bins of the transform over the next power of two, filled with zeros."""
        return self._signal(True, False)

    def ifft(self) -> DataFrame:
        """The same padding, the other sign, divided by N."""
        return self._signal(True, True)

    # ---- optimisation

    def gradient(self, gradient: Callable | None = None, rate: float = 0.01, rounds: int = 1000, tolerance: float = 1e-6, cost: Callable | None = None, h: float = 1e-5) -> list[float]:
        """Gradient descent from the stream's values as parameters, which are few, on the driver. With ``cost``, the gradient is by central differences."""
        p = np.array([r[VALUE] for r in self.s.df.orderBy(*self.s.order).select(VALUE).limit(PARAMETERS + 1).collect()], float)
        if len(p) > PARAMETERS:
            raise ValueError(f"gradient() takes a stream of {PARAMETERS} parameters at most")

        def central(x: np.ndarray) -> np.ndarray:
            step = np.eye(len(x)) * h
            return np.array([(cost(x + s) - cost(x - s)) / (2 * h) for s in step])

        slope = central if cost is not None else gradient
        if slope is None:
            raise ValueError("a gradient or a cost is needed")
        for _ in range(rounds):
            g = np.asarray(slope(p), float)
            if g.shape != p.shape:
                raise ValueError(f"the gradient has {g.size} components for {p.size} parameters")
            p = p - rate * g
            if not len(g) or np.abs(g).max() < tolerance:
                break
        return p.tolist()


def shorter(size: int) -> int:
    """The largest divisor up to the root."""
    return next(d for d in range(math.isqrt(size), 0, -1) if size % d == 0)


def chirped_transform(rows: DataFrame, n: int, inverse: bool) -> DataFrame:
    """The transform of a signal whose length has no even cut, by Bluestein's identity: 2 jk = j^2 + k^2 - (k - j)^2 makes it a convolution with a chirp, which three transforms of a power of two do."""
    size = 1 << (2 * n - 2).bit_length()
    sign = 1.0 if inverse else -1.0

    def chirp(k: Column, turn: float) -> tuple[Column, Column]:
        angle = (k * k % (2 * n)).cast("double") * (turn * math.pi / n)
        return F.cos(angle), F.sin(angle)

    def times(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
        return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]

    def named(z: tuple[Column, Column], re: str, im: str) -> list[Column]:
        return [z[0].alias(re), z[1].alias(im)]

    pos = F.col("_pos")
    signal = rows.select("_pos", *named(tuple(c * F.col("x") for c in chirp(pos, sign)), "x", "y"))
    back = F.least(pos, size - pos)
    ring = rows.sparkSession.range(size).select(F.col("id").alias("_pos")).where(back < n).select("_pos", *named(chirp(back, -sign), "x", "y"))
    left, right = (long_transform(s, size, True, False).toDF("_pos", *names) for s, names in ((signal, ("ar", "ai")), (ring, ("br", "bi"))))
    product = left.join(right, "_pos").select("_pos", *named(times((F.col("ar"), F.col("ai")), (F.col("br"), F.col("bi"))), "x", "y"))
    folded = long_transform(product, size, True, True).where(F.col("k") < n)
    out = times((F.col("re"), F.col("im")), chirp(F.col("k"), sign))
    return folded.select("k", *named(tuple(c / n if inverse else c for c in out), "re", "im"))


def long_transform(rows: DataFrame, n: int, padded: bool, inverse: bool) -> DataFrame:
    """The transform of one long signal, x or x + iy by _pos, in two rounds of short ones: with P = A * B and position a + A * b, B-point transforms over b for each a, a turn of each bin, and A-point transforms over a for each bin. Groups hold A or B values."""
    size = 1 << (n - 1).bit_length() if padded else n
    a = shorter(size)
    b, sign = size // a, 1 if inverse else -1
    turn = np.fft.ifft if inverse else np.fft.fft
    rows = rows if "y" in rows.columns else rows.withColumn("y", F.lit(0.0))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(b, complex)
        at = int(pdf["a"].iloc[0])
        x[pdf["b"].to_numpy()] = pdf["x"].to_numpy() + 1j * pdf["y"].to_numpy()
        y = turn(x) * (b if inverse else 1) * np.exp(sign * 2j * np.pi * at * np.arange(b) / size)
        return pd.DataFrame({"a": at, "bin": np.arange(b), "re": y.real, "im": y.imag})

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(a, complex)
        y[pdf["a"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        z = turn(y) * (a if inverse else 1) / (n if inverse else 1)
        k = int(pdf["bin"].iloc[0]) + b * np.arange(a)
        return pd.DataFrame({"k": k, "re": z.real, "im": z.imag})[k < n]

    cut = rows.select((F.col("_pos") % a).alias("a"), F.floor(F.col("_pos") / a).cast("long").alias("b"), "x", "y")
    bins = cut.groupBy("a").applyInPandas(first, "a long, bin long, re double, im double")
    return bins.groupBy("bin").applyInPandas(second, "k long, re double, im double")


__all__ = ["IDX", "Statistics", "kurtosis_of", "percentile_of", "skewness_of", "variance_of"]
