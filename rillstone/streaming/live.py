"""Live counterparts of the lazy stream's sources, windows and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import Ordered
from ..operators.stream import Stream


def rate(spark: SparkSession, per_second: int, value: Callable[[Column], Column] | None = None) -> DataFrame:
    """_idx, ts, value: an endless generator; value is an expression of the index."""
    df = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return df.select(F.col("value").alias("_idx"), F.col("timestamp").alias("ts"), (value or (lambda i: i))(F.col("value")).alias("value"))


def file_lines(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Lines, or delimited records, of text files as they come into a folder."""
    reader = spark.readStream.format("text")
    return (reader.option("lineSep", delimiter) if delimiter else reader).load(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def count_windows(df: DataFrame, key: str, value: str, size: int, order: str) -> DataFrame:
    """key, window, n, sum, average of every ``size`` values of a key, in the order that they come (by ``order`` in a batch).

    State is one window's open count, sum and number per key, whatever its
    size. Windows are emitted when full.
    """
    if size <= 0:
        raise ValueError("a window holds 1 value at least")
    kind = dict(df.dtypes)[key]

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, n, total = state.get if state.exists else (0, 0, 0.0)
        whole = pd.concat(list(batches)).sort_values("_order", kind="stable")["_value"].to_numpy(dtype=float)
        # the open window first, then whole ones, then what opens the next
        cut = min(len(whole), size - n)
        n, total = n + cut, total + float(whole[:cut].sum())
        sums = np.zeros(0)
        if n == size:
            full = (len(whole) - cut) // size
            sums = np.concatenate([[total], whole[cut : cut + full * size].reshape(full, size).sum(axis=1)])
            rest = whole[cut + full * size :]
            n, total = len(rest), float(rest.sum())
        state.update((window + len(sums), n, total))
        yield pd.DataFrame({"key": [k[0]] * len(sums), "window": window + np.arange(len(sums)), "n": size, "sum": sums, "average": sums / size})

    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("_value"), F.col(order).alias("_order"))
    return rows.groupBy("key").applyInPandasWithState(fold, f"key {kind}, window long, n long, sum double, average double", "window long, n long, total double", "append", GroupStateTimeout.NoTimeout)


def event_windows(df: DataFrame, time: str, late: str, size: str, step: str | None = None, by: list[str] | None = None, *aggs: Column) -> DataFrame:
    """Aggregates per window of event time, with a watermark."""
    window = F.window(time, size, step) if step else F.window(time, size)
    if dict(df.dtypes)[time] != "timestamp":
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late).groupBy(window, *(by or [])).agg(*aggs)


def running(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    """Aggregates since the start, per key; for complete or update output."""
    return df.groupBy(*by).agg(*aggs)


def foreach_batch(df: DataFrame, value: str, order: str, terminal: Callable[[Ordered, int], None], checkpoint: str):
    """Every operator and terminal of the batch library over each micro-batch: terminal(ordered, batch id)."""

    def run(batch: DataFrame, epoch: int) -> None:
        terminal(Stream.of(batch, value, order).to_ordered(), epoch)

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def to_console(df: DataFrame, mode: str = "append"):
    return df.writeStream.format("console").outputMode(mode).start()
