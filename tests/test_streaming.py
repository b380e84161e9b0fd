"""Live streams over the events table."""

import os

import pytest
from pyspark.sql import functions as F

from rillstone.streaming import count_windows, event_windows, foreach_batch

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def live(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_count_windows(spark):
    got = {(r["key"], r["window"]): (r["n"], round(r["sum"], 4)) for r in drained(count_windows(live(spark), "event_type", "value", 10, "event_id"), "counted", "append")}
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect()
    by = {}
    for e in events:
        by.setdefault(e["event_type"], []).append(e["value"])
    want = {(k, w): (10, round(sum(v[10 * w : 10 * w + 10]), 4)) for k, v in by.items() for w in range(len(v) // 10)}
    assert got == want


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_count_windows_go_on_over_batches(spark, tmp_path, size):
    path = str(tmp_path / "events")
    for k, n in enumerate((30, 3, 90, 1, 50)):
        spark.range(n).select((F.col("id") + 1000 * k).alias("at"), (F.col("id") % 2).alias("key"), (F.col("id") * 3 + k).cast("double").alias("v")).coalesce(1).write.mode("append").parquet(path)
    rows = [(r["at"], r["key"], r["v"]) for r in spark.read.parquet(path).orderBy("at").collect()]
    df = spark.readStream.schema("at long, key long, v double").option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r["key"], r["window"]): (r["n"], r["sum"], r["average"]) for r in drained(count_windows(df, "key", "v", size, "at"), f"over_batches_{size}", "append")}
    want = {}
    for key in (0, 1):
        v = [x for _, k, x in rows if k == key]
        want |= {(key, w): (size, sum(v[w * size : w * size + size]), sum(v[w * size : w * size + size]) / size) for w in range(len(v) // size)}
    assert got == want


def test_event_windows(spark):
    rows = drained(event_windows(live(spark), "ts", "1 hour", "1 day", None, ["event_type"], F.count("*").alias("n")), "timed", "complete")
    assert sum(r["n"] for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_foreach_batch(spark, tmp_path):
    seen = []
    q = foreach_batch(live(spark), "value", "event_id", lambda o, epoch: seen.append(o.count().first()[0]), str(tmp_path))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 1000
