"""What the operators share: the cluster's shared folder, written tables, Arrow maps, components.

Two-step jobs write their intermediate table below ``spark.checkpoint.dir``
and read it again, so a lost executor costs a re-read and never a recomputation
of everything before it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\u000b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: By application: the folder that stands in where none is set.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below the folder that driver and executors share.

    Where ``spark.checkpoint.dir`` is unset a temporary folder takes its place
    on a single machine; on a cluster, whose executors would each write to their
    own disk, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="rillstone-")
        OWN[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that hold nothing any more that a result reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that go to Python at once: whole texts, of which thousands must fit a worker beside its tables.
ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches of this session to ROWS rows from now on; no result depends on it. It is not set back, as another query may be running."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(rows))
    if now <= 0 or now > ROWS:
        spark.conf.set(rows, str(ROWS))


#: Where written() put what it returned.
PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None, level: int = 3) -> DataFrame:
    """The rows of df, written to the shared folder, in a folder for each value of the column ``by`` if it is given, and read again: its lineage ends here. ``level`` is how hard zstd packs them."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    small_batches(spark)
    to = df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", level)
    (to.partitionBy(by) if by else to).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    PATHS[out] = path
    return out


def written_path(table: DataFrame) -> str:
    return PATHS[table]


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() returned, once everything made of it is written itself."""
    for t in tables:
        removed(t.sparkSession, PATHS.pop(t))


def map_arrow(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function made once per task by ``start``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


#: Letters of text that are cut into words at once.
STRETCH = 1 << 22


def stretches(texts: list, most: int = STRETCH) -> Iterator[range]:
    """The places of texts that have about ``most`` letters together; a longer one stands alone."""
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= most:
            size, last = size + len(texts[last]), last + 1
        yield range(first, last)
        first = last


def cut_words(texts: list[str], others: str) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one after another, and their count in each: what ``others`` finds stands apart, and the rest is cut at white space."""
    spaced = pc.replace_substring_regex(pa.array(texts, pa.string()), pattern=others, replacement=r" \0 ")
    cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(spaced))
    return cut.flatten(), np.diff(cut.offsets.to_numpy()).astype(np.int64)


def numbered(words: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, the number of the word at each place, each text's end there); empty words are left out."""
    table = words.dictionary_encode()
    number, ends, empty = table.indices.to_numpy(), np.cumsum(counts), pc.index(table.dictionary, "").as_py()
    if empty >= 0:
        real = number != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        number = number[real]
    return table.dictionary, number, ends


def number_words(words: pa.Array, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """numbered(), the different words as a list."""
    listed, number, ends = numbered(words, counts)
    return listed.to_pylist(), number, ends


def components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """node, component (the smallest node that it reaches) of the undirected ``edges`` (a, b long).

    Alternates the large-star and small-star steps of Kiveris et al. until the
    edge set stays the same. Each round is two aggregations with map-side
    minima and two joins whose skewed side Spark may split; each is written to
    the shared folder. Only two numbers a round reach the driver. Nodes without
    an edge to another node are absent. Nulls and self-links are dropped.
    """
    cur = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    seen = None
    for _ in range(rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # a node that is its neighbours' minimum keeps no row above, as each of them points at it from its own side
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        cur, old = written(small, name), cur
        dropped(old)
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"the components of {name} did not settle in {rounds} rounds")
    heads = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return heads.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
