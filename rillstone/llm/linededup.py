"""Line dedup by levelled sorted runs of line hashes.

Documents come in batches by rising id. A run is a table of (hash, first
document), bucketed by hash and sorted in its buckets. Each batch's hashes are
merge-joined with every run: what a run holds is lost to that run's document,
and what none holds, the anti join, becomes a run of level 0; when a level holds
FANOUT runs they are merged to one of the next. A hash stands in one run, with
the smallest document that holds it. Everything is DataFrame operations; hashes
are counted per task before they are shuffled.
"""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, dropped, removed, shared_dir, written

#: Keys of fewer code points are never dropped.
LEAST = 10
FANOUT = 2
BATCHES = 4
#: Lines that a bucket of a run holds; more buckets than shuffle partitions are made for more.
PER_BUCKET = 4_000_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


#: Of a batch's hashes: in one document and new, in several and new, held by an older run. A table has a folder for each.
ALONE, SHARED, HELD = 0, 1, 2


class LineRuns:
    """The levelled runs of one corpus. ``buckets`` is the number of parts that each run is dealt out to."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def run(self, name: str) -> DataFrame:
        """hash, first of a run."""
        return self.spark.table(name).where(F.col("kind") != HELD).select("hash", "first")

    def all_runs(self) -> list[DataFrame]:
        return [self.run(n) for level in self.levels for n in level]

    def write(self, rows: DataFrame) -> str:
        """A table of hash, first, kind."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_dir(self.spark, name)
        rows.repartition(self.buckets, "hash").write.format("parquet").option("path", self.paths[name]).option("compression", "zstd").partitionBy("kind").bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name)
        return name

    def add(self, lines: DataFrame, last: bool = False) -> DataFrame:
        """Adds a batch of (hash, doc_id), whose documents follow those of the batches before. Returns hash, keeper of the hashes that lose lines of this batch, all but the keeper's. After the last batch nothing is merged."""
        new = lines.groupBy("hash").agg(F.min("doc_id").alias("first"), (F.min("doc_id") < F.max("doc_id")).alias("more"))
        older = []
        for k, run in enumerate(self.all_runs()):
            new = new.hint("merge").join(run.toDF("hash", f"_run{k}"), "hash", "left")
            older.append(F.col(f"_run{k}"))
        held = F.coalesce(*older) if older else F.lit(None).cast("long")
        kind = F.when(held.isNotNull(), HELD).when(F.col("more"), SHARED).otherwise(ALONE)
        name = self.write(new.select("hash", F.coalesce(held, "first").alias("first"), kind.alias("kind")))
        if not last:
            self.place(name, 0)
        return self.spark.table(name).where(F.col("kind") != ALONE).select("hash", F.col("first").alias("keeper"))

    def place(self, name: str, level: int) -> None:
        """Puts a run on a level, and merges the level into the next when it is full."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            whole = self.run(full[0])
            for other in full[1:]:
                whole = whole.unionAll(self.run(other))
            self.place(self.write(whole.withColumn("kind", F.lit(ALONE))), level + 1)

    def drop(self) -> None:
        """Removes all tables and their files."""
        for name, path in self.paths.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, path)
        self.paths, self.levels = {}, []


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """id, row (hash of the text), drop (array of line numbers from 0) of the documents that lose a line.

    The line hashes of all documents are written once, dealt into batches by
    id; a batch's bounds are quantiles of the ids, and do not change the result.
    Each line is read twice: to be counted for its batch, and to be dropped if
    the runs, or its batch's own counts, name another document as its keeper.
    Rows that share an id count as one document. Rows with a null id neither
    lose lines nor count. The hash is MD5 of the whole key. All tables made
    meanwhile are removed but the result's.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("row")).where(F.col("doc_id").isNotNull())
    bounds = sorted(set((batches > 1 and rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0]) or []))
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("doc_id") > b).cast("int")
    keys = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("at"), line_key(line).alias("key")))
    line = rows.select("doc_id", "row", batch.alias("batch"), F.explode(F.filter(keys, lambda x: F.length(x["key"]) >= least)).alias("x"))
    lines = written(line.select("doc_id", "row", F.col("x.at").alias("at"), F.unhex(F.md5(F.encode("x.key", "UTF-8"))).alias("hash"), "batch"), "lines", by="batch")
    runs = LineRuns(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines.count() / PER_BUCKET)))
    marks = [runs.add(lines.where(F.col("batch") == b).select("hash", "doc_id"), b == len(bounds)).withColumn("batch", F.lit(b)) for b in range(len(bounds) + 1)]
    known = functools.reduce(DataFrame.unionAll, marks)
    lost = lines.join(known, ["batch", "hash"]).where("doc_id <> keeper")
    out = written(lost.groupBy("doc_id", "row").agg(F.collect_set("at").alias("drop")).withColumnRenamed("doc_id", "id"), "lost-lines")
    dropped(lines)
    runs.drop()
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """docs with the lines dropped from its text, and ``n_lines``, ``n_dropped`` of each; a null or empty text is one empty line.

    Keys of ``least`` code points or more that stand in two documents or more
    lose all their lines but those of the smallest id. A null text stays null.
    Columns of docs named n_lines or n_dropped are replaced. Texts are shuffled
    once, by id, however few lose a line.
    """
    lost = repeated_lines(docs, id_col, text_col, least, batches)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    key = docs[id_col].cast("long")
    both = docs.select(*[F.col(f"`{c}`") for c in keep], key.alias("_id"), F.xxhash64(F.col(text_col)).alias("_row")).hint("merge").join(lost.toDF("_id", "_row", "_drop"), ["_id", "_row"], "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    out = both.withColumn("_lines", lines).withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n")
    return out.withColumn(text_col, F.when(F.col("n_dropped") > 0, kept).otherwise(F.col(text_col))).select(*keep, "n_lines", "n_dropped")


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of dedup_lines."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long"), "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
