"""One query per operator family over the test tables, each with the SQL that says the same."""

from __future__ import annotations

import contextlib
import functools
import io
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import sources, streaming
from .functions import buffers, charset, structures, text
from .operators import Collector, Statistics, Stream
from .plans import Jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, value: Column | str = "value", by=()) -> Stream:
    return Stream.of(table(spark, sf_dir, "events"), value, "event_id", by)


def named(df: DataFrame, idx: str = "idx", value: str = "value") -> DataFrame:
    return df.withColumnsRenamed({"_idx": idx, "value": value})


def long_(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# ---- sources


@query("SELECT CAST(i AS BIGINT) AS idx, CAST(3 + 4 * i AS BIGINT) AS value FROM range(0, 25) t(i)")
def range_step(spark, sf_dir):
    return named(sources.from_range(spark, 3, 100, 4).map(lambda v: v.cast("long")).filter(lambda v: v < 100).rows())


@query("SELECT CAST(i AS BIGINT) AS idx, CAST(10 - 3 * i AS BIGINT) AS value FROM range(0, 5) t(i)")
def range_closed_down(spark, sf_dir):
    return named(sources.from_range_closed(spark, 10, -2, -3).map(lambda v: v.cast("long")).rows())


@query("SELECT CAST(i AS BIGINT) AS idx, 'x' AS value FROM range(0, 7) t(i)")
def repeat_value(spark, sf_dir):
    return named(sources.repeat(spark, "x", 7).rows())


@query("WITH RECURSIVE r(idx, value) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT idx + 1, (value * 3 + 1) % 1000 FROM r WHERE idx < 19) SELECT idx, value FROM r")
def iterate_limit(spark, sf_dir):
    return named(sources.iterate(spark, 1, lambda v: ((v * 3 + 1) % 1000).cast("int"), 20).map(lambda v: v.cast("long")).rows())


@query("SELECT CAST(4000 AS BIGINT) AS n, CAST(5 AS BIGINT) AS low, CAST(9 AS BIGINT) AS high, CAST(5 AS BIGINT) AS different, true AS even")
def random_n(spark, sf_dir):
    """4,000 values of [5, 9]: both bounds are met, and each value stands about as often as the others."""
    counts = sources.random_values(spark, 5, 9, 4000).to_ordered().group_by(lambda v: v, name="found").select("key", F.size("found").alias("n"))
    return counts.agg(long_(F.sum("n")).alias("n"), long_(F.min("key")).alias("low"), long_(F.max("key")).alias("high"), F.count("*").alias("different"), F.bool_and(F.col("n").between(600, 1000)).alias("even"))


@query("SELECT CAST(1000 AS BIGINT) AS n, true AS inside, true AS spread")
def random_reals(spark, sf_dir):
    s = sources.random_values(spark, 3.0, 2.0).filter(lambda v: v < 2.5).limit(1000).to_statistics().summary()
    return s.select("count", ((F.col("minimum") >= 2) & (F.col("maximum") < 2.5)).alias("inside"), ((F.col("range") > 0.45) & (F.abs(F.col("average") - 2.25) < 0.05)).alias("spread")).withColumnRenamed("count", "n")


@query("SELECT CAST(200 AS BIGINT) AS n, CAST(3 AS BIGINT) AS low, CAST(9 AS BIGINT) AS high, CAST(2 AS BIGINT) AS coins")
def randomly_drawn(spark, sf_dir):
    drawn = [(sources.randomly(9, 3), sources.randomly()) for _ in range(200)]
    return spark.createDataFrame(drawn, "v long, c boolean").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count_distinct("c").alias("coins"))


@query("SELECT CAST(i AS BIGINT) AS idx, CAST(i + 3 AS BIGINT) AS value FROM range(0, 10) t(i)")
def range_closed(spark, sf_dir):
    return named(sources.from_range_closed(spark, 12, 3).map(lambda v: v.cast("long")).rows())


@query("SELECT CAST(i AS BIGINT) AS idx, CAST(20 + 7 * i AS BIGINT) AS value FROM range(0, 5) t(i)")
def infinite_filter_skip(spark, sf_dir):
    return named(sources.infinite(spark).map(lambda v: v - 1).filter(lambda v: (v > 0) & (v % 7 == 6)).skip(2).limit(5).rows())


@query("WITH RECURSIVE r(i, v) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, 3 * v + 1 FROM r WHERE i < 30) SELECT row_number() OVER (ORDER BY i) - 1 AS idx, v AS value FROM r WHERE v % 2 = 1 ORDER BY i LIMIT 10")
def iterate_filter_limit(spark, sf_dir):
    return named(sources.iterate(spark, F.lit(1).cast("long"), lambda v: v * 3 + 1).filter(lambda v: v % 2 == 1).limit(10).rows())


@query("WITH RECURSIVE r(i, v) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, (v * 31 + 7) % 10007 FROM r WHERE i < 4999) SELECT count(*) AS n, CAST(sum(v * (i % 13)) AS BIGINT) AS mark FROM r")
def iterate_long(spark, sf_dir):
    s = sources.iterate(spark, 1, lambda v: ((v * 31 + 7) % 10007).cast("int"), 5000)
    return s.rows().agg(F.count("*").alias("n"), F.sum(long_("value") * (F.col("_idx") % 13)).alias("mark"))


@query("SELECT CAST(i AS BIGINT) AS idx, CASE WHEN i < 3 THEN 'made' ELSE 'col' END AS value FROM range(0, 6) t(i)")
def generate_limit(spark, sf_dir):
    return named(sources.generate(spark, lambda: "made", 3).concatenate(sources.generate(spark, lambda: F.lit("col")).limit(3)).rows())


@query("SELECT CAST(0 AS BIGINT) AS n, true AS empty")
def empty_stream(spark, sf_dir):
    o = sources.empty(spark).to_ordered()
    return o.count("n").select("n", o.empty().scalar().alias("empty"))


@query("SELECT count(*) = 0 AS empty, user_id FROM events GROUP BY user_id")
def empty_per_key(spark, sf_dir):
    return events(spark, sf_dir, by="user_id").to_unordered().empty()


@query("SELECT CAST(i AS BIGINT) AS idx, v AS value FROM (VALUES (0, 'b'), (1, 'a'), (2, 'b'), (3, 'c')) t(i, v)")
def literals(spark, sf_dir):
    return named(sources.of(spark, "b", "a", "b", "c").rows())


@query("SELECT p_partkey, CAST(i - 1 AS BIGINT) AS pos, CAST(get_byte AS INTEGER) AS byte FROM (SELECT p_partkey, unnest(range(1, octet_length(encode(p_name)) + 1)) AS i, p_name FROM part) t, LATERAL (SELECT ('0x' || substr(hex(encode(p_name)), CAST(2 * i - 1 AS BIGINT), 2))::INTEGER AS get_byte)")
def blob_bytes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.posexplode(text.byte_values(F.col("p_name"))).alias("pos", "byte")).select("p_partkey", long_("pos").alias("pos"), "byte")


def shared(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors can both read it; on one machine, a temporary one if none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rillstone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_of(spark: SparkSession, rows: DataFrame) -> str:
    """A folder with one text file, a line for each row of a column of texts."""
    path = shared(spark, "lines")
    rows.coalesce(1).write.text(path)
    return path


@query("SELECT CAST(i - 1 AS BIGINT) AS idx, CAST(v AS INTEGER) AS value FROM (VALUES (1, 99), (2, 195), (3, 169), (4, 240), (5, 159)) t(i, v)")
def blob_slice(spark, sf_dir):
    return named(sources.blob(spark, "abc\u00e9\U0001f600", 2, 7).rows())


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_name AS value FROM customer")
def file_lines(spark, sf_dir):
    names = table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_name")
    return named(sources.lines(spark, file_of(spark, names)).rows())


@query("SELECT row_number() OVER (ORDER BY c_custkey, i) - 1 AS idx, w AS value FROM (SELECT c_custkey, unnest(['', c_name]) AS w, unnest([0, 1]) AS i FROM customer) WHERE NOT (c_custkey = (SELECT min(c_custkey) FROM customer) AND i = 0) UNION ALL SELECT 2 * count(*) - 1, chr(10) FROM customer")
def file_records(spark, sf_dir):
    """Records that end at a sign within lines: `;;` gives an empty one, and the last line's end is a record of its own."""
    names = table(spark, sf_dir, "customer").orderBy("c_custkey").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), ";;"), F.lit(";")).alias("value"))
    return named(sources.records(spark, file_of(spark, names), ";").rows())


@query("SELECT CAST(0 AS BIGINT) AS idx, sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS value FROM customer")
def file_whole(spark, sf_dir):
    names = table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_name")
    return named(sources.text_file(spark, file_of(spark, names)).map(lambda v: F.sha2(v, 256)).rows())


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_name AS value FROM nation UNION ALL SELECT count(*), '' FROM nation")
def file_fields(spark, sf_dir):
    names = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name")
    return named(sources.text_file(spark, file_of(spark, names), "\n").rows())


@query("SELECT CAST(sum(length(n_name) + 3) AS BIGINT) AS n, CAST(sum(octet_length(encode(n_name)) + 4) AS BIGINT) AS bytes, CAST(233 AS INTEGER) AS accent FROM nation")
def file_code_points(spark, sf_dir):
    """The code points of one file as UTF-8 and, a byte a letter, as Latin-1."""
    path = file_of(spark, table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat("n_name", F.lit(" \u00e9"))))
    points = sources.code_point_file(spark, path).to_ordered()
    return points.count("n").select("n", sources.code_point_file(spark, path, "latin1").to_ordered().count().scalar().alias("bytes"), points.maximum().scalar().cast("int").alias("accent"))


@query("SELECT CAST(i - 1 AS BIGINT) AS idx, v AS value FROM (VALUES (1, 'a'), (2, ''), (3, 'b c'), (4, '')) t(i, v)")
def text_fields(spark, sf_dir):
    return named(sources.text(spark, "a;;b c;", ";").rows())


@query("SELECT CAST(0 AS BIGINT) AS idx, 'a;;b' AS value")
def text_whole(spark, sf_dir):
    return named(sources.text(spark, "a;;b").rows())


@query("SELECT CAST(i - 1 AS BIGINT) AS idx, v AS value FROM (VALUES (1, 'one'), (2, 'two'), (3, '')) t(i, v)")
def input_fields(spark, sf_dir):
    return named(sources.standard_input(spark, "\n", stream=io.BytesIO(b"one\ntwo\n\n")).rows())


@query("SELECT CAST(i - 1 AS BIGINT) AS idx, CAST(v AS INTEGER) AS value FROM (VALUES (1, 98), (2, 128512), (3, 233)) t(i, v)")
def sequence_slice(spark, sf_dir):
    return named(sources.code_points(spark, "\U0001f600b\U0001f600\u00e9z", 1, 4).map(lambda v: v.cast("int")).rows())


@query("SELECT CAST(i - 1 AS BIGINT) AS idx, CAST(v AS INTEGER) AS value FROM (VALUES (1, 97), (2, 65533), (3, 40), (4, 65533)) t(i, v)")
def sequence_decoded(spark, sf_dir):
    return named(sources.code_points(spark, b"a\xc3(\xf0\x9f").map(lambda v: v.cast("int")).rows())


# ---- element by element


@query("SELECT user_id, CAST(round(sum(value * 2), 4) AS DOUBLE) AS total, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def map_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    s = Statistics(Stream.of(e, "value", "event_id", "user_id").map(lambda v: v * 2)).summary()
    return s.select("user_id", F.round("sum", 4).alias("total"), F.col("count").alias("n"))


@query("SELECT CAST(2 * i AS BIGINT) AS value FROM range(0, 100) t(i) WHERE 2 * i > 50")
def readme_example(spark, sf_dir):
    s = sources.from_range(spark, 0, 100).map(lambda v: v * 2).filter(lambda v: v > 50)
    return s.to_ordered().to_vector().select(F.explode("values").alias("value")).select(long_("value").alias("value"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value FROM events WHERE value > 50")
def filter_reindex(spark, sf_dir):
    return named(events(spark, sf_dir).filter(lambda v: v > 50).rows())


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 3 = 1")
def filter_by_index(spark, sf_dir):
    return named(events(spark, sf_dir).filter(lambda v, i: i % 3 == 1).rows())


@query("SELECT idx, value * 10 + idx AS value FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, user_id AS value FROM events)")
def redirect_value(spark, sf_dir):
    return named(events(spark, sf_dir, "user_id").redirect(lambda v, i: v * 10 + i).rows())


@query("SELECT idx * 2 AS idx, value FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, user_id AS value FROM events)")
def reindex_double(spark, sf_dir):
    return named(events(spark, sf_dir, "user_id").reindex(lambda v, i: i * 2).rows())


@query("SELECT row_number() OVER (ORDER BY first) - 1 AS idx, event_type AS value FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type)")
def distinct_first(spark, sf_dir):
    return named(events(spark, sf_dir, "event_type").distinct().rows())


@query("SELECT row_number() OVER (ORDER BY first) - 1 AS idx, v AS value FROM (SELECT user_id % 10 AS k, min(event_id) AS first, arg_min(user_id, event_id) AS v FROM events GROUP BY k)")
def distinct_by_key(spark, sf_dir):
    return named(events(spark, sf_dir, "user_id").distinct(lambda v: v % 10).rows())


# ---- containers


@query("SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(CAST(x AS DOUBLE), 6) AS value FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def flat_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("k", F.col("vec_id"))
    s = Stream.of(e, "embedding", "k", "vec_id").flat().map(lambda v: F.round(v.cast("double"), 6))
    return named(s.rows(), "pos")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS idx, w AS value FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def flatmap_words(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    return named(Stream.of(p, "p_name", "k", "p_partkey").flat_map(lambda v: text.split(v, " ")).rows())


@query("SELECT row_number() OVER (ORDER BY event_id, i) - 1 AS idx, v AS value FROM (SELECT event_id, unnest([user_id, -user_id]) AS v, unnest([0, 1]) AS i FROM events)")
def flat_by_function(spark, sf_dir):
    return named(events(spark, sf_dir, "user_id").flat(lambda v: F.array(v, -v)).rows())


@query("WITH r AS (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events), w AS (SELECT unnest(range(0, CAST((SELECT (count(*) + 29) // 30 FROM r) AS BIGINT))) AS win) SELECT row_number() OVER (ORDER BY win, i) - 1 AS idx, user_id AS value FROM w JOIN r ON i >= win * 30 AND i < win * 30 + 50")
def flat_windows(spark, sf_dir):
    return named(events(spark, sf_dir, "user_id").to_window().slide(50, 30).flat().rows())


@query("SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS seen FROM events")
def peek_seen(spark, sf_dir):
    """What passes is told to an observer, without a pass of its own."""
    seen = Observation()
    n = events(spark, sf_dir, "user_id").observe(seen, F.sum("value").alias("seen")).to_ordered().count("n").first()["n"]
    return spark.createDataFrame([(n, seen.get["seen"])], "n long, seen long")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, user_id AS value FROM events WHERE user_id % 3 = 0")
def peek_passes(spark, sf_dir):
    return named(events(spark, sf_dir, "user_id").peek(lambda v: None).filter(lambda v: v % 3 == 0).rows())


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, user_id AS value, 5 AS tasks FROM events WHERE user_id % 3 = 0")
def parallel_filter(spark, sf_dir):
    s = events(spark, sf_dir, "user_id").parallel(5)
    return named(s.filter(lambda v: v % 3 == 0).rows()).withColumn("tasks", F.lit(s.concurrency))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, user_id + 1 AS value FROM events")
def back_to_stream(spark, sf_dir):
    return named(events(spark, sf_dir, "user_id").to_ordered().stream().map(lambda v: v + 1).to_unordered().source().rows())


# ---- by position


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value FROM events ORDER BY event_id LIMIT 100")
def limit_n(spark, sf_dir):
    return named(events(spark, sf_dir).limit(100).rows())


@query("SELECT * FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value FROM events) WHERE idx >= 9000")
def skip_gap(spark, sf_dir):
    return named(events(spark, sf_dir).skip(9000).rows())


@query("SELECT * FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value FROM events) WHERE idx >= 200 AND idx < 500")
def sub_range(spark, sf_dir):
    return named(events(spark, sf_dir).sub(200, 500).rows())


@query("WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM events), k AS (SELECT * FROM r WHERE i >= 300), n AS (SELECT count(*) AS n FROM k) SELECT i % n AS idx, value FROM k, n")
def skip_ordered_rotation(spark, sf_dir):
    return named(events(spark, sf_dir).skip(300).to_ordered().rows())


@query("WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM events), n AS (SELECT count(*) AS n FROM r) SELECT (n - i) % n AS idx, value FROM r, n")
def reverse_ordered(spark, sf_dir):
    return named(events(spark, sf_dir).reverse().to_ordered().rows())


@query("WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM events), n AS (SELECT count(*) AS n FROM r) SELECT ((i - 7) % n + n) % n AS idx, value FROM r, n")
def translate_ordered(spark, sf_dir):
    return named(events(spark, sf_dir).translate(-7).to_ordered().rows())


@query("WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, user_id AS value FROM events) SELECT idx, value FROM r WHERE idx < (SELECT min(idx) FROM r WHERE value % 50 = 0)")
def take_while(spark, sf_dir):
    return named(events(spark, sf_dir, "user_id").take_while(lambda v: v % 50 != 0).rows())


@query("WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, user_id AS value FROM events), f AS (SELECT min(idx) AS f FROM r WHERE value % 50 = 0) SELECT idx - f AS idx, value FROM r, f WHERE idx >= f")
def drop_while(spark, sf_dir):
    return named(events(spark, sf_dir, "user_id").drop_while(lambda v: v % 50 != 0).rows())


@query("SELECT row_number() OVER (ORDER BY b, k) - 1 AS idx, v AS value FROM (SELECT 0 AS b, c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier UNION ALL SELECT 2, 0, 'last')")
def concat_streams(spark, sf_dir):
    a = Stream.of(table(spark, sf_dir, "customer"), "c_name", "c_custkey")
    b = Stream.of(table(spark, sf_dir, "supplier"), "s_name", "s_suppkey")
    return named(a.concatenate(b).concatenate("last").rows())


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx, o_totalprice AS value FROM orders")
def sort_stable(spark, sf_dir):
    return named(Stream.of(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey").sort().rows())


@query("SELECT row_number() OVER (ORDER BY length(o_orderpriority), o_orderkey) - 1 AS idx, o_orderpriority AS value FROM orders")
def sort_by_key(spark, sf_dir):
    return named(Stream.of(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey").sort(lambda v: F.length(v)).rows())


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS idx, o_totalprice AS value FROM orders")
def sort_descending(spark, sf_dir):
    return named(Stream.of(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey").sort(descending=True).rows())


@query("SELECT row_number() OVER (ORDER BY p_name DESC, p_partkey) - 1 AS idx, p_name AS value FROM part")
def sort_text_descending(spark, sf_dir):
    return named(Stream.of(table(spark, sf_dir, "part"), "p_name", "p_partkey").sort(descending=True).rows())


@query("SELECT row_number() OVER (ORDER BY length(p_name), p_size DESC, p_partkey) - 1 AS idx, p_name AS value FROM part")
def sort_by_comparison(spark, sf_dir):
    first = lambda a, b: F.when(F.length(a["p_name"]) != F.length(b["p_name"]), F.length(a["p_name"]) - F.length(b["p_name"])).otherwise(b["p_size"] - a["p_size"])
    s = Stream.of(table(spark, sf_dir, "part"), F.struct("p_name", "p_size"), "p_partkey").sort(compare=first)
    return named(s.stream().map(lambda v: v["p_name"]).rows())


@query("SELECT row_number() OVER (ORDER BY first) - 1 AS idx, v AS value FROM (SELECT min(p_partkey) AS first, arg_min(p_name, p_partkey) AS v FROM part GROUP BY length(p_name))")
def distinct_by_comparison(spark, sf_dir):
    return named(Stream.of(table(spark, sf_dir, "part"), "p_name", "p_partkey").distinct(compare=lambda a, b: F.length(a) - F.length(b)).rows())


# ---- terminals


@query("SELECT user_id, bool_and(value > 0.5) AS every, bool_or(value > 400) AS some, NOT bool_or(value > 300) AS none FROM events GROUP BY user_id")
def match_all_any_none(spark, sf_dir):
    o = events(spark, sf_dir, by="user_id").to_ordered()
    return o.matches(every=("all", lambda v: v > 0.5), some=("any", lambda v: v > 400), none=("none", lambda v: v > 300))


@query("SELECT user_id, bool_and(value > 0.5) AS every, bool_or(value > 400) AS some, NOT bool_or(value > 300) AS none FROM events GROUP BY user_id")
def match_one_by_one(spark, sf_dir):
    o = events(spark, sf_dir, by="user_id").to_ordered()
    return o.all_match(lambda v: v > 0.5, "every").join(o.any_match(lambda v: v > 400, "some"), "user_id").join(o.none_match(lambda v: v > 300, "none"), "user_id")


@query("SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, max(value) AS largest, min(value) AS smallest FROM events GROUP BY user_id")
def find_first_last(spark, sf_dir):
    return events(spark, sf_dir, by="user_id").to_ordered().ends()


@query("SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, max(value) AS largest, min(value) AS smallest FROM events GROUP BY user_id")
def find_one_by_one(spark, sf_dir):
    o = events(spark, sf_dir, by="user_id").to_ordered()
    return o.find_first("first").join(o.find_last("last"), "user_id").join(o.find_maximum(name="largest"), "user_id").join(o.find_minimum(name="smallest"), "user_id")


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, max(CASE WHEN i = 3 THEN value END) AS third, max(CASE WHEN i = ((-2 % n) + n) % n THEN value END) AS back FROM r GROUP BY user_id")
def find_at_both_ends(spark, sf_dir):
    o = events(spark, sf_dir, by="user_id").to_ordered()
    return o.find_at(3, "third").join(o.find_at(-2, "back"), "user_id")


@query("SELECT event_type, arg_min(user_id, event_id) AS found FROM (SELECT *, max(user_id % 7) OVER (PARTITION BY event_type) AS m FROM events) WHERE user_id % 7 = m GROUP BY event_type")
def find_max_by_key(spark, sf_dir):
    return events(spark, sf_dir, "user_id", "event_type").to_ordered().find_maximum(lambda v: v % 7)


@query("SELECT event_type, arg_min(user_id, event_id) AS found FROM (SELECT *, min(user_id % 7) OVER (PARTITION BY event_type) AS m FROM events) WHERE user_id % 7 = m GROUP BY event_type")
def find_min_by_key(spark, sf_dir):
    return events(spark, sf_dir, "user_id", "event_type").to_ordered().find_minimum(lambda v: v % 7)


@query("SELECT event_type, (SELECT arg_min(user_id, (user_id % 7, event_id)) FROM events i WHERE i.event_type = o.event_type) AS least, (SELECT arg_min(user_id, (-(user_id % 7), event_id)) FROM events i WHERE i.event_type = o.event_type) AS most FROM events o GROUP BY event_type")
def find_by_comparison(spark, sf_dir):
    o = events(spark, sf_dir, "user_id", "event_type").to_ordered()
    by = lambda a, b: a % 7 - b % 7
    return o.find_minimum(compare=by, name="least").join(o.find_maximum(compare=by, name="most"), "event_type")


@query("SELECT n_nationkey AS key, n_name AS found FROM nation")
def find_any(spark, sf_dir):
    """One value a key, so that there is but one to be found."""
    n = table(spark, sf_dir, "nation").withColumn("key", F.col("n_nationkey"))
    return Stream.of(n, "n_name", "n_nationkey", "key").to_unordered().find_any()


@query("SELECT event_type, round(sum(value * 2), 3) AS total, round(avg(value + 1), 6) AS mean, round(max(value * 3) - min(value * 3), 4) AS span, min(-value) AS low, max(-value) AS high FROM events GROUP BY event_type")
def mapped_aggregates(spark, sf_dir):
    o = events(spark, sf_dir, by="event_type").to_ordered()
    parts = (o.summate(lambda v: v * 2, "total"), o.average(lambda v: v + 1, "mean"), o.range(lambda v: v * 3, "span"), o.minimum(lambda v: -v, "low"), o.maximum(lambda v: -v, "high"))
    whole = functools.reduce(lambda a, b: a.join(b, "event_type"), parts)
    return whole.select("event_type", F.round("total", 3).alias("total"), F.round("mean", 6).alias("mean"), F.round("span", 4).alias("span"), "low", "high")


@query("SELECT event_type, round(var_pop(value * 2), 3) AS variance, round(stddev_pop(value * 2), 6) AS sd, round(quantile_cont(value * 2, 0.5), 6) AS median, round(quantile_cont(value * 2, 0.1), 6) AS tenth FROM events GROUP BY event_type")
def mapped_statistics(spark, sf_dir):
    s = events(spark, sf_dir, by="event_type").to_statistics()
    f = lambda v: v * 2
    whole = functools.reduce(lambda a, b: a.join(b, "event_type"), (s.variance(f), s.standard_deviation(f, "sd"), s.median(f), s.percentile(10, f, "tenth")))
    return whole.select("event_type", F.round("variance", 3).alias("variance"), *[F.round(c, 6).alias(c) for c in ("sd", "median", "tenth")])


@query("SELECT CAST(sum(event_id % 97) AS BIGINT) AS total, CAST(-max(event_id % 97) AS BIGINT) AS turned FROM events")
def reduce_combined(spark, sf_dir):
    """Folds of runs, combined: no row holds the stream."""
    o = events(spark, sf_dir, F.col("event_id") % 97).to_ordered()
    zero, low = F.lit(0).cast("long"), F.lit(-1).cast("long")
    total = o.reduce(lambda a, x: a + x, zero, name="total", combine=lambda a, b: a + b)
    return total.select("total", o.reduce(F.greatest, low, lambda x: -x, combine=F.greatest).scalar().alias("turned"))


@query("WITH r AS (SELECT sum(event_id % 97) OVER (ORDER BY event_id) AS s, row_number() OVER (ORDER BY event_id) AS i FROM events) SELECT CAST(min(i) AS BIGINT) AS n, CAST(min(s) AS BIGINT) AS total FROM r WHERE s >= 20000")
def collect_until_python(spark, sf_dir):
    """Python functions with a stop that looks at the state: the values up to the first at which the sum is 20,000 or more."""
    c = Collector.shortable(lambda: (0, 0), lambda a, v: a[1] >= 20000, lambda a, v: (a[0] + 1, a[1] + int(v)))
    n, total = events(spark, sf_dir, F.col("event_id") % 97).to_ordered().collect(c)
    return spark.createDataFrame([(n, total)], "n long, total long")


@query("SELECT count(*) AS n, max(value) AS biggest FROM events")
def collect_python(spark, sf_dir):
    c = Collector.full(lambda: (0, 0.0), lambda a, v: (a[0] + 1, max(a[1], v)), lambda a, b: (a[0] + b[0], max(a[1], b[1])))
    return spark.createDataFrame([events(spark, sf_dir).to_ordered().collect(c)], "n long, biggest double")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS square FROM embeddings")
def collect_arrays(spark, sf_dir):
    c = Collector.full(lambda: F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"), columns=True)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(c.of(F.col("embedding")), 5).alias("square"))


@query("SELECT user_id, event_type, value FROM events WHERE event_id % 500 = 0")
def jobs_side_by_side(spark, sf_dir):
    """A job a type of event, on a pool of threads."""
    e = table(spark, sf_dir, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]
    with Jobs(spark, 3) as jobs:
        parts = [jobs.submit(lambda k: e.where((F.col("event_type") == k) & (F.col("event_id") % 500 == 0)).select("user_id", "event_type", "value").collect(), k) for k in kinds]
    return spark.createDataFrame([tuple(r) for p in parts for r in p.result()], "user_id long, event_type string, value double")


@query("SELECT count(*) AS count, CAST(sum(user_id) AS BIGINT) AS sum, round(avg(user_id), 6) AS average, max(user_id) - min(user_id) AS range, min(user_id) AS minimum, max(user_id) AS maximum, count(*) = 0 AS empty FROM events")
def count_sum_avg_range(spark, sf_dir):
    s = Statistics(events(spark, sf_dir, "user_id")).summary()
    return s.select("count", "sum", F.round("average", 6).alias("average"), "range", "minimum", "maximum", (F.col("count") == 0).alias("empty"))


@query("SELECT user_id, CAST(sum(v) AS BIGINT) AS total, max(s) AS folded FROM (SELECT user_id, event_id % 97 AS v, NULL::BIGINT AS s FROM events UNION ALL SELECT user_id, 0, list_reduce(list_prepend(CAST(7 AS BIGINT), list(event_id % 97 ORDER BY event_id)), lambda a, x: (a * 31 + x) % 1000003) FROM events GROUP BY user_id) GROUP BY user_id")
def reduce_fold(spark, sf_dir):
    o = events(spark, sf_dir, F.col("event_id") % 97, "user_id").to_ordered()
    return o.reduce(lambda a, x: a + x, name="total").join(o.reduce(lambda a, x: (a * 31 + x) % 1000003, F.lit(7).cast("long"), name="folded"), "user_id")


@query("SELECT user_id, CAST(sum(v) AS BIGINT) AS collected FROM (SELECT user_id, event_id % 97 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE i < 5 GROUP BY user_id")
def collect_until(spark, sf_dir):
    c = Collector.shortable(lambda: F.lit(0).cast("long"), lambda a, v, i: i >= 5, lambda a, v: a + v, columns=True)
    return events(spark, sf_dir, F.col("event_id") % 97, "user_id").to_ordered().collect(c)


@query("SELECT event_type, max(value) AS biggest, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def collect_columns(spark, sf_dir):
    start = lambda: F.struct(F.lit(float("-inf")).alias("m"), F.lit(0).cast("long").alias("n"))
    c = Collector.full(start, lambda a, v: F.struct(F.greatest(a["m"], v).alias("m"), (a["n"] + 1).alias("n")), columns=True)
    return events(spark, sf_dir, by="event_type").to_ordered().collect(c).select("event_type", F.col("collected.m").alias("biggest"), F.col("collected.n").alias("n"))


@query("SELECT event_type AS key, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY event_type")
def group_values(spark, sf_dir):
    g = Stream.of(table(spark, sf_dir, "events"), F.struct("event_type", "event_id"), "event_id").to_ordered()
    return g.group(lambda v: v["event_type"]).select("key", F.array_join(F.transform("values", lambda v: v["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT event_type AS key, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id) AS users FROM events GROUP BY event_type")
def group_by_values(spark, sf_dir):
    g = Stream.of(table(spark, sf_dir, "events"), F.struct("event_type", "user_id"), "event_id").to_ordered()
    return g.group_by(lambda v: v["event_type"], lambda v: v["user_id"].cast("string")).select("key", F.array_join("values", ",").alias("users"))


@query("SELECT i // 250 AS chunk, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY i) AS users FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1")
def partition_chunks(spark, sf_dir):
    return events(spark, sf_dir, F.col("user_id").cast("string")).to_ordered().partition(250).select("chunk", F.array_join("values", ",").alias("users"))


@query("SELECT user_id % 8 AS key, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id) AS users FROM events GROUP BY 1")
def partition_by_key(spark, sf_dir):
    return events(spark, sf_dir, "user_id").to_ordered().partition_by(lambda v: v % 8, lambda v: v.cast("string")).select("key", F.array_join("values", ",").alias("users"))


def flat_text(df: DataFrame) -> DataFrame:
    return df.select(F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("joined"))


@query("SELECT array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS joined FROM part")
def to_set(spark, sf_dir):
    return flat_text(Stream.of(table(spark, sf_dir, "part"), "p_brand", "p_partkey").to_unordered().to_set())


@query("SELECT array_to_string(list_sort(list(p_size)), ',') AS joined FROM part")
def to_multiset(spark, sf_dir):
    return flat_text(Stream.of(table(spark, sf_dir, "part"), "p_size", "p_partkey").to_unordered().to_multiset())


@query("SELECT p_size AS size, count(*) AS n FROM part GROUP BY p_size")
def to_unordered_multiset(spark, sf_dir):
    got = Stream.of(table(spark, sf_dir, "part"), "p_size", "p_partkey").to_unordered().to_unordered_multiset()
    return got.select(F.explode("values").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand AS brand, n FROM part, (SELECT count(DISTINCT p_brand) AS n FROM part)")
def to_unordered_set(spark, sf_dir):
    got = Stream.of(table(spark, sf_dir, "part"), "p_brand", "p_partkey").to_unordered().to_unordered_set()
    return got.select(long_(F.size("values")).alias("n"), F.explode("values").alias("brand"))


@query("SELECT user_id % 10 AS key, arg_max(user_id, event_id) AS value FROM events GROUP BY 1")
def to_map_of_values(spark, sf_dir):
    o = Stream.of(table(spark, sf_dir, "events"), "user_id", "event_id").to_ordered()
    return o.to_map(lambda v: v % 10).select(F.explode("map").alias("key", "value"))


@query("SELECT user_id % 8 AS key, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id) AS users FROM events GROUP BY 1")
def partition_of_values(spark, sf_dir):
    got = events(spark, sf_dir, "user_id").to_ordered().partition_by(lambda v: v % 8)
    return got.select("key", F.array_join(F.col("values").cast("array<string>"), ",").alias("users"))


@query("SELECT array_to_string(list_reverse_sort(list(p_size)), ',') AS joined FROM part")
def to_priority_queue(spark, sf_dir):
    return flat_text(Stream.of(table(spark, sf_dir, "part"), "p_size", "p_partkey").to_unordered().to_priority_queue())


@query("SELECT array_to_string(list(p_brand ORDER BY p_partkey DESC), ',') AS joined FROM part")
def to_stack(spark, sf_dir):
    return flat_text(Stream.of(table(spark, sf_dir, "part"), "p_brand", "p_partkey").to_ordered().to_stack())


@query("SELECT array_to_string(list(p_brand ORDER BY p_partkey), ',') AS joined FROM part")
def to_vector(spark, sf_dir):
    return flat_text(Stream.of(table(spark, sf_dir, "part"), "p_brand", "p_partkey").to_ordered().to_vector())


@query("SELECT string_agg(coalesce(s, '-'), ',' ORDER BY i) AS joined FROM range(0, 30) t(i) LEFT JOIN (SELECT n_name AS s, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) ON i = k")
def to_array_n(spark, sf_dir):
    got = Stream.of(table(spark, sf_dir, "nation"), "n_name", "n_nationkey").to_ordered().to_array(30)
    return got.select(F.array_join("values", ",", "-").alias("joined"))


@query("SELECT user_id % 10 AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def to_map_last_wins(spark, sf_dir):
    o = Stream.of(table(spark, sf_dir, "events"), F.struct("user_id", "value"), "event_id").to_ordered()
    return o.to_map(lambda v: v["user_id"] % 10, lambda v: v["value"]).select(F.explode("map").alias("key", "value"))


@query("SELECT p_brand AS key, array_to_string(list(p_size ORDER BY p_partkey), ',') AS joined FROM part GROUP BY p_brand")
def to_multimap(spark, sf_dir):
    o = Stream.of(table(spark, sf_dir, "part"), F.struct("p_brand", "p_size"), "p_partkey").to_ordered()
    return o.to_multimap(lambda v: v["p_brand"], lambda v: v["p_size"].cast("string")).select("key", F.array_join("values", ",").alias("joined"))


# ---- text joins


@query("SELECT r_regionkey AS region, '[' || string_agg(n_name, ',' ORDER BY n_nationkey) || ']' AS joined FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def join_text(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("region", F.col("n_regionkey"))
    return Stream.of(n, "n_name", "n_nationkey", "region").to_ordered().join()


@query("SELECT n_regionkey AS region, '<' || string_agg(CAST(n_nationkey AS VARCHAR), ' - ' ORDER BY n_nationkey) || '>' AS joined FROM nation GROUP BY n_regionkey")
def join_custom(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("region", F.col("n_regionkey"))
    return Stream.of(n, "n_nationkey", "n_nationkey", "region").to_ordered().join(" - ", "<", ">")


@query("SELECT n_regionkey AS region, '{' || string_agg(n_nationkey || '=' || n_name, ',' ORDER BY n_nationkey) || '}' AS joined FROM nation GROUP BY n_regionkey")
def join_converted(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("region", F.col("n_regionkey"))
    s = Stream.of(n, F.struct("n_nationkey", "n_name"), "n_nationkey", "region").to_ordered()
    return s.join(prefix="{", suffix="}", convert=lambda v: F.concat(v["n_nationkey"].cast("string"), F.lit("="), v["n_name"]))


@query("SELECT '<' || string_agg(n_name, '|' ORDER BY n_nationkey) || '>' AS printed, true AS failed FROM nation")
def printed(spark, sf_dir):
    """What out() and error() write on the driver."""
    o, out, err = Stream.of(table(spark, sf_dir, "nation"), "n_name", "n_nationkey").to_ordered(), io.StringIO(), io.StringIO()
    o.out("|", "<", ">", file=out)
    with contextlib.redirect_stderr(err):
        o.error("|", "<", ">")
    return spark.createDataFrame([(out.getvalue().rstrip("\n"), err.getvalue() == out.getvalue())], "printed string, failed boolean")


@query("SELECT CAST(sum(user_id) AS BIGINT) AS total FROM events")
def for_each_value(spark, sf_dir):
    """A consumer on the executors, which adds up what it is given."""
    total = spark.sparkContext.accumulator(0)
    events(spark, sf_dir, "user_id").to_ordered().for_each(lambda v: total.add(v))
    return spark.createDataFrame([(total.value,)], "total long")


# ---- statistics

@query("SELECT l_returnflag, round(var_pop(x), 2) AS variance, round(stddev_pop(x), 6) AS sd, round(skewness(x) * pow(n / (n - 1.0), 1.5), 6) AS skew, round(kurtosis(x), 6) AS kurt FROM (SELECT l_returnflag, l_extendedprice AS x, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY l_returnflag, n")
def stats_moments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = Statistics(Stream.of(li, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_returnflag")).summary()
    return s.select("l_returnflag", F.round("variance", 2).alias("variance"), F.round("standard_deviation", 6).alias("sd"), F.round("skewness", 6).alias("skew"), F.round("kurtosis", 6).alias("kurt"))


@query("SELECT round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem")
def stats_percentiles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = Statistics(Stream.of(li, "l_quantity", key)).median()
    b = Statistics(Stream.of(li, "l_extendedprice", key)).percentile(90, name="p90")
    return a.select(F.round("median", 6).alias("median"), F.round(b.scalar(), 6).alias("p90"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY event_type")
def stats_quartiles(spark, sf_dir):
    s = events(spark, sf_dir, by="event_type").to_statistics().quartiles()
    return s.select("event_type", F.round("first_quartile", 6).alias("q1"), F.round("third_quartile", 6).alias("q3"), F.round("interquartile_range", 6).alias("iqr"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY event_type")
def stats_quartiles_one_by_one(spark, sf_dir):
    s = events(spark, sf_dir, by="event_type").to_statistics()
    j = s.first_quartile(name="q1").join(s.third_quartile(name="q3"), "event_type").join(s.interquartile_range(name="iqr"), "event_type")
    return j.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "iqr")])


@query("SELECT event_type, min(user_id) AS mode FROM (SELECT event_type, user_id, count(*) AS n, max(count(*)) OVER (PARTITION BY event_type) AS m FROM events GROUP BY event_type, user_id) WHERE n = m GROUP BY event_type")
def stats_mode(spark, sf_dir):
    return events(spark, sf_dir, "user_id", "event_type").to_statistics().mode()


@query("SELECT event_type AS key, array_to_string(list(i ORDER BY i), ',') AS places, max(n) AS span FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) GROUP BY event_type")
def stats_frequency(spark, sf_dir):
    got = events(spark, sf_dir, "event_type").to_statistics().frequency()
    return got.select("key", F.array_join(F.transform("counts", lambda x: x["re"].cast("long").cast("string")), ",").alias("places"), F.element_at("spans", -1)["im"].cast("long").alias("span"))


@query("""
WITH k AS (SELECT user_id AS key, CAST(sum(i) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS c FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY user_id),
ms AS (SELECT s AS ms FROM k GROUP BY s ORDER BY count(*) DESC, s LIMIT 1), mc AS (SELECT c AS mc FROM k GROUP BY c ORDER BY count(*) DESC, c LIMIT 1),
d AS (SELECT sqrt(avg(pow(s - ms, 2))) AS ds, sqrt(avg(pow(c - mc, 2))) AS dc FROM k, ms, mc)
SELECT key, round((s - ms) / CASE WHEN ds < 0.001 THEN 1 ELSE ds END, 6) AS re, round((c - mc) / CASE WHEN dc < 0.001 THEN 1 ELSE dc END, 6) AS im FROM k, ms, mc, d
""")
def stats_distribution(spark, sf_dir):
    got = events(spark, sf_dir, "user_id").to_statistics().distribute()
    return got.select("key", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


# ---- windows


@query("SELECT i // 100 AS win, round(avg(value), 6) AS average, count(*) AS n FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1")
def tumble_avg(spark, sf_dir):
    w = events(spark, sf_dir).to_window().tumble(100).agg(F.round(F.avg("value"), 6).alias("average"), F.count("*").alias("n"))
    return w.withColumnRenamed("_win", "win")


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events), w AS (SELECT unnest(range(0, CAST((SELECT (count(*) + 29) // 30 FROM r) AS BIGINT))) AS win) SELECT win, round(avg(value), 6) AS average, count(*) AS n FROM w JOIN r ON i >= win * 30 AND i < win * 30 + 75 GROUP BY win")
def slide_avg(spark, sf_dir):
    w = events(spark, sf_dir).to_window().slide(75, 30).summary()
    return w.select(F.col("_win").alias("win"), F.round("average", 6).alias("average"), F.col("count").alias("n"))


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), w AS (SELECT user_id, unnest(range(0, CAST(max(i) // 2 + 1 AS BIGINT))) AS win FROM r GROUP BY user_id) SELECT user_id, win, count(*) AS n, max(value) AS top FROM w JOIN r USING (user_id) WHERE i >= win * 2 AND i < win * 2 + 7 GROUP BY user_id, win")
def slide_copies(spark, sf_dir):
    """Any aggregate: a row stands in each of its windows."""
    w = events(spark, sf_dir, by="user_id").to_window().slide(7, 2)
    return w.agg(F.count("*").alias("n"), F.max("value").alias("top")).withColumnRenamed("_win", "win")


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT user_id, i // 5 AS win, round(sum(value), 4) AS total, max(value) AS top FROM r GROUP BY 1, 2")
def grouped_tumble(spark, sf_dir):
    w = events(spark, sf_dir, by="user_id").to_window().tumble(5)
    return w.agg(F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top")).withColumnRenamed("_win", "win")


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT i // 40 AS win, round(quantile_cont(value, 0.5), 6) AS median FROM r WHERE i % 40 < 20 GROUP BY 1")
def window_statistics(spark, sf_dir):
    w = events(spark, sf_dir).to_window().slide(20, 40)
    return w.map(lambda x: x.to_statistics().median()).select(F.col("_win").alias("win"), F.round("median", 6).alias("median"))


# ---- signals

SPECTRUM = """
WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings),
k AS (SELECT unnest(range(0, 64)) AS k)
SELECT vec_id, k, round({scale} * sum(v * cos(2 * pi() * k * n / 64)), 5) + 0.0 AS re, round({sign} * {scale} * sum(v * sin(2 * pi() * k * n / 64)), 5) + 0.0 AS im FROM x, k GROUP BY vec_id, k
"""


def signal(spark, sf_dir, f, limit=None, places=5) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("n", "v"))
    e = e.where(F.col("n") < limit) if limit else e
    got = f(Stream.of(e, F.col("v").cast("double"), "n", "vec_id").to_statistics())
    return got.select("vec_id", "k", (F.round("re", places) + 0.0).alias("re"), (F.round("im", places) + 0.0).alias("im"))


@query(SPECTRUM.format(scale="1.0", sign="-1"))
def dft_vectors(spark, sf_dir):
    return signal(spark, sf_dir, lambda s: s.dft())


@query(SPECTRUM.format(scale="(1.0 / 64)", sign="1"))
def idft_vectors(spark, sf_dir):
    return signal(spark, sf_dir, lambda s: s.idft())


PADDED = SPECTRUM.replace("FROM embeddings)", "FROM embeddings), y AS (SELECT * FROM x WHERE n < 50)").replace("range(0, 64)", "range(0, 50)").replace("FROM x, k", "FROM y, k")


@query(PADDED.format(scale="1.0", sign="-1"))
def fft_padded(spark, sf_dir):
    return signal(spark, sf_dir, lambda s: s.fft(), 50)


@query(PADDED.format(scale="(1.0 / 50)", sign="1"))
def ifft_padded(spark, sf_dir):
    return signal(spark, sf_dir, lambda s: s.ifft(), 50)


# ---- text functions


@query("SELECT doc_id, sha256(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS upper, sha256(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lower FROM documents")
def text_case(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.sha2(text.to_upper(F.col("text")), 256).alias("upper"), F.sha2(text.to_lower(F.col("text")), 256).alias("lower"))


@query("SELECT doc_id, sha256(trim(chr(9) || ' ' || text || chr(10) || chr(12), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS trimmed FROM documents")
def text_trim(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.sha2(text.trim(F.concat(F.lit("\t "), "text", F.lit("\n\f"))), 256).alias("trimmed"))


@query("SELECT doc_id, CAST(CASE WHEN text <> '' THEN len(string_split(text, '. ')) ELSE 0 END AS INTEGER) AS fields, CASE WHEN text <> '' THEN string_split(text, '. ')[-1] END AS last FROM documents")
def text_split(spark, sf_dir):
    t = texts(spark, sf_dir).withColumn("f", F.coalesce(text.split(F.col("text"), ". "), F.expr("cast(array() as array<string>)")))
    return t.select("doc_id", F.size("f").alias("fields"), F.try_element_at("f", F.lit(-1)).alias("last"))


@query("SELECT doc_id, CAST(strpos(text, 'th') - 1 AS INTEGER) AS first, CAST(CASE WHEN strpos(text, 'th') = 0 THEN -1 ELSE length(text) - 2 - (strpos(reverse(text), 'ht') - 1) END AS INTEGER) AS last, CAST(length(text) AS INTEGER) AS size, contains(text, 'the') AS has, starts_with(text, 'T') AS starts, ends_with(text, '.') AS ends FROM documents")
def text_index(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", text.index_of(t, "th").alias("first"), text.last_index_of(t, "th").cast("int").alias("last"), text.size(t).alias("size"), text.contains(t, "the").alias("has"), text.starts_with(t, "T").alias("starts"), text.ends_with(t, ".").alias("ends"))


@query("SELECT doc_id, sha256(replace(text, 'e', '<E>')) AS every, sha256(regexp_replace(regexp_replace(text, 'e', '<E>'), 'e', '<E>')) AS two, CAST((length(text) - length(replace(text, 'an', ''))) // 2 AS INTEGER) AS n FROM documents")
def text_replace(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", F.sha2(text.replace(t, "e", "<E>"), 256).alias("every"), F.sha2(text.replace(t, "e", "<E>", 2), 256).alias("two"), text.count(t, "an").alias("n"))


@query("SELECT doc_id, substr(text, 6, 20) AS part, CASE WHEN text < 'M' THEN -1 WHEN text > 'M' THEN 1 ELSE 0 END AS side, substr(text, 1, 1) AS first FROM documents")
def text_sub(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", text.sub(t, 5, 20).alias("part"), text.compare(t, "M").alias("side"), F.when(text.size(t) > 0, text.at(t, 0)).otherwise(F.when(t.isNotNull(), F.lit(""))).alias("first"))


@query("SELECT doc_id, sha256(array_to_string(list_reverse([c for c in string_split(text, '') if c <> '']), '')) AS back, sha256(repeat(text, 3)) AS thrice FROM documents")
def text_reverse(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", F.sha2(text.reverse(t), 256).alias("back"), F.sha2(text.repeat(t, 3), 256).alias("thrice"))


@query("SELECT doc_id, length(text) AS n, sha256(array_to_string([unicode(c) for c in string_split(text, '') if c <> ''], ',')) AS points FROM documents")
def text_codepoints(spark, sf_dir):
    t = texts(spark, sf_dir).withColumn("p", text.code_points(F.col("text")))
    return t.select("doc_id", long_(F.size("p")).alias("n"), F.sha2(F.array_join(F.col("p").cast("array<string>"), ","), 256).alias("points"))


@query("SELECT doc_id, sha256(text) AS back, octet_length(encode(text)) AS utf8, CAST(2 * length(text) AS BIGINT) AS utf16, CAST(4 * length(text) AS BIGINT) AS utf32, sha256(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')) AS plain FROM documents")
def charset_roundtrip(spark, sf_dir):
    t = F.col("text")
    size = lambda cs: long_(F.octet_length(charset.encode(t, cs)))
    back = charset.decode_valid(charset.convert(charset.encode(t, "utf32"), "utf32", "utf8"))
    return texts(spark, sf_dir).select("doc_id", F.sha2(back, 256).alias("back"), size("utf8").alias("utf8"), size("utf16").alias("utf16"), size("utf32be").alias("utf32"), F.sha2(charset.decode_valid(charset.encode(t, "ascii"), "ascii"), 256).alias("plain"))


@query("SELECT doc_id, sha256('<' || text || '|' || text || '>') AS joined, sha256(array_to_string(string_split(text, ' '), '_')) AS swapped, text = '' AS empty FROM documents")
def text_concat_join(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", F.sha2(text.concat("<", t, "|", t, ">"), 256).alias("joined"), F.sha2(text.join(text.split_all(t, F.lit(" ")), "_"), 256).alias("swapped"), text.empty(t).alias("empty"))


@query("SELECT doc_id, CAST(strpos(text, chr(233)) - 1 AS INTEGER) AS accent, contains(text, chr(252)) AS umlaut, sha256(replace(text, chr(233), 'e')) AS plain FROM documents")
def text_with_charset(spark, sf_dir):
    """Arguments given as bytes in a charset."""
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", text.index_of(t, text.coded(b"\xe9", "latin1")).alias("accent"), text.contains(t, text.coded(b"\xfc\0", "utf16")).alias("umlaut"), F.sha2(text.replace(t, text.coded(b"\xe9", "latin1"), text.coded(b"e", "ascii")), 256).alias("plain"))


@query("SELECT CAST(p AS INTEGER) AS point, p BETWEEN 55296 AND 57343 AS surrogate, p BETWEEN 0 AND 1114111 AND NOT p BETWEEN 55296 AND 57343 AS valid FROM (SELECT unnest([-1, 0, 97, 55295, 55296, 57343, 57344, 1114111, 1114112]) AS p)")
def code_point_kinds(spark, sf_dir):
    points = sources.of(spark, -1, 0, 97, 55295, 55296, 57343, 57344, 1114111, 1114112).df.select(F.col("value").cast("int").alias("point"))
    return points.select("point", text.is_surrogate(F.col("point")).alias("surrogate"), text.is_valid_code_point(F.col("point")).alias("valid"))


@query("SELECT CAST(b AS INTEGER) AS byte, CASE WHEN b < 128 THEN 1 WHEN b < 192 THEN 0 WHEN b < 224 THEN 2 WHEN b < 240 THEN 3 WHEN b < 248 THEN 4 ELSE 0 END AS utf8, 2 AS utf16, 4 AS utf32, 1 AS latin1 FROM range(0, 256) t(b)")
def sequence_lengths(spark, sf_dir):
    rows = [(b, *(charset.sequence_length(b, c) for c in ("utf8", "utf16", "utf32", "latin1"))) for b in range(256)]
    return spark.createDataFrame(rows, "byte int, utf8 int, utf16 int, utf32 int, latin1 int")


@query("SELECT * FROM (VALUES ('61C328', 'utf8', 'a' || chr(65533) || '('), ('82F0BFE2', 'utf8', chr(65533) || chr(65533)), ('C080', 'utf8', chr(65533)), ('61E9', 'latin1', 'a' || chr(233)), ('61E9', 'ascii', 'a' || chr(65533)), ('00D86100', 'utf16', chr(65533) || 'a'), ('3DD800DE', 'utf16', chr(128512)), ('00D80000', 'utf32', chr(65533)), ('00000061', 'utf32be', 'a')) t(bytes, charset, said)")
def decode_malformed(spark, sf_dir):
    given = [("61C328", "utf8"), ("82F0BFE2", "utf8"), ("C080", "utf8"), ("61E9", "latin1"), ("61E9", "ascii"), ("00D86100", "utf16"), ("3DD800DE", "utf16"), ("00D80000", "utf32"), ("00000061", "utf32be")]
    rows = spark.createDataFrame(given, "bytes string, charset string")
    said = functools.reduce(lambda c, name: c.when(F.col("charset") == name, charset.decode(F.unhex("bytes"), name)), dict.fromkeys(c for _, c in given), F)
    return rows.withColumn("said", said)


@query("SELECT doc_id, sha256(text) AS back, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def decode_any(spark, sf_dir):
    """UTF-16 in big-endian order of unknown validity, and back; and UTF-8, whose valid rows never leave the JVM."""
    t = F.col("text")
    back = charset.decode(charset.encode(t, "utf16be"), "utf16be")
    return texts(spark, sf_dir).select("doc_id", F.sha2(charset.decode(charset.encode(back, "utf8"), "utf8"), 256).alias("back"), long_(F.octet_length(charset.encode(back, "utf8"))).alias("bytes"))


@query("SELECT * FROM (VALUES ('<ab1true2.5', '<ab', '1true2.5', CAST(8 AS BIGINT), '1true2.5x', true)) t(whole, taken, left_, size, longer, before)")
def byte_buffer(spark, sf_dir):
    b = buffers.Buffer("ab").append(1, True, 2.5).prepend("<")
    whole, taken = b.text(), b.read(3).decode()
    return spark.createDataFrame([(whole, taken, b.peek().decode(), len(b), (b + "x").text(), buffers.Buffer("z") < buffers.Buffer("aa"))], "whole string, taken string, left_ string, size long, longer string, before boolean")


@query("SELECT p_partkey, hex(encode('[' || substr(p_name, 1, 3) || '|' || substr(p_name, 4) || CAST(p_size AS VARCHAR) || ']')) AS built, CAST(octet_length(encode(p_name)) AS BIGINT) AS size FROM part")
def byte_builder(spark, sf_dir):
    b = F.encode("p_name", "UTF-8")
    built = buffers.append(buffers.append(buffers.prepend(buffers.insert(b, 3, "|"), "["), F.col("p_size"), "int"), "]")
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(built).alias("built"), long_(buffers.size(b)).alias("size"))


@query("SELECT p_partkey, true AS same, p_size = length(p_name) AS turned_same, p_size < length(p_name) AS before FROM part")
def structural_equality(spark, sf_dir):
    """Maps made in two orders are the same; with their values exchanged they are so only where those are equal."""
    of = lambda a, x, b, y: F.create_map(F.lit(a), x, F.lit(b), y)
    p = table(spark, sf_dir, "part").withColumn("n", F.length("p_name"))
    p = p.select("p_partkey", of("a", F.col("p_size"), "b", F.col("n")).alias("x"), of("b", F.col("n"), "a", F.col("p_size")).alias("y"), of("a", F.col("n"), "b", F.col("p_size")).alias("z"))
    kind = p.schema["x"].dataType
    hashed = lambda c: structures.structural_hash(F.col(c), kind)
    return p.select("p_partkey", (hashed("x") == hashed("y")).alias("same"), (hashed("x") == hashed("z")).alias("turned_same"), structures.less(F.col("x"), F.col("z"), kind).alias("before"))


@query("SELECT row_number() OVER (ORDER BY length(p_name), p_name, p_partkey) - 1 AS by_bytes, row_number() OVER (ORDER BY p_size % 2, CASE WHEN p_size % 2 = 1 THEN p_size END NULLS FIRST, CASE WHEN p_size % 2 = 0 THEN p_name END NULLS FIRST, p_partkey) - 1 AS by_tag, row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey) - 1 AS by_complex, p_partkey FROM part")
def structural_orders(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    place = lambda c: long_(F.row_number().over(Window.orderBy(c, "p_partkey")) - 1)
    odd = F.col("p_size") % 2
    return p.select(
        "p_partkey",
        place(structures.buffer_order(F.encode("p_name", "UTF-8"))).alias("by_bytes"),
        place(structures.variant_order(odd, F.when(odd == 1, F.col("p_size")), F.when(odd == 0, F.col("p_name")))).alias("by_tag"),
        place(structures.complex_order(F.col("p_size"), F.col("p_retailprice"))).alias("by_complex"),
    )


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS place FROM part")
def structural_bits(spark, sf_dir):
    place = F.row_number().over(Window.orderBy(structures.bits_order(F.col("p_size").cast("long"), 64), "p_partkey")) - 1
    return table(spark, sf_dir, "part").select("p_partkey", long_(place).alias("place"))


@query("SELECT CAST(n AS DOUBLE) AS n, CAST(s AS DOUBLE) AS s FROM (SELECT count(*) AS n, sum(n_nationkey) AS s FROM nation)")
def gradient_descent(spark, sf_dir):
    """The point nearest to (n, s), by descent from (0, 0)."""
    got = table(spark, sf_dir, "nation").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("s")).first()
    p = Statistics(sources.of(spark, 0.0, 0.0)).gradient(lambda x: [2 * (x[0] - got["n"]), 2 * (x[1] - got["s"])], 0.25, 500, 1e-12)
    return spark.createDataFrame([(round(p[0], 6), round(p[1], 6))], "n double, s double")


@query("SELECT CAST(3 AS DOUBLE) AS a, CAST(-1 AS DOUBLE) AS b")
def gradient_of_cost(spark, sf_dir):
    p = Statistics(sources.of(spark, 0.0, 0.0)).gradient(cost=lambda x: float((x[0] - 3) ** 2 + 2 * (x[1] + 1) ** 2), rate=0.1, rounds=500, tolerance=1e-9)
    return spark.createDataFrame([(round(p[0], 3), round(p[1], 3))], "a double, b double")


# ---- live streams, drained: each reads the events as a file source does that finds them at once


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)


def drained(df: DataFrame, mode: str) -> DataFrame:
    """What a live query gives until nothing is left."""
    name = f"drained_{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


@query("WITH r AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 10 AS win FROM events) SELECT event_type AS key, CAST(win AS BIGINT) AS window, round(sum(value), 4) AS total, round(avg(value), 6) AS average FROM r GROUP BY ALL HAVING count(*) = 10")
def live_count_windows(spark, sf_dir):
    got = drained(streaming.count_windows(live_events(spark, sf_dir), "event_type", "value", 10, "event_id"), "append")
    return got.select("key", "window", F.round("sum", 4).alias("total"), F.round("average", 6).alias("average"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def live_event_windows(spark, sf_dir):
    got = drained(streaming.event_windows(live_events(spark, sf_dir), "ts", "1 hour", "1 day", None, ["event_type"], F.count("*").alias("n"), F.max("value").alias("most")), "complete")
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "most")


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def live_running(spark, sf_dir):
    got = drained(streaming.running(live_events(spark, sf_dir), ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total")), "complete")
    return got.select("event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events")
def live_terminals(spark, sf_dir):
    """Terminals of the batch library over each micro-batch."""
    seen = []
    q = streaming.foreach_batch(live_events(spark, sf_dir), "user_id", "event_id", lambda o, _: seen.append((o.count().first()[0], o.summate().first()[0])), shared(spark, "live"))
    q.processAllAvailable()
    q.stop()
    return spark.createDataFrame([(sum(n for n, _ in seen), sum(t for _, t in seen))], "n long, total long")
