"""Statistics, signals, text, charsets, order and buffers."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone import Stream, sources, value
from rillstone.functions import buffers, charset, structures, text
from rillstone.operators import stats


def test_statistics(spark):
    s = sources.of(spark, 1.0, 2.0, 3.0, 10.0).to_statistics()
    assert [round(value(x), 5) for x in (s.variance(), s.standard_deviation(), s.skewness(), s.kurtosis())] == [12.5, 3.53553, 2.71529, 3.228]
    q = sources.of(spark, 1, 2, 3, 4).to_statistics()
    assert [round(value(x), 6) for x in (q.percentile(25), q.median(), q.percentile(75), q.percentile(90), q.interquartile_range())] == [1.75, 2.5, 3.25, 3.7, 1.5]
    assert value(sources.of(spark, 2, 1, 2, 1).to_statistics().mode()) == 1
    with pytest.raises(ValueError):
        q.percentile(101)


def test_frequency_and_distribution(spark):
    f = {r["key"]: r for r in sources.of(spark, "a", "b", "a").to_statistics().frequency().collect()}
    assert [(x["re"], x["im"]) for x in f["a"]["counts"]] == [(0, 1), (2, 1)] and [(x["re"], x["im"]) for x in f["a"]["spans"]] == [(0, 3), (2, 3)]
    assert [(x["re"], x["im"]) for x in f["b"]["spans"]] == [(1, 3)]
    d = {r["key"]: (round(r["re"], 6), round(r["im"], 6)) for r in sources.of(spark, "a", "b", "a", "c").to_statistics().distribute().collect()}
    assert d == {"a": (0.774597, 1.732051), "b": (0, 0), "c": (1.549193, 0)}


def spectrum(df):
    return np.array([complex(r["re"], r["im"]) for r in df.orderBy("k").collect()])


def test_transforms(spark):
    s = sources.of(spark, 1.0, 2.0, 3.0, 4.0).to_statistics()
    assert np.allclose(spectrum(s.dft()), [10, -2 + 2j, -2, -2 - 2j]) and np.allclose(spectrum(s.fft()), spectrum(s.dft()))
    t = sources.of(spark, 1.0, 2.0, 3.0).to_statistics()
    assert np.allclose(spectrum(t.fft()), [6, -2 - 2j, 2]) and np.allclose(spectrum(t.dft()), np.fft.fft([1, 2, 3]))
    assert np.allclose(spectrum(t.idft()), np.fft.ifft([1, 2, 3])) and np.allclose(spectrum(t.ifft()), np.fft.ifft([1, 2, 3], 4)[:3] * 4 / 3)


@pytest.mark.parametrize("n", [60, 64, 77])
def test_long_transforms_are_the_short_ones(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "_pos long, x double")
    p = 1 << (n - 1).bit_length()
    assert np.allclose(spectrum(stats.long_transform(rows, n, False, False)), np.fft.fft(x))
    assert np.allclose(spectrum(stats.long_transform(rows, n, False, True)), np.fft.ifft(x))
    assert np.allclose(spectrum(stats.long_transform(rows, n, True, False)), np.fft.fft(x, p)[:n])
    assert np.allclose(spectrum(stats.long_transform(rows, n, True, True)), np.fft.ifft(x, p)[:n] * p / n)


@pytest.mark.parametrize("n", [5, 61, 127])
def test_transforms_of_prime_length(spark, n, monkeypatch):
    x = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "_pos long, x double")
    assert np.allclose(spectrum(stats.chirped_transform(rows, n, False)), np.fft.fft(x))
    assert np.allclose(spectrum(stats.chirped_transform(rows, n, True)), np.fft.ifft(x))
    monkeypatch.setattr(stats, "ONE_TASK", 4)
    s = Stream.of(rows, "x", "_pos").to_statistics()
    assert np.allclose(spectrum(s.dft()), np.fft.fft(x))


def test_gradient(spark):
    s = sources.of(spark, 0.0, 0.0).to_statistics()
    assert np.allclose(s.gradient(lambda p: 2 * (p - np.array([1, 2])), 0.1), [1, 2], atol=1e-5)
    assert np.allclose(s.gradient(cost=lambda p: float(((p - 3) ** 2).sum()), rate=0.1), [3, 3], atol=1e-4)
    with pytest.raises(ValueError):
        s.gradient(lambda p: [1.0])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    t = F.lit("😀b😀")
    go = lambda c: one(spark, c)
    assert (go(text.size(t)), go(text.index_of(t, "b")), go(text.last_index_of(t, "😀")), go(text.index_of(t, "😀", 1))) == (3, 1, 2, 2)
    assert (go(text.index_of(t, "")), go(text.last_index_of(t, "")), go(text.index_of(t, "z")), go(text.last_index_of(t, "z"))) == (0, 3, -1, -1)
    assert go(text.last_index_of(F.lit("abab"), "ab", 1)) == 0
    assert go(text.replace(F.lit("a-b-c"), "-", "+", 5)) == "a+b+c" and go(text.replace(F.lit("a-b-c"), "-", "+", 1)) == "a+b-c" and go(text.replace(F.lit("abc"), "", "x")) == "abc"
    assert go(text.to_upper(F.lit("éa"))) == "éA" and go(text.to_lower(F.lit("ÉA"))) == "Éa"
    assert go(text.split(F.lit("a,b,"), ",")) == ["a", "b", ""] and go(text.split(F.lit(""), ",")) == [] and go(text.split(F.lit("a\\Eb"), "\\E")) == ["a", "b"]
    assert go(text.count(F.lit("aaaa"), "aa")) == 2 and go(text.count(F.lit("a"), "")) == 0
    assert go(text.trim(F.lit("\t x \u000b\f"))) == "x" and go(text.sub(F.lit("abc"), 1, 9)) == "bc" and go(text.sub(F.lit("abc"), 5, 1)) == ""
    assert go(text.of_code_points(F.array(*[F.lit(x) for x in (0x61, 0xE9, 0x1F600, 9, 0x20AC)]))) == "aé😀\t€"
    assert go(text.code_points(t)) == [128512, 98, 128512] and go(text.at(t, 1)) == "b"
    with pytest.raises(Exception, match="out of range"):
        go(text.at(t, 3))
    with pytest.raises(ValueError):
        text.split(t, "")


def test_charsets(spark):
    go = lambda c: one(spark, c)
    s = F.lit("aé")
    assert [bytes(go(charset.encode(s, c))) for c in ("ascii", "latin1", "utf16", "utf32")] == [b"a?", b"a\xe9", b"a\0\xe9\0", b"a\0\0\0\xe9\0\0\0"]
    bad = [b"a\xc3(", b"\x82\xf0\xbf\xe2", b"ok\xed\xa0\x80x", b"\xc0\x80", b"\xf5\x80\x80\x80", b""]
    want = ["a�(", "��", "ok�x", "�", "�", ""]
    rows = spark.createDataFrame([(b,) for b in bad], "b binary").select(charset.decode(F.col("b")).alias("s")).collect()
    assert [r["s"] for r in rows] == want
    whole = "aé😀"
    for c in ("utf8", "utf16", "utf16be", "utf32", "utf32be"):
        assert go(charset.decode(charset.encode(F.lit(whole), c), c)) == whole
        assert charset.decoded(bytes(go(charset.encode(F.lit(whole), c))), c) == whole
    assert bytes(go(charset.convert(F.lit(b"\xe9"), "latin1", "utf8"))) == "é".encode()
    with pytest.raises(ValueError):
        charset.encode(s, "ebcdic")


def test_structures(spark):
    kind = T.MapType(T.StringType(), T.ArrayType(T.LongType()))
    rows = spark.createDataFrame([({"a": [1], "b": [2]}, {"b": [2], "a": [1]})], T.StructType([T.StructField("x", kind), T.StructField("y", kind)]))
    r = rows.select((structures.structural_hash(F.col("x"), kind) == structures.structural_hash(F.col("y"), kind)).alias("same"), structures.less(F.col("x"), F.col("y"), kind).alias("less")).first()
    assert (r["same"], r["less"]) == (True, False)
    assert one(spark, structures.buffer_order(F.lit(b"z")) < structures.buffer_order(F.lit(b"aa")))


def test_buffers(spark):
    b = buffers.Buffer("ab").append(1, True, 2.5).prepend("<")
    assert b.read(3) == b"<ab" and b.peek() == b"1true2.5" and len(b) == 8 and (b + "x").text() == "1true2.5x"
    assert buffers.Buffer("z") < buffers.Buffer("aa")
    lines = buffers.Buffer("a\nb\nc")
    assert list(lines.lines()) == [b"a", b"b"] and lines.peek() == b"c" and lines.capacity >= 1
    lines.shrink_to_fit()
    assert lines.atomically(len) == 1
    assert bytes(one(spark, buffers.insert(F.lit(b"ac"), 9, "b"))) == b"acb" and bytes(one(spark, buffers.insert(F.lit(b"ac"), 1, "b"))) == b"abc"


def test_summary_is_one_pass(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("v"))
    plan = stats.Statistics(Stream.of(df, "v", "id")).summary()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_jobs(spark):
    from rillstone.plans import Jobs

    with Jobs(spark, 2) as jobs:
        done = [jobs.submit(lambda n: spark.range(n).count(), n) for n in (3, 5, 7)]
        jobs.increase()
        failed = jobs.submit(lambda: 1 / 0)
        jobs.decrease(5)
        assert [f.result() for f in done] == [3, 5, 7] and jobs.threads == 1
        with pytest.raises(ZeroDivisionError):
            failed.result()
    with pytest.raises(RuntimeError):
        jobs.submit(len, "x")
    Jobs(spark).emergency_shutdown()
