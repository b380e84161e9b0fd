"""Index rules against a small list model, and the vectors that state them."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone import Collector, Stream, sources, value
from rillstone.plans.index import dense_index


class Model:
    """A stream as a list of (value, index) in stream order."""

    def __init__(self, rows):
        self.rows = rows

    def dense(self, values):
        return Model([(v, i) for i, v in enumerate(values)])

    def step(self, name, k):
        rows = self.rows
        values = [v for v, _ in rows]
        if name == "map":
            return Model([(v * 2 + k, i) for v, i in rows])
        if name == "redirect":
            return Model([(v + i, i) for v, i in rows])
        if name == "filter":
            return self.dense([v for v in values if v % (k + 2) != 0])
        if name == "filter_index":
            return self.dense([v for v, i in rows if i % (k + 2) != 0])
        if name == "distinct":
            return self.dense(list(dict.fromkeys(values)))
        if name == "limit":
            return self.dense(values[:k])
        if name == "skip":
            return Model([(v, p) for p, v in enumerate(values) if p >= k])
        if name == "sub":
            return Model([(v, p) for p, v in enumerate(values) if k <= p < 2 * k + 2])
        if name in ("take_while", "drop_while"):
            n = next((p for p, v in enumerate(values) if v % (k + 3) == 1), len(values))
            return Model(rows[:n]) if name == "take_while" else self.dense(values[n:])
        if name == "reverse":
            return Model([(v, -i) for v, i in rows])
        if name == "translate":
            return Model([(v, i + k - 3) for v, i in rows])
        if name == "reindex":
            return Model([(v, i * 2 + 1) for v, i in rows])
        if name == "flat_map":
            return self.dense([x for v in values for x in (v, v + 1)])
        if name == "concatenate":
            return self.dense([*values, 7, 8])
        if name == "ordered":
            n = len(rows)
            return Model(sorted(((v, i % n) for v, i in rows), key=lambda r: r[1]))
        if name == "sort":
            return self.dense(sorted(values))
        raise AssertionError(name)


def step(s, name, k):
    return {
        "map": lambda: s.map(lambda v: v * 2 + k),
        "redirect": lambda: s.redirect(lambda v, i: v + i),
        "filter": lambda: s.filter(lambda v: F.pmod(v, F.lit(k + 2)) != 0),
        "filter_index": lambda: s.filter(lambda v, i: F.pmod(i, F.lit(k + 2)) != 0),
        "distinct": lambda: s.distinct(),
        "limit": lambda: s.limit(k),
        "skip": lambda: s.skip(k),
        "sub": lambda: s.sub(k, 2 * k + 2),
        "take_while": lambda: s.take_while(lambda v: F.pmod(v, F.lit(k + 3)) != 1),
        "drop_while": lambda: s.drop_while(lambda v: F.pmod(v, F.lit(k + 3)) != 1),
        "reverse": lambda: s.reverse(),
        "translate": lambda: s.translate(k - 3),
        "reindex": lambda: s.reindex(lambda v, i: i * 2 + 1),
        "flat_map": lambda: s.flat_map(lambda v: F.array(v, v + 1)),
        "concatenate": lambda: s.concatenate([7, 8]),
        "ordered": lambda: s.to_ordered().stream(),
        "sort": lambda: s.sort().stream(),
    }[name]()


NAMES = ["map", "redirect", "filter", "filter_index", "distinct", "limit", "skip", "sub", "take_while", "drop_while", "reverse", "translate", "reindex", "flat_map", "concatenate", "ordered", "sort"]


@settings(max_examples=25, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-9, 30), max_size=12), chain=st.lists(st.tuples(st.sampled_from(NAMES), st.integers(0, 5)), min_size=1, max_size=4))
def test_chains_follow_the_model(spark, values, chain):
    s, m = sources.of(spark, values, kind="long"), Model([(v, i) for i, v in enumerate(values)])
    for name, k in chain:
        s, m = step(s, name, k), m.step(name, k)
    assert sorted((r["value"], r["_idx"]) for r in s.rows().collect()) == sorted(m.rows)
    assert value(s.to_unordered().to_vector()) == [v for v, _ in m.rows]


def ordered(s):
    return value(s.to_ordered().to_vector())


def test_index_vectors(spark):
    abcd = sources.of(spark, "a", "b", "c", "d")
    assert ordered(abcd.reverse()) == ["a", "d", "c", "b"]
    assert ordered(abcd.reverse().translate(-1)) == ["d", "c", "b", "a"]
    assert ordered(abcd.translate(1)) == ["d", "a", "b", "c"]
    ten = sources.from_range(spark, 0, 10)
    assert ordered(ten.skip(3)) == [7, 8, 9, 3, 4, 5, 6]
    assert ordered(ten.sub(2, 5)) == [3, 4, 2]
    assert [r[1] for r in sorted((r["_idx"], r["value"]) for r in abcd.filter(lambda v: v != "b").rows().collect())] == ["a", "c", "d"]


def test_sources(spark):
    got = lambda s: ordered(s)
    assert got(sources.from_range(spark, 5, 0)) == [0, 1, 2, 3, 4]
    assert got(sources.from_range(spark, 5, 0, -2)) == [5, 3, 1]
    assert got(sources.from_range(spark, 0, 5, 0)) == [] and got(sources.from_range(spark, 0, 5, -1)) == []
    assert got(sources.from_range_closed(spark, 3, 1)) == [1, 2, 3] and got(sources.from_range_closed(spark, 0, 5, 2)) == [0, 2, 4]
    assert got(sources.iterate(spark, 1, lambda v: v * 2).take_while(lambda v: v < 40)) == [1, 2, 4, 8, 16, 32]
    assert got(sources.generate(spark, lambda: F.lit("q"), 3)) == ["q"] * 3 and got(sources.generate(spark, lambda: 5, 2)) == [5, 5]
    assert got(sources.blob(spark, "aé")) == [0x61, 0xC3, 0xA9] and got(sources.blob(spark, "abcd", 1, 99)) == [98, 99, 100] and got(sources.blob(spark, "")) == []
    assert got(sources.text(spark, "a,b,", ",")) == ["a", "b", ""] and got(sources.text(spark, "", ",")) == [] and got(sources.text(spark, "x")) == ["x"]
    assert got(sources.code_points(spark, "😀b", 0, 1)) == [128512] and got(sources.code_points(spark, b"\xe9", charset="latin1")) == [233]
    assert all(3 <= x < 4 for x in got(sources.random_values(spark, 4.0, 3.0, 20)))
    assert 1 <= sources.randomly(3, 1) <= 3 and sources.randomly() in (True, False)
    with pytest.raises(ValueError):
        sources.iterate(spark, 1, lambda v: v).map(lambda v: v).to_ordered()


def test_endless_streams_chain(spark):
    odd = sources.iterate(spark, F.lit(1).cast("long"), lambda v: v * 3 + 1).filter(lambda v: v % 2 == 1)
    chain = [1]
    while len(chain) < 20:
        chain.append(chain[-1] * 3 + 1)
    assert ordered(odd.limit(10)) == [v for v in chain if v % 2][:10]
    assert ordered(odd.sub(2, 5)) == sorted([v for v in chain if v % 2][2:5], key=lambda v: ([v for v in chain if v % 2].index(v)) % 3)
    assert ordered(sources.infinite(spark).flat_map(lambda v: F.array(v, -v)).skip(3).take_while(lambda v: v < 4)) != []
    assert value(sources.infinite(spark).map(lambda v: v * 5).filter(lambda v: v > 17).find_first()) == 20
    assert ordered(sources.infinite(spark).distinct(lambda v: F.floor(v / 10)).limit(3)) == [0, 10, 20]
    made = sources.random_values(spark, 0, 99).filter(lambda v: v % 2 == 0).limit(50).to_ordered()
    first = value(made.to_vector())
    assert len(first) == 50 and all(v % 2 == 0 for v in first) and first == value(made.to_vector())
    assert ordered(sources.infinite(spark).filter(lambda v: v > 3).limit(0)) == []
    with pytest.raises(ValueError):
        sources.generated.Unbounded(spark, lambda n: sources.from_range(spark, 0, n), most=100).filter(lambda v: v < 0).limit(1)


def test_long_chains(spark):
    want = [1]
    while len(want) < 1300:
        want.append((want[-1] * 31 + 7) % 10007)
    for n in (1, 511, 512, 513, 1024, 1300):
        assert ordered(sources.iterate(spark, 1, lambda v: (v * 31 + 7) % 10007, n)) == want[:n]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("three;four", encoding="utf-8")
    assert ordered(sources.lines(spark, str(tmp_path / "a.txt"))) == ["one", "two"]
    assert ordered(sources.records(spark, str(tmp_path / "b.txt"), ";")) == ["three", "four"]
    assert ordered(sources.text_file(spark, str(tmp_path / "b.txt"), ";")) == ["three", "four"]
    (tmp_path / "c.bin").write_bytes("é".encode("utf-16-le"))
    assert ordered(sources.text_file(spark, str(tmp_path / "c.bin"), charset="utf16")) == ["é"]


def test_many_tasks_number_like_one(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(r.randint(0, 50), i) for i in range(3000)], "a long, b long").repartition(7)
    want = {(x["a"], x["b"]): x["_idx"] for x in dense_index(rows, ("a", "b")).collect()}
    import rillstone.plans.index as plans

    per_task, plans.PER_TASK = plans.PER_TASK, 200
    try:
        got = {(x["a"], x["b"]): x["_idx"] for x in dense_index(rows, ("a", "b"), small=10).collect()}
    finally:
        plans.PER_TASK = per_task
    assert got == want and sorted(got.values()) == list(range(3000))
    keyed = rows.withColumn("k", F.when(F.col("b") % 3 > 0, F.lit("hot")).when(F.col("b") % 2 > 0, F.col("a").cast("string")))
    want = sorted((x["b"], x["_idx"]) for x in dense_index(keyed, ("a", "b"), ("k",)).collect())
    per_task, plans.PER_TASK = plans.PER_TASK, 200
    try:
        many = dense_index(keyed, ("a", "b"), ("k",), small=10)
        assert many.columns == [*keyed.columns, "_idx"] and sorted((x["b"], x["_idx"]) for x in many.collect()) == want
    finally:
        plans.PER_TASK = per_task


def test_partitions_do_not_matter(spark):
    base = spark.range(200).select("id", (F.col("id") * 37 % 101).alias("v"))
    seen = set()
    for n in (1, 2, 7):
        s = Stream.of(base.repartition(n), "v", "id").filter(lambda v: v % 3 != 0).reverse()
        o = s.to_ordered()
        seen.add((tuple(value(o.to_vector())), value(o.find_last()), value(o.reduce(lambda a, x: a * 3 % 1009 + x)), value(o.join(convert=lambda v: v))))
    assert len(seen) == 1


def test_terminals_on_nothing(spark):
    o = sources.empty(spark, "double").to_statistics()
    assert [value(x) for x in (o.all_match(lambda v: v > 0), o.any_match(lambda v: v > 0), o.none_match(lambda v: v > 0), o.count(), o.empty())] == [True, False, True, 0, True]
    assert [value(x) for x in (o.summate(), o.average(), o.range(), o.variance(), o.standard_deviation(), o.skewness(), o.kurtosis())] == [0] * 7
    assert [value(x) for x in (o.minimum(), o.maximum(), o.median(), o.percentile(30), o.mode(), o.find_first(), o.find_any(), o.find_at(0), o.find_at(-1), o.reduce(lambda a, b: a + b))] == [None] * 10
    assert value(o.join()) == "[]" and value(o.to_vector()) == []


def test_find_and_containers(spark):
    s = sources.of(spark, 3, 1, 2, 3).to_ordered()
    assert [value(s.find_at(k)) for k in (0, 3, 4, -1, -4, -5)] == [3, 3, None, 3, 3, 3]
    assert value(sources.of(spark, 0, 5, 7).to_ordered().range()) == 7
    assert (value(s.find_maximum()), value(s.find_minimum())) == (3, 1)
    assert value(s.to_multiset()) == [1, 2, 3, 3] and value(s.to_set()) == [1, 2, 3] and value(s.to_stack()) == [3, 2, 1, 3] and value(s.to_priority_queue()) == [3, 3, 2, 1]
    assert value(s.to_array(6)) == [3, 1, 2, 3, None, None]
    assert value(s.to_map(lambda v: v, lambda v, i: i)) == {1: 1, 2: 2, 3: 3}
    assert [r["values"] for r in sources.from_range(spark, 0, 7).to_ordered().partition(3).orderBy("chunk").collect()] == [[0, 1, 2], [3, 4, 5], [6]]
    assert sources.from_range(spark, 0, 7).to_ordered().partition(0).count() == 7


def test_sort_is_stable(spark):
    s = sources.of(spark, 3, 1, 2, 3).map(lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    assert [(x["v"], x["i"]) for x in value(s.sort(lambda v: v["v"]).to_vector())] == [(1, 1), (2, 2), (3, 0), (3, 3)]
    assert [x["i"] for x in value(s.sort(lambda v: v["v"], descending=True).to_vector())] == [0, 3, 2, 1]


def test_joined_text(spark):
    assert value(sources.of(spark, "", "a", "", "b").to_ordered().join()) == "[a,,b]"
    assert value(sources.of(spark, "a", "b").to_ordered().join("-", "<", ">")) == "<a-b>"
    assert value(sources.of(spark, True, False).to_ordered().join()) == "[true,false]"
    numbers = [1234567.0, 0.5, 100000.0, 999999.5, 0.0001, 0.00001234567, -2.0, 0.0, 123.4567891]
    assert value(sources.of(spark, *numbers).to_ordered().join()) == "[" + ",".join(f"{x:g}" for x in numbers) + "]"
    assert sources.of(spark, "x").to_ordered().out() == "[x]"


def test_windows(spark):
    six, seven = sources.from_range(spark, 0, 6), sources.from_range(spark, 0, 7)
    values = lambda w: [r["values"] for r in w.values().orderBy("_win").collect()]
    assert values(six.to_window().slide(3, 2)) == [[0, 1, 2], [2, 3, 4], [4, 5]]
    assert values(sources.from_range(spark, 0, 10).to_window().tumble(4)) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert values(seven.to_window().slide(2, 3)) == [[0, 1], [3, 4], [6]]
    assert values(six.to_window().slide(0, 1)) == []
    for size, step in ((3, 2), (4, 2), (2, 3), (1, 1), (9, 3), (0, 2), (7, 7)):
        w = seven.map(lambda v: v * v % 11).to_window().slide(size, step)
        want = {r["_win"]: r["values"] for r in w.values().collect()}
        got = {r["_win"]: (r["count"], r["sum"], r["average"], r["minimum"], r["maximum"]) for r in w.summary().collect()}
        assert got == {k: (len(v), sum(v), sum(v) / len(v), min(v), max(v)) for k, v in want.items()}
    assert ordered(six.to_window().slide(3, 2).flat()) == [0, 1, 2, 2, 3, 4, 4, 5]
    with pytest.raises(ValueError):
        six.to_window().slide(2, 0)


def test_collectors(spark):
    s = sources.of(spark, 5, 6, 7).parallel(3).to_ordered()
    c = Collector.full(list, lambda a, v, i: [*a, (i, v)], lambda a, b: a + b, tuple)
    assert s.collect(c) == ((0, 5), (1, 6), (2, 7))
    until = Collector.shortable(int, lambda a, v: a > 4, lambda a, v: a + v, lambda a, b: a + b)
    assert sources.of(spark, 5, 6, 7).to_ordered().collect(until) == 5
    assert sources.empty(spark).to_ordered().collect(c) == ()
    assert until.of([5, 6, 7]) == 5 and c.of(iter("ab")) == ((0, "a"), (1, "b"))


def test_a_stop_holds_on_any_partitions(spark):
    values = [3, 1, 2, 4, 5, 1, 1, 8, 9, 2, 7, 3]
    until = Collector.shortable(int, lambda a, v: a >= 10, lambda a, v: a + v, lambda a, b: a + b)
    turns = Collector.full(str, lambda a, v: f"({a}{v})")  # no combiner
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 4, 20):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            s = sources.of(spark, *values).to_ordered()
            assert s.collect(until) == 10
            assert s.collect(turns) == turns.of(values)
            assert sources.empty(spark).to_ordered().collect(until) == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_comparisons(spark):
    s = sources.of(spark, "bb", "a", "ccc", "aa", "b")
    by_size = lambda a, b: F.length(a) - F.length(b)
    assert value(s.sort(compare=by_size).to_vector()) == ["a", "b", "bb", "aa", "ccc"]
    assert ordered(s.distinct(compare=by_size)) == ["bb", "a", "ccc"]
    assert (value(s.to_ordered().find_maximum(compare=by_size)), value(s.to_ordered().find_minimum(compare=by_size))) == ("ccc", "a")
    assert value(s.sort(descending=True).to_vector()) == ["ccc", "bb", "b", "aa", "a"]
    least = -(1 << 63)
    assert value(sources.of(spark, 5, least, (1 << 63) - 1).sort(descending=True).to_vector()) == [(1 << 63) - 1, 5, least]
    many = spark.range(100).select("id", F.concat(F.lit("k"), F.col("id") % 7).alias("v"))
    assert value(Stream.of(many, "id", "v").to_ordered().find_maximum(lambda v: v % 10)) == 49
    o = Stream.of(many.where("id % 3 = 0"), F.col("id") * 10, ["v", "id"]).to_ordered()
    assert o.ends(lambda v: v % 40).first()[2:] == (value(o.find_minimum(lambda v: v % 40)), value(o.find_maximum(lambda v: v % 40)))


def test_combined_folds(spark, monkeypatch):
    import rillstone.operators.ordered as terminals

    monkeypatch.setattr(terminals, "CHUNK", 7)
    s = sources.from_range(spark, 0, 100).to_ordered()
    assert value(s.reduce(lambda a, x: a + x, F.lit(0).cast("long"), combine=lambda a, b: a + b)) == 4950
    assert value(s.reduce(F.greatest, combine=F.greatest)) == 99
    text = lambda v: v.cast("string")
    joined = s.s.map(text).to_ordered().reduce(lambda a, x: F.concat(a, x), combine=lambda a, b: F.concat(a, b), finish=lambda a: F.concat(a, F.lit(".")))
    assert value(joined) == "".join(map(str, range(100))) + "."
    assert value(sources.empty(spark).to_ordered().reduce(lambda a, x: a + x, F.lit(0).cast("long"), combine=lambda a, b: a + b)) == 0


def test_places_among_bounds(spark):
    from rillstone.plans.index import place_among

    for n in (1, 2, 3, 10, 50, 101):
        bounds = [3 * k for k in range(n)]
        got = [r["p"] for r in spark.range(-2, 3 * n + 2).select("id", place_among([F.lit(b).cast("long") for b in bounds], F.col("id")).alias("p")).orderBy("id").collect()]
        assert got == [sum(b <= x for b in bounds) for x in range(-2, 3 * n + 2)]


def test_ranks_are_closed_in_on(spark, monkeypatch):
    import rillstone.operators.stats as stats

    r = random.Random(3)
    values = [r.choice([0.0, -5.5, 1e9, r.gauss(0, 1)]) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 1, 700, 1500, 2999):
        assert stats.value_of_rank(rows, k, few=20) == sorted(values)[k]
    s = Stream.of(spark.createDataFrame(list(enumerate(values)), "i long, v double"), "v", "i").to_statistics()
    want = [value(s.percentile(p)) for p in (0, 12.5, 50, 99.9, 100)]
    monkeypatch.setattr(stats, "COUNTED", 10)
    assert [value(s.percentile(p)) for p in (0, 12.5, 50, 99.9, 100)] == pytest.approx(want)
    assert value(sources.empty(spark, "double").to_statistics().median()) is None


def test_peek_and_foreach(spark, tmp_path):
    def note(v):
        (tmp_path / f"seen{v}").write_text("x")

    sources.of(spark, 1, 2).peek(note).to_ordered().count().collect()
    sources.of(spark, 3).to_ordered().for_each(note)
    assert sorted(p.name for p in tmp_path.iterdir())[-1] == "seen3"


def test_concatenate_and_flat(spark):
    a = sources.of(spark, 1, 2).concatenate(sources.of(spark, 3)).concatenate([4, 5]).concatenate(6)
    assert ordered(a) == [1, 2, 3, 4, 5, 6]
    assert ordered(sources.of(spark, [[1, 2], [], [3]], kind="array<long>").flat()) == [1, 2, 3]
    assert ordered(sources.of(spark, [[1, 2], [3]], kind="array<long>").flat().limit(1)) == [1]
    assert ordered(sources.of(spark, 1, 2, 3).map(lambda v: v).limit(0)) == []
