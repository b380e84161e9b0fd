"""The pipeline's stages against plain versions, near copies by brute force, and the classifier on labels it has not seen."""

import collections
import math
import os
import random
import struct

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rillstone.llm import linededup, quality, simhash
from rillstone.llm.common import components
from rillstone.llm.queries import vocabulary
from tests.llm.test_operators import plain_redaction

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def near_by_force(texts, similarity=0.8, shingle=5):
    """{id: smallest id of its near copies}, and the near pairs of different texts, by counting shared shingles.

    Texts of the same shingles are one. Two that are near share one of the
    rarest shingles, so many of each as may be missing from the other and one.
    """
    sets = {d: frozenset(simhash.shingle_hashes(t, shingle).tolist()) for d, t in texts.items()}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    often = collections.Counter(x for s in first for x in s)
    holds, pairs = collections.defaultdict(list), set()
    for s, d in first.items():
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
        for other in {d2 for x in rare for d2 in holds[x]}:
            both = len(s & sets[other])
            if both >= similarity * (len(s) + len(sets[other]) - both):
                pairs.add((min(d, other), max(d, other)))
        for x in rare:
            holds[x].append(d)
    root = {d: first[sets[d]] for d in texts}
    for a, b in pairs:
        x, y = find(root, a), find(root, b)
        root[max(x, y)] = min(x, y)
    return {d: find(root, d) for d in texts}, pairs


def test_buckets_are_gone_through_in_blocks(spark, monkeypatch):
    """Blocks of three nodes, and sketches that tell nothing: every near pair that meets is found all the same."""
    r = random.Random(9)
    texts = {}
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(120)]
        for _ in range(12):
            copy = list(base)
            for x in r.sample(range(120), r.randint(0, 9)):
                copy[x] = f"new{len(texts)}x{x}"
            texts[len(texts)] = " ".join(copy)
    own = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, _ = near_by_force(texts)
    assert len(set(want.values())) > 8
    for block, grams, blind in ((2048, 1 << 21, False), (2048, 1 << 21, True), (3, 1 << 21, True), (2048, 300, True)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "GRAMS", grams)
        if blind:
            monkeypatch.setattr(simhash, "sketch", lambda least: np.zeros(64, np.uint8))
        assert {x["doc_id"]: x["group"] for x in simhash.near_groups(own).collect()} == want


def test_near_across_is_the_plain_one():
    r = random.Random(4)
    for _ in range(40):
        n = r.randint(1, 30)
        sets = [np.array(sorted(r.sample(range(25), r.randint(0, 20)))) for _ in range(n)]
        groups = np.array([r.randrange(8) for _ in range(n)])
        first, second = np.array(sorted(r.sample(range(n), r.randint(0, n))), int), np.array(sorted(r.sample(range(n), r.randint(0, n))), int)
        near = lambda i, j: len({*sets[i].tolist()} & {*sets[j].tolist()}) >= 0.8 * len({*sets[i].tolist()} | {*sets[j].tolist()})
        want = {frozenset((groups[i], groups[j])) for i in first for j in second if groups[i] != groups[j] and near(i, j)}
        got = simhash.near_across(sets, groups, first, second, 0.8, columns=7)
        assert {frozenset((groups[i], groups[j])) for i, j in got} == want and len(got) == len(want) and all(near(i, j) for i, j in got)


@tables
def test_near_copies_recall_and_precision(spark):
    """Over all documents of the larger table, of whatever length, after the lines that repeat are gone, as the pipeline has them, and before."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    for own in (docs, linededup.dedup_lines(docs).select("doc_id", "text")):
        texts = {r["doc_id"]: r["text"] for r in own.collect()}
        got = {r["doc_id"]: r["group"] for r in simhash.near_groups(own).collect()}
        want, pairs = near_by_force(texts)
        assert pairs
        found = sum(got[a] == got[b] for a, b in pairs)
        assert found >= 0.99 * len(pairs)
        # whatever is joined is joined by brute force too
        assert all(want[d] == want[g] for d, g in got.items())
        print(f"{found} of {len(pairs)} near pairs, {len(set(want.values()))} groups, {len(set(got.values()))} found")


def test_near_copies_planted(spark):
    r = random.Random(1)
    words = [f"word{i}" for i in range(3000)]
    texts, family = {}, {}
    for f in range(40):
        base = [r.choice(words) for _ in range(r.randint(120, 400))]
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = r.choice(words)
            family[len(texts)] = f
            texts[len(texts)] = " ".join(copy)
    n = len(texts)
    texts |= {n: "", n + 1: " \n", n + 2: "one two", n + 3: "ONE  two", n + 4: None}
    own = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, grams string")
    got = {x["doc_id"]: x["group"] for x in simhash.near_groups(own).collect()}
    first = {}
    for d, f in family.items():
        first.setdefault(f, d)
    assert sum(got[d] == first[f] for d, f in family.items()) >= 0.97 * len(family)
    assert all(family[got[d]] == f for d, f in family.items())
    assert got[n] == got[n + 1] == got[n + 4] == n and got[n + 2] == got[n + 3] == n + 2
    kept = sorted(x["doc_id"] for x in simhash.one_of_each(own).collect())
    assert kept == sorted({g for g in got.values()})
    assert simhash.near_groups(own.where("false")).count() == 0


def test_near_copies_beside_the_same_words_in_another_order(spark):
    r = random.Random(5)
    texts, copies = {}, []
    for f in range(30):
        base = [f"f{f}word{i}" for i in range(200)]
        other = list(base)
        r.shuffle(other)
        copy = list(base)
        copy[r.randrange(200)] = "edited"
        for listed in (other, base, copy):
            texts[len(texts)] = " ".join(listed)
        copies.append((len(texts) - 2, len(texts) - 1))
    got = {x["doc_id"]: x["group"] for x in simhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] == a for a, b in copies)
    assert all(got[a - 1] == a - 1 for a, _ in copies)


@pytest.mark.parametrize("kind", ["appended", "truncated", "substituted"])
@pytest.mark.parametrize("size", [30, 100, 300, 2000])
def test_near_copies_share_a_key(kind, size):
    r = random.Random(3)
    draw = lambda n: [f"w{i}" for i in r.choices(range(3000), [1 / (i + 1) for i in range(3000)], k=n)]

    def keys(text):
        found = simhash.wide_keys(simhash.wide_print(text).reshape(1, -1))[1]
        return {*found.tolist(), *simhash.bands(simhash.minima(simhash.shingle_hashes(text, 5))).tolist()}

    met, near = 0, 0
    for _ in range(60):
        base = draw(size)
        if kind == "appended":
            copy = base + draw(int(size * 0.22))
        elif kind == "truncated":
            copy = base[: -int(size * 0.17)]
        else:
            copy = list(base)
            # an edit amid 30 words leaves too few shingles
            for x in r.sample(range(size) if size > 30 else range(28, 30), max(1, int(size * 0.02))):
                copy[x] = f"new{x}"
        a, b = " ".join(base), " ".join(copy)
        if len(near_by_force({0: a, 1: b})[1]):
            near += 1
            met += bool(keys(a) & keys(b))
    assert near > 30
    assert met == near


def test_appended_and_truncated_copies_are_found(spark):
    r = random.Random(4)
    texts = {}
    for _ in range(60):
        base = [f"w{i}" for i in r.choices(range(3000), [1 / (i + 1) for i in range(3000)], k=r.choice([100, 300, 1000]))]
        for listed in (base, base[: -int(len(base) * 0.17)]):
            texts[len(texts)] = " ".join(listed)
    got = {x["doc_id"]: x["group"] for x in simhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == near_by_force(texts)[0] == {d: d - d % 2 for d in texts}


def test_pairs_left_open_by_a_failed_edge_are_verified(spark, monkeypatch):
    # equal sketches: the first of each bucket stands between all others, as nothing tells which pairs are near
    monkeypatch.setattr(simhash, "sketch", lambda least: np.zeros(64, np.uint8))
    base = [f"word{i}" for i in range(200)]
    texts = {0: " ".join(reversed(base)), 1: " ".join(base), 2: " ".join([*base[:-1], "edited"]), 3: " ".join(base[::2] + base[1::2])}
    got = {x["doc_id"]: x["group"] for x in simhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)] + [(None, 3), (7, 7)]
    root = {x: x for e in edges for x in e if x is not None}
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(root, a), find(root, b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(root, x) for x in linked}


@tables
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    hidden = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) == 0
    kept = {r["doc_id"] for r in quality.resampled(docs, labels.where(~hidden), keep=("doc_id",)).collect()}
    rates = {}
    for r in labels.where(hidden).groupBy("quality", "toxic").agg(F.collect_list("doc_id").alias("ids")).collect():
        rates[r["quality"], r["toxic"]] = np.mean([d in kept for d in r["ids"]])
    # toxic words in a text of good style are the hardest: 2,600 labels name few of them in the rarer languages
    assert rates[1, 0] > 0.95 and rates[0, 0] < 0.1 and rates[0, 1] < 0.1 and rates[1, 1] < 0.4


def test_gumbel_keys_and_kth(spark):
    values = [random.Random(i).random() for i in range(5000)] + [0.5] * 50
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 2500, 5050):
        assert quality.kth_key(keys, k, most=100) == sorted(values, reverse=True)[k - 1]
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(["", None, "a b", "a b", "long " * 9000])], "doc_id long, text string, key string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resampled(docs, labels).count() == 5
    assert quality.resampled(docs, labels, k=2).count() == 2
    assert quality.resampled(docs.where("false"), labels).count() == 0


def plain_lines(texts):
    """{id: text} without the lines that a smaller id holds."""
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = {d: [x.strip(strip).translate(lower) for x in t.split("\n")] for d, t in texts.items()}
    first = {}
    for d in sorted(keys):
        for k in keys[d]:
            first.setdefault(k, d)
    return {d: "\n".join(x for x, k in zip(t.split("\n"), keys[d]) if len(k) < 10 or first[k] == d) for d, t in texts.items()}


@tables
def test_stages(spark):
    """Each stage on what the one before kept, against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    assert len(before) == docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert [f.name for f in after.schema] == list(corpus_pipeline.COLUMNS), name
        rows = {r["doc_id"]: r for r in after.collect()}
        texts = {d: r["text"] for d, r in before.items()}
        if name == "quality classifier":
            of = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
            clean = [d for d, x in of.items() if x == (1, 0) and d in before]
            assert len(rows) == round(len(before) * len(clean) / len(of)) and all(rows[d] == before[d] for d in rows)
            assert sum(d in rows for d in clean) > 0.9 * len(clean) and sum(d in rows for d, x in of.items() if x[0] == 0) < 0.2 * sum(x[0] == 0 for x in of.values())
        else:
            if name == "line dedup":
                want = plain_lines(texts)
            elif name == "SimHash near-dedup":
                group, _ = near_by_force(texts)
                want = {d: texts[d] for d in set(group.values())}
            else:
                want = {d: plain_redaction(t) for d, t in texts.items()}
                assert any(want[d] != texts[d] for d in want)
            assert {d: r["text"] for d, r in rows.items()} == want, name
            assert all(len(r["text"]) == r["n_chars"] and (r["lang"], r["source"]) == (before[d]["lang"], before[d]["source"]) for d, r in rows.items())
        docs, before = spark.createDataFrame(list(rows.values()), DOCUMENTS), rows
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(vocabulary())
    counts = {d: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in before.items()}
    held = collections.Counter()
    for r in packed:
        held[r["doc_id"]] += r["length"]
    assert held == counts
    assert len({r["sequence_id"] for r in packed}) == -(-sum(counts.values()) // 4096)


@tables
def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert 0 < len({r["doc_id"] for r in rows}) < len(docs) and {r["doc_id"] for r in rows} <= docs
    assert len(rows) == len({(r["sequence_id"], r["offset"]) for r in rows})


def test_run_over_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, an empty and a very long text, columns whose names the stages use, and tables without rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, group long, key double, n_lines int, base string, hash binary, _spans int"
    more = ("x", 1, 0.5, 2, "b", b"h", 3)
    long = " ".join(f"word{i} of{i % 97}" for i in range(60_000))
    rows = [(1, "a line of twelve\nown text one", "en", "s", 9, *more), (2, "a line of twelve\nother words", None, None, None, *[None] * 7), (3, None, "en", "s", 0, *more), (4, "", "en", "s", 0, *more), (None, "no id here", None, None, None, *[None] * 7), (5, "the same row", "en", "s", 1, *more), (5, "the same row", "en", "s", 1, *more), (6, long, "en", "s", 1, *more), (7, long + " token=abcdefgh1", "en", "s", 1, *more)]
    path = str(tmp_path / "odd")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, path).collect() if r["piece"] == 0)
    # 3 and 4 are both empty, 7 is a copy of 6 by its shingles; of 2 its own line is left
    assert got == {1: 1, 2: 1, 3: 1, None: 1, 5: 2, 6: 1}
    path = str(tmp_path / "none")
    spark.createDataFrame([], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def plain_grams(text):
    """The buckets of one text by the definition: words one by one."""
    spaced = regex.sub(r"\p{N}+|[^\p{L}\p{N}\p{Z}\t-\r\x85]+", r" \g<0> ", text)
    words = spaced.split()
    mask = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask
        return h ^ h >> 32

    def hashed(w, tag=0):
        return mixed(sum((b + 1) * pow(quality.BASE, i, 1 << 64) for i, b in enumerate(w.encode())) + tag & mask)

    n = quality.BUCKETS
    low = [w.lower() for w in words]
    out = {hashed(w) % n for w in low} | {hashed(w[:k], k) % n for w in low for k in quality.PREFIXES if len(w) > k}
    pairs = {mixed(hashed(a) * 3 + hashed(b) & mask) % n for a, b in zip(low, low[1:])}
    if not words:
        return {quality.class_bucket("empty")}
    signs = sum(not w[0].isalpha() for w in words)
    parts = {
        "upper": sum(w[0].isalpha() and len(w) > 1 and w.isupper() for w in words) / max(1, len(words) - signs),
        "signs": signs / len(words),
        "most": max(collections.Counter(words).values()) / len(words),
        "same": sum(a == b for a, b in zip(words, words[1:])) / len(words),
        "again": 1 - len(set(words)) / len(words),
        "pairs": 1 - len(pairs) / len(words),
    }
    classes = {quality.class_bucket(f"{name}{k}") for name, x in parts.items() for k in quality.LEVELS if 10 * x >= k}
    return out | pairs | classes | {quality.class_bucket(f"size{len(words).bit_length()}")}


def test_quality_is_the_plain_one(spark):
    r = random.Random(11)
    good, bad = [f"fine{i} Word{i}" for i in range(60)], [f"BAD{i} !!" for i in range(30)] + ["éß", "日本"]
    texts = [" ".join(r.choice(good if i % 4 else good + bad * 3) for _ in range(r.randint(0, 60))) for i in range(300)] + [None, "", " \n", "x" * 30_000, "a\n" * 5000, "Same text", "Same text"]
    docs = [(i, t, "w", 1.0) for i, t in enumerate(texts)] + [(None, "no id", "w", 1.0), (5, texts[5], "w", 1.0)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 200)] + [(8, None, 0), (None, 1, 0), (9, 0, 0), (10, 1, 1), (5000, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, key string, log_weight double").repartition(5)
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    target = {}
    for d, q, t in labels:
        if None not in (d, q, t):
            target[d] = target.get(d, True) and q == 1 and t == 0
    found = [plain_grams(t or "") for _, t, _, _ in docs]
    raw, of_target = collections.Counter(b for g in found for b in g), collections.Counter(b for g, d in zip(found, docs) if target.get(d[0]) for b in g)
    counts = quality.counts_of(df, quality.labelled(lf))
    got = {x["bucket"]: (x["target"], x["raw"]) for x in counts.collect()}
    own = [d for d, *_ in docs if d in target]
    n_target = sum(target[d] for d in own)
    assert got == {b: (of_target[b], n) for b, n in raw.items()} | {-1: (n_target, len(docs)), -2: (n_target, len(own))}
    ratio = {b: math.log(of_target[b] + 2) - math.log(n * n_target / len(docs) + 2) for b, n in raw.items()}
    weight = {b: math.copysign(abs(x) - 1.25, x) for b, x in ratio.items() if abs(x) > 1.25}
    assert len(weight) > 20
    mean = sum((of_target[b] + 1) * w for b, w in weight.items()) / sum(of_target.values())
    model = quality.ratios(counts)
    assert dict(zip(model.buckets.tolist(), model.weights.tolist())) == pytest.approx(weight) and model.mean == pytest.approx(mean, abs=1e-5) and model.share == n_target / len(own)
    keys = []
    for (d, t, _, _), g in zip(docs, found):
        u = (xxhash.xxh64_intdigest(struct.pack("<q", -1 if d is None else d) + (t or "").encode(), 7) + 0.5) / 2.0**64
        keys.append((sum(weight.get(b, 0) for b in g) - mean * len(g), -math.log(-math.log(u)), d))
    k = round(n_target / len(own) * len(docs))
    kth = sorted((w + noise for w, noise, _ in keys), reverse=True)[k - 1]
    kept = quality.resampled(df, lf).collect()
    assert sorted((x["doc_id"] is not None, x["doc_id"] or 0) for x in kept) == sorted((d is not None, d or 0) for w, noise, d in keys if w + noise >= kth - 1e-6)
    by_id = {d: (w, w + noise) for w, noise, d in keys}
    assert all((x["log_weight"], x["key"]) == pytest.approx(by_id[x["doc_id"]], abs=1e-3) for x in kept)
    # the noise decides: some that are kept weigh less than some that are not
    assert min(x["log_weight"] for x in kept) < max(w for w, noise, d in keys if w + noise < kth - 1e-6)


def test_quality_is_fitted_on_whole_texts(spark):
    text = " ".join(f"w{i % 50}" for i in range(10_000)) + " onlyattheend"
    assert len(text) > 20_000
    rows = spark.createDataFrame([(1, text), (2, "short text")], "doc_id long, text string")
    got = {r["bucket"]: r["raw"] for r in quality.counts_of(rows, spark.createDataFrame([(2, True)], "doc_id long, target boolean")).collect()}
    assert set(got) == {*plain_grams(text), *plain_grams("short text"), -1, -2}
