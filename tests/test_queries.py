"""Every registered query against its SQL, at the smallest scale, and the driver's contract."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return v + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_is_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["dft_vectors", "idft_vectors", "fft_padded", "ifft_padded"])
def test_transforms_of_every_vector(spark, db, name):
    got = {r["vec_id"] for r in entry.queries()[name](spark, SF).select("vec_id").distinct().collect()}
    assert got == {r[0] for r in db.execute("SELECT vec_id FROM embeddings").fetchall()}


def test_whole_texts_are_reversed_and_cut_into_code_points(spark, tmp_path):
    long = "a\u00e9\u0416\U0001f600" * 30_000 + "end"
    listed = {1: long, 2: "", 3: "x"}
    spark.createDataFrame(list(listed.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: (r["back"], r["thrice"]) for r in entry.queries()["text_reverse"](spark, str(tmp_path)).collect()}
    assert got == {d: (sha(t[::-1]), sha(t * 3)) for d, t in listed.items()}
    got = {r["doc_id"]: (r["n"], r["points"]) for r in entry.queries()["text_codepoints"](spark, str(tmp_path)).collect()}
    assert got == {d: (len(t), sha(",".join(str(ord(c)) for c in t))) for d, t in listed.items()}


def test_split_of_empty_and_null_texts(spark, tmp_path):
    listed = [(1, "one. two"), (2, ""), (3, None), (4, "x. ")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(listed, "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = {(1, 2, "two"), (2, 0, None), (3, 0, None), (4, 2, "")}
    assert {tuple(r) for r in entry.queries()["text_split"](spark, str(tmp_path)).select("doc_id", "fields", "last").collect()} == want
    assert set(con.execute(entry.oracle_sql()["text_split"]).fetchall()) == want
