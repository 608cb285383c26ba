"""Trigram search against the scan; keyed lookups against the join."""

import random

import pytest
from pyspark.sql import functions as F

from washline.operators.textindex import RAREST, TrigramIndex, literal_grams
from washline.sources import layout

ROW = "id long, name string, code string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(3)
    parts = ["alpha", "Beta", "GAMMA", "delta%x", "eps_ilon", "zÉta", "İstanbul", "100% sure", "a", "", "back\\slash"]
    rows = [(i, None if i % 17 == 0 else "Customer " + rng.choice(parts) + rng.choice(parts) + str(i % 50),
             f"ORD-{i}") for i in range(1500)] + [(9001, "x", None), (9002, "", ""), (9002, "Customer twice", "ORD-1")]
    df = spark.createDataFrame(rows, ROW)
    index = TrigramIndex.write(df, "id", ["name", "code"], str(tmp_path_factory.mktemp("index")), partitions=6)
    return df, index


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("pattern", [
    "%alphabeta%", "%ALPHA%", "%ord-12%", "%customer%", "%al%", "%", "%a_pha%", "%delta\\%x%", "%eps\\_i%", "%zéta%",
    "%İstanbul%", "%nothing here%", "%0% s%", "customer alpha%", "%ord-1", "", "%back\\\\slash%", "%twice%", "%pha%ma%"])
def test_search_equals_the_scan(table, pattern):
    df, index = table
    scan = df.where(F.coalesce(F.col("name").ilike(pattern), F.lit(False)) | F.coalesce(F.col("code").ilike(pattern), F.lit(False)))
    assert _rows(index.search(df, pattern)) == _rows(scan)


def test_random_terms(table):
    df, index = table
    rng = random.Random(1)
    texts = [r.name for r in df.where("name IS NOT NULL AND length(name) > 6").limit(200).collect()]
    for _ in range(12):
        t = rng.choice(texts)
        a = rng.randrange(len(t) - 4)
        term = t[a:a + rng.randrange(2, 7)].replace("\\", "")
        pattern = f"%{term}%"
        scan = df.where(F.coalesce(F.col("name").ilike(pattern), F.lit(False))
                        | F.coalesce(F.col("code").ilike(pattern), F.lit(False)))
        assert _rows(index.search(df, pattern)) == _rows(scan), pattern


def test_postings_are_read_and_not_the_scan(spark, table):
    df, index = table
    assert literal_grams("%AbCd_x%") == {"abc", "bcd"} and literal_grams("%a_b%") == set()
    assert literal_grams("%a\\%b%") == {"a%b"} and literal_grams("é") == set()
    # a rare term reads a handful of postings; one that every row holds is left to the scan
    few = index._rarest("code", literal_grams("%ord-123%"))
    assert len(few) == RAREST and few[0][1] < 30
    assert index.candidates("%ord-%") is None and index.candidates("%al%") is None
    assert index.candidates("%ord-123%").count() < 20
    assert index.candidates("%no such thing%").count() == 0
    # the gram that every row holds lies in several files
    files = spark.read.parquet(f"{index.path}/postings").where("field = 'code' AND gram = 'ord'").select(
        F.input_file_name().alias("f")).distinct().count()
    everywhere = spark.read.parquet(f"{index.path}/postings").select(F.input_file_name().alias("f")).distinct().count()
    assert everywhere > 3 and files >= 1


def test_keyed_lookup(spark, tmp_path):
    df = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") * 3).cast("string").alias("v"))
    layout.write_keyed(df.unionByName(df.where("k % 100 = 0")), f"{tmp_path}/t", "k", 8)

    def find(ids):
        return layout.lookup_keyed(spark, f"{tmp_path}/t", spark.createDataFrame([(i,) for i in ids], "k long"), "k")
    got = find([5, 200, 39_999, 70_000, None, 5])
    assert sorted(r.k for r in got.collect()) == [5, 200, 200, 39_999]
    plan = got.sparkSession._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "Exchange" not in plan and "GreaterThanOrEqual(k,5)" in plan and "LessThanOrEqual(k,39999)" in plan
    many = list(range(0, 9000, 3))
    assert sorted(r.k for r in find(many).collect()) == sorted(many + [k for k in many if k % 100 == 0])
    assert find([]).count() == 0
    # Spark skips files and row groups: of eight sorted parts a lookup of near keys reads rows of one
    near = find([100, 101, 102])
    assert near.select(F.input_file_name()).distinct().count() == 1
