"""Sinks that give back what they took, copies without pairs, contracts on schemas, widths of blocks."""

import pytest
from pyspark.sql import functions as F

from foldlens.operators import contracts, duplicates, joins
from foldlens.plans import catalog
from foldlens.sources import sinks, tables

from test_queries import pytestmark as fixtures

ROUND = ["csv_round_trip", "csv_many_files", "result_files", "json_round_trip", "feature_round_trip", "file_inventory", "stale_reviews", "copies_across_roles", "probe_blocks"]


def test_csv_keeps_quotes_blanks_breaks_and_backslashes(spark, tmp_path):
    texts = ['say "no"', '"', "a,b", " blank at the ends ", "two\nlines", "back\\slash", '\\"', "tab\t", "ends with \\"]
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "i int, t string")
    sinks.write_new_csv(df, str(tmp_path / "out"))
    back = {r["i"]: r["t"] for r in tables.read_csv(spark, str(tmp_path / "out"), "i int, t string").collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert back[len(texts)] is None and back[len(texts) + 1] is None
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_new_csv(df, str(tmp_path / "out"))


def test_csv_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "i int, t string")
    sinks.write_new_csv(df, str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out"), "i int, t string").count() == 0


def test_copies_give_one_edge_each(spark):
    rows = spark.createDataFrame([(i, "same") for i in range(50)] + [(60, "x"), (61, None), (62, None), (63, ""), (64, "")], "id long, t string")
    edges = {(r["a"], r["b"]) for r in duplicates.copy_edges(rows, "id", F.col("t")).collect()}
    assert edges == {(i, 0) for i in range(1, 50)} | {(64, 63)}
    manifest = spark.createDataFrame([(i, 1, "Test" if i == 7 else "Train") for i in range(50)] + [(63, 1, "Val"), (64, 1, "Val")], "id long, fold int, role string")
    assert [tuple(r) for r in duplicates.copies_across_roles(rows, "id", F.col("t"), manifest).collect()] == [(0, 1, "Test|Train", 50)]


def test_components_are_the_same_from_edges_and_from_all_pairs(spark):
    rows = spark.createDataFrame([(i, f"t{i % 4}") for i in range(40)] + [(40, "t0"), (41, None)], "id long, t string")
    nodes = rows.select("id")
    pairs = duplicates.exact_pairs(rows, "id", F.col("t")).toDF("a", "b")
    found = [sorted(map(tuple, duplicates.connected_components(spark, nodes, e).collect())) for e in (pairs, duplicates.copy_edges(rows, "id", F.col("t")))]
    assert found[0] == found[1] and dict(found[0])[41] == 41 and dict(found[0])[40] == 0


def test_schemas_and_examples(spark):
    df = spark.range(100).withColumn("x", -F.col("id"))
    assert contracts.missing_columns({"a": df, "b": df}, {"b": ["id", "y"], "a": ["z"]}) == [("a", "z"), ("b", "y")]
    assert [r["x"] for r in contracts.first_examples(df, "x").collect()] == list(range(-99, -89))
    assert contracts.first_examples(df.filter("false"), "x").count() == 0


def test_repeated_keys_break_a_join(spark):
    left, right = spark.createDataFrame([(1, 1), (1, 2)], "k int, l int"), spark.createDataFrame([(1, 5)], "k int, r int")
    assert joins.attach(left, right, "k").count() == 2
    with pytest.raises(Exception, match="left rows repeat the key"):
        joins.attach(left, right, "k", validate="one_to_one").collect()


@fixtures
@pytest.mark.parametrize("name", ROUND)
def test_matches_sql(spark, name):
    from test_queries import test_matches_sql

    test_matches_sql(spark, name)
    assert name in catalog.ORACLES


def test_values_that_round_to_zero_keep_their_sign_as_pixels(spark, tmp_path):
    import duckdb
    from pyspark.sql import types as T

    base = [((i * 37) % 64 - 31) / 50 for i in range(64)]
    at = lambda x: [*base[:5], x, *base[6:]]
    values = [-0.02, 0.02, -0.0, 0.0, -0.049, 0.25, 0.3, -0.25, -0.3, 1e7, 1e30, float("nan"), float("nan"), float("-inf")]
    schema = T.StructType().add("vec_id", T.LongType()).add("embedding", T.ArrayType(T.FloatType())).add("label", T.IntegerType())
    spark.createDataFrame([(i, at(x), 0) for i, x in enumerate(values, 1)], schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["candidate_pairs"])
    columns = want.columns
    found = [tuple(r[c] for c in columns) for r in catalog.QUERIES["candidate_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(want.fetchall())
    same = {(r[0], r[1]) for r in found if r[3]}
    assert same == {(1, 3), (1, 5), (3, 5), (2, 4), (6, 7), (8, 9), (12, 13)}
