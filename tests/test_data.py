import pytest
from pyspark.sql import functions as F

from foldlens.functions import arrays, cleaning
from foldlens.operators import contracts, duplicates, folds, profile
from foldlens.sources import sinks, tables


def test_age_bins(spark):
    ages = [("17", "0-17"), ("18", "18-59"), ("59", "18-59"), ("60", "60+"), ("64", "60+"), ("65", "60+"), (None, "missing"), ("17.5", "18-59"), ("121", "missing"), ("x", "missing"), ("NaN", "missing")]
    rows = spark.createDataFrame(ages, "age string, want string").withColumn("got", cleaning.age_proxy(F.col("age")))
    assert rows.filter("got <> want or got is null").isEmpty()


def test_legacy_age_display(spark):
    rows = spark.createDataFrame([("64", "18-59"), ("65", "60+"), (None, "unknown")], "age string, want string")
    rows = rows.withColumn("got", cleaning.age_display_legacy(cleaning.age_group_model(F.col("age"))))
    assert rows.filter("got <> want").isEmpty()


def test_hostile_counts_are_never_evaluated(spark):
    cells = [("ok", "{'a': {'x': (np.int64(2), np.int64(3))}}"), ("evil", "__import__('os').system('true')"), ("bad", "{'a': {'x': (3, 2)}}"), ("null", None)]
    got = {r.id: r for r in profile.parse_counts(spark.createDataFrame(cells, "id string, c string"), "c").collect()}
    assert (got["ok"].attribute, got["ok"].group, got["ok"].correct, got["ok"].n, got["ok"].valid) == ("a", "x", 2, 3, True)
    assert not got["evil"].valid and got["evil"].attribute is None and not got["bad"].valid and not got["null"].valid


def test_prediction_contract(spark):
    rows = [("1", "m", 1, "a", "b", [0.9, 0.1]), ("1", "m", 1, "a", "a", [0.9, 0.1]), ("2", "m", 1, "a", "a", [0.9, 0.3]), ("3", "m", 1, "z", "a", [float("nan"), 0.1])]
    got = contracts.prediction_violations(spark.createDataFrame(rows, "sample_id string, model string, fold int, y_true string, y_pred string, p array<double>"), ["a", "b"]).first()
    assert (got.argmax_mismatches, got.repeated_predictions, got.unknown_labels, got.invalid_probabilities) == (1, 1, 1, 1)
    assert got.not_summing_to_one >= 1
    with pytest.raises(contracts.ContractError):
        contracts.require_none(contracts.duplicate_keys(spark.createDataFrame([(1,), (1,)], "k int"), "k"), "repeated")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(spark.range(1), "fold")


def test_argmax_takes_the_first_of_equal(spark):
    assert spark.range(1).select(arrays.argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)))).first()[0] == 0


def test_leakage_pair(spark):
    pairs = spark.createDataFrame([("a", "b")], "id_a string, id_b string")
    manifest = spark.createDataFrame([("a", 1, "Train"), ("b", 1, "Test"), ("a", 2, "Train"), ("b", 2, "Train")], "id string, fold int, role string")
    assert [(r.fold, r.role_a, r.role_b) for r in duplicates.cross_role_pairs(pairs, manifest).collect()] == [(1, "Train", "Test")]


def test_components_are_transitive(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    edges = spark.createDataFrame([("b", "c"), ("a", "b"), ("e", "d")], "a string, b string")
    got = {r.id: r.cluster for r in duplicates.connected_components(spark, nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


@pytest.mark.parametrize("distance", [0, 3, 6, 15])
def test_banded_hamming_loses_no_pair(spark, distance):
    import random

    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 3, 6, 9, 15, 16)]
    rows = [(i, x & 0xFFFFFFFF, x >> 32) for i, x in enumerate(values)]
    got = {(r.id_a, r.id_b, r.distance) for r in duplicates.hamming_pairs(spark.createDataFrame(rows, "id long, low long, high long"), distance).collect()}
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= distance}
    assert got == want


def test_fold_sizes(spark):
    rows = spark.range(565).select("id", F.when(F.col("id") < 205, "s").when(F.col("id") < 375, "v").when(F.col("id") < 503, "k").when(F.col("id") < 548, "h").otherwise("m").alias("label"))
    counts = folds.fold_counts(folds.manifest(folds.stratified_folds(rows, "id", "label"))).groupBy("fold").pivot("role").sum("n").collect()
    assert sorted((r.Train, r.Val, r.Test) for r in counts) == [(399, 85, 81)] * 5 + [(400, 85, 80)] * 2


def test_grouped_folds_keep_clusters(spark):
    rows = spark.range(600).select("id", (F.col("id") % 3).cast("string").alias("label"), F.when(F.col("id") < 100, F.col("id") % 9).otherwise(F.col("id")).alias("cluster"))
    got = folds.grouped_folds(rows, "id", "label", "cluster")
    assert got.count() == 600
    assert got.groupBy("cluster").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "Train" / "x").mkdir(parents=True)
    (tmp_path / "in" / "Train" / "x" / "A.PNG").write_bytes(b"abc")
    (tmp_path / "in" / "Train" / "x" / "b.txt").write_bytes(b"abc")
    got = tables.read_inventory(spark, str(tmp_path / "in")).collect()
    assert [(r.sample_id, r.bytes, r.archive_split, r.archive_label, r.basename) for r in got] == [("Train/x/A.PNG", 3, "Train", "x", "a.png")]
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "a int, b double")
    sinks.write_new_json(df, str(tmp_path / "out"))
    assert {(r.a, r.b) for r in spark.read.json(str(tmp_path / "out")).collect()} == {(1, None), (2, 1.5)}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_new_json(df, str(tmp_path / "out"))
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "fold.csv").write_text("fold,accuracy\n1,0.5\n")
    rows = tables.read_fold_metrics(spark, str(tmp_path / "*" / "fold.csv"), "fold int, accuracy double").collect()
    assert [(r.fold, r.accuracy, r.model) for r in rows] == [(1, 0.5, "m1")]


def test_windowed_accuracy_stream(spark, tmp_path):
    from foldlens.streaming.monitor import windowed_accuracy

    rows = spark.createDataFrame([("2024-01-01 00:01:00", "g", "a", "a"), ("2024-01-01 00:02:00", "g", "a", "b")], "t string, group string, y_true string, y_pred string")
    rows.select(F.to_timestamp("t").alias("ts"), "group", "y_true", "y_pred").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, group string, y_true string, y_pred string").parquet(str(tmp_path / "in"))
    query = windowed_accuracy(stream).writeStream.outputMode("update").format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.group, r.n, r.correct) for r in spark.table("seen").collect()] == [("g", 2, 1)]


def test_reports_of_notebooks(spark, tmp_path):
    import json

    from foldlens.sources import tables

    report = "              precision    recall  f1-score   support\n\n     Acne top       0.90      0.80      0.85        10\n           b       1.00      0.00      0.00         2\n\n    accuracy                           0.71        12\n   macro avg       0.95      0.40      0.42        12\nweighted avg       0.92      0.67      0.71        12\n"
    scalars = "--- Overall Scalar Metrics ---\nAccuracy : 0.9\nMacro ROC AUC : 0.8\nCohen's Kappa : 0.7\nMatthews CorrCoef : 0.6\n"
    outputs = [{"text": [scalars, report]}, {"data": {"text/plain": [report]}}, {"text": [scalars.replace("--- Overall Scalar Metrics ---\n", "")]}]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"outputs": []}, {"outputs": outputs}]}))
    told = tables.notebook_outputs(spark, str(tmp_path / "*.ipynb"))
    assert [(r["cell"], r["accuracy"], r["mcc"]) for r in tables.scalar_metrics(told).collect()] == [(1, 0.9, 0.6)]
    reports = tables.notebook_reports(told)
    assert sorted((r["cell"], r["report"]) for r in reports.collect()) == [(1, 0), (1, 1)]
    rows = {r["cls"]: r for r in tables.report_rows(reports.filter("report = 0")).collect()}
    assert set(rows) == {"Acne top", "b", "accuracy", "macro avg", "weighted avg"}
    assert (rows["Acne top"]["precision"], rows["Acne top"]["f1"], rows["Acne top"]["support"]) == (0.9, 0.85, 10)
    assert (rows["accuracy"]["precision"], rows["accuracy"]["f1"], rows["accuracy"]["support"]) == (None, 0.71, 12)
