"""Queries whose largest task must not grow with a language, a model or a text: what their plans and files hold."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from foldlens.functions import ordering
from foldlens.operators import duplicates, folds, metrics
from foldlens.plans import data_queries, evaluation_queries, source_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="fixtures are absent")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixel_hash_reads_a_text_once(spark):
    # the optimizer moved the split into the loop over 1,024 characters
    assert "split(" not in plan_of(data_queries.pixel_hash(spark, SF))


def test_inventory_has_no_file_of_a_whole_language(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "FILE_ROWS", 5)
    monkeypatch.setattr(source_queries, "new_folder", lambda spark: str(tmp_path / "texts"))
    total = sum(r.bytes for r in source_queries.file_inventory(spark, SF).collect())
    files = list((tmp_path / "texts").rglob("*.txt"))
    assert len(files) >= 200 / 5 and sum(f.stat().st_size for f in files) == total


def test_nested_counts_read_predictions_once(spark):
    # a join by model dealt all rows to as many tasks as there are models
    assert plan_of(data_queries.serialized(spark, SF)).count("orders.parquet") == 1


def test_far_pairs_in_bands_move_no_looked_up_values(spark):
    rng = random.Random(3)
    rows = [(i, rng.getrandbits(32) & 0xF0F0F0F, rng.getrandbits(32) & 0xF0F) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, low long, high long").repartition(3)
    found = duplicates.hamming_pairs(df, 9, bands=3)
    assert "Generate explode([0" not in plan_of(found) and "MapInArrow" in plan_of(found)
    bits = [(i, low | high << 32) for i, low, high in rows]
    want = {(i, j, (a ^ b).bit_count()) for i, a in bits for j, b in bits if i < j and (a ^ b).bit_count() <= 9}
    got = found.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_fingerprints_sort_a_vector_once(spark):
    vectors = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: F.sin(x * F.col("id"))).alias("v"))
    began = time.time()
    duplicates.fingerprints(vectors, "id", F.col("v")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 8


def test_grouped_folds_bound_the_rows_of_a_task(spark, monkeypatch):
    # adaptive execution made tasks of 64 compressed MB, and these took ten times and more in memory
    monkeypatch.setattr(ordering, "TASK_ROWS", 100)
    rows = spark.range(1000).select("id", F.concat(F.lit("l"), F.col("id") % 3).alias("label"), F.expr("id div 4").alias("cluster"))
    own = folds.grouped_folds(rows, "id", "label", "cluster")
    found = folds.role_violations(folds.grouped_manifest(own), folds.ROLES)
    plan = plan_of(found)
    assert "REPARTITION_BY_NUM" in plan and "fold#" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
    assert all(", 10), REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange hashpartitioning(cluster" in line and "ENSURE" not in line)
    assert found.isEmpty()
    split = own.withColumn("fold", F.when(F.col("id") == 20, F.col("fold") % 7 + 1).otherwise(F.col("fold")))
    made = folds.grouped_manifest(split)
    assert made.groupBy("id").agg(F.count_distinct("fold").alias("n"), F.count(F.lit(1)).alias("rows")).filter("n <> 7 or rows <> 7").isEmpty()
    assert {r.cluster for r in folds.role_violations(made, folds.ROLES).collect()} == {5}


@pytest.mark.parametrize("buckets", [3, 4096])
def test_areas_are_those_of_the_curves(spark, monkeypatch, buckets):
    monkeypatch.setattr(metrics, "BUCKETS", buckets)
    monkeypatch.setattr(metrics, "STRETCHES", buckets)
    rng = random.Random(buckets)
    rows = []
    for model, steps, truths in (("ties", 7, "xyz"), ("fine", 10**6, "xyz"), ("absent", 50, "xy"), ("one", 20, "x")):
        for _ in range(150):
            p = [rng.randint(0, steps) / steps for _ in "xyz"]
            rows.append((model, rng.choice(truths), p))
    rows += [("apart", t, [float(t == c) for c in "xyz"]) for t in "xyzzy"]
    preds = spark.createDataFrame(rows, "model string, y_true string, p array<double>")
    told = lambda df: {tuple(r)[:-1]: r.area and round(r.area, 9) for r in df.collect()}
    points = metrics.roc_points(preds, list("xyz"))
    assert told(metrics.roc_areas(preds, list("xyz"))) == told(metrics.trapezoid_area(points, "model", "cls"))
    assert told(metrics.macro_roc_areas(preds, list("xyz"))) == told(metrics.trapezoid_area(metrics.macro_roc(points, 3), "model"))


def test_class_areas_move_scores_twice_at_most(spark):
    # curves were joined with their own stretches and dealt again
    plan = plan_of(evaluation_queries.class_areas(spark, SF))
    assert plan.count("score#") and "SortMergeJoin [__key" not in plan and plan.count("orders.parquet") == 1 and "ExistingRDD" not in plan


def test_macro_area_has_no_grid_of_rates_and_classes(spark):
    plan = plan_of(evaluation_queries.macro_roc_area(spark, SF))
    assert "SortMergeJoin [model" not in plan and "ExistingRDD" not in plan and "fpr#" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
