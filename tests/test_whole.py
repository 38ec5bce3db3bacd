"""Queries and operators do the whole job: all rows, all folds, all roles."""

import os

import pytest
from pyspark.sql import functions as F

from test_queries import test_matches_sql as matches_sql

from foldlens.operators import comparison, folds, probe, profile
from foldlens.plans import catalog

SF = "/root/testdata/sf0.001"
fixtures = pytest.mark.skipif(not os.path.isdir(SF), reason="fixtures are absent")


@fixtures
def test_grouped_folds_have_every_line(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = catalog.QUERIES["grouped_folds"](spark, SF).cache()
    assert got.count() == lines.count()
    assert got.select("cluster", "fold").distinct().count() == lines.select("l_orderkey").distinct().count()
    for r in got.groupBy("label").pivot("fold", range(1, 8)).count().collect():
        sizes = [r[str(f)] for f in range(1, 8)]
        assert max(sizes) - min(sizes) <= 0.02 * sum(sizes), r


@fixtures
@pytest.mark.parametrize("name", ["cluster_role_violations", "standardize_train_only", "train_vocab_codes", "train_vocab_onehot", "bootstrap_kappa"])
def test_whole_tables_match_sql(spark, name):
    matches_sql(spark, name)


def test_grouped_folds_deal_equal_clusters_evenly(spark):
    # 30 clusters of one vector, 10 of another, one large cluster and one whose label is null
    ids = spark.range(30 * 3 + 10 * 2 + 40 + 1)
    cluster = F.when(F.col("id") < 90, F.col("id") % 30).when(F.col("id") < 110, 100 + F.col("id") % 10).when(F.col("id") < 150, 200).otherwise(300)
    label = F.when(F.col("id") < 60, "x").when(F.col("id") < 150, "y")
    got = folds.grouped_folds(ids.select("id", label.alias("label"), cluster.alias("cluster")), "id", "label", "cluster").cache()
    assert got.count() == 151 and got.select("cluster", "fold").distinct().count() == 42
    same = [r.n for r in got.filter("cluster < 30").groupBy("fold").agg(F.count_distinct("cluster").alias("n")).collect()]
    assert sorted(same) in ([4] * 5 + [5] * 2, [4] * 6 + [6])
    assert got.filter("label is null").count() == 1


def test_grouped_folds_balance_single_clusters(spark):
    rows = spark.range(40).select("id", F.floor(F.col("id") / 2).cast("string").alias("label"), F.col("id").alias("cluster"))
    got = folds.grouped_folds(rows, "id", "label", "cluster").cache()
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    assert got.groupBy("label", "fold").count().filter("count > 1").isEmpty()


def test_grouped_manifest_has_all_roles(spark):
    rows = spark.range(420).select("id", (F.col("id") % 2).cast("string").alias("label"), (F.col("id") % 140).alias("cluster"))
    own = folds.grouped_folds(rows, "id", "label", "cluster")
    got = folds.grouped_manifest(own).cache()
    assert got.groupBy("id").agg(F.count_distinct("fold").alias("n"), F.count_if(F.col("role") == "Test").alias("tests")).filter("n = 7 and tests = 1").count() == 420
    sizes = {(r.fold, r.role): r["count"] for r in got.groupBy("fold", "role").count().collect()}
    assert len(sizes) == 21 and all(sizes[f, "Train"] > 2 * sizes[f, "Val"] for f in range(1, 8))
    assert all(50 <= sizes[f, "Val"] <= 70 for f in range(1, 8))  # a sixth of what isn't test
    assert folds.role_violations(got).isEmpty()
    # each fold has a validation of its own
    chosen = {f: frozenset(r.cluster for r in got.filter(f"fold = {f} and role = 'Val'").select("cluster").distinct().collect()) for f in range(1, 8)}
    assert len(set(chosen.values())) == 7
    # few clusters: no more parts than clusters
    few = folds.grouped_manifest(folds.grouped_folds(rows.filter("cluster < 4"), "id", "label", "cluster", 3), 3)
    assert few.filter("role = 'Val'").select("fold").distinct().count() == 3


@fixtures
def test_grouped_fold_violations_sees_a_split_cluster(spark, monkeypatch):
    real = folds.grouped_folds

    def broken(rows, *args):
        got = real(rows, *args)
        return got.withColumn("fold", F.when(F.col("cluster") != 7, F.col("fold")).when(F.col("id").endswith("-1"), 1).otherwise(2))

    lines = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_orderkey = 7").agg(F.count_if(F.col("l_linenumber") == 1).alias("a"), F.count_if(F.col("l_linenumber") != 1).alias("b")).first()
    assert lines.a and lines.b
    assert catalog.QUERIES["grouped_fold_violations"](spark, SF).isEmpty()
    monkeypatch.setattr(folds, "grouped_folds", broken)
    assert {r.cluster for r in catalog.QUERIES["grouped_fold_violations"](spark, SF).collect()} == {7}


@pytest.mark.parametrize(
    ("losses", "want"),
    [
        ([2.0, 1.0] + [1.5] * 37 + [0.5], (2, 1.0, 7)), ([3.0, 2.0, 1.0], (3, 1.0, 3)), ([1.0, 1.0, 1.0], (1, 1.0, 3)),
        ([None, 2.0, float("nan"), 1.0], (4, 1.0, 4)), ([None] * 9, (None, None, 5)), ([1.0, 2.0, 2.0, 2.0, 2.0, 0.5] + [0.6] * 9, (6, 0.5, 11)),
    ],
)
def test_early_stopping(spark, losses, want):
    rows = spark.createDataFrame([("r", 10 * i, x) for i, x in enumerate(losses, 1)], "run string, epoch long, loss double")
    got = profile.early_stopping(rows, 5).first()
    times = lambda e: e and e // 10
    assert (times(got.best_epoch), got.best_loss, times(got.stop_epoch)) == want


def test_agreement_over_many_categories(spark):
    rows = spark.range(6000).select(F.col("id").alias("sample_id"), (F.col("id") % 1500).cast("string").alias("a"), F.when(F.col("id") < 3000, F.col("id") % 1500).otherwise((F.col("id") + 1) % 1500).cast("string").alias("b"))
    got = comparison.agreement(rows, "a", "b").first()
    assert got.n == 6000 and got.agreement == 0.5 and got.kappa == pytest.approx((0.5 - 1 / 1500) / (1 - 1 / 1500))


@fixtures
@pytest.mark.parametrize(("name", "rows"), [("standardize_train_only", 500 * 64), ("train_vocab_codes", 200), ("train_vocab_onehot", 200)])
def test_all_folds_are_returned(spark, name, rows):
    sizes = {r.fold: r["count"] for r in catalog.QUERIES[name](spark, SF).groupBy("fold").count().collect()}
    assert sizes == dict.fromkeys(range(1, 8), rows)


@fixtures
def test_logistic_probe_has_all_blocks(spark, monkeypatch):
    # the fits take minutes; here only what they get
    width = lambda x, m: F.size("image") * int(x) + F.col("width") * int(m)
    monkeypatch.setattr(probe, "logistic_joint", lambda rows: rows.select("id", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), width(x, m).alias("width")) for b, x, m in probe.BLOCKS])).alias("b")).select("id", "b.*"))
    got = catalog.QUERIES["logistic_probe_oof"](spark, SF).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("width").alias("width")).collect()
    width = {r.block: r.width for r in got}
    assert {r.n for r in got} == {3500} and width["image_only"] == 64 and width["concat"] == 64 + width["metadata_only"] > 64


def test_probe_must_converge(spark):
    rows = spark.range(60).select("id", (F.col("id") % 2 + 1).cast("int").alias("fold"), F.lit("Test").alias("role"), (F.col("id") % 3).cast("int").alias("label"), F.array(F.sin("id"), F.cos(F.col("id") * F.col("id"))).alias("x"))
    rows = rows.unionByName(rows.withColumns({"fold": 3 - F.col("fold"), "role": F.lit("Train")}))
    assert probe.logistic_oof(rows, "x").count() == 60
    with pytest.raises(ValueError, match="converged"):
        probe.logistic_oof(rows, "x", max_iter=1)


@fixtures
def test_bootstrap_has_the_references_replicates(spark):
    assert catalog.QUERIES["bootstrap_kappa"](spark, SF).first().valid > 1800


def test_probe_blocks_and_controls(spark):
    rows = spark.range(40).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("fold"), (F.col("id") % 3).cast("int").alias("label"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("site"), F.array(F.col("id").cast("float"), F.lit(5.0)).alias("x"))
    rows = rows.withColumn("role", F.when(F.col("id") % 2 + 1 == F.col("fold"), "Test").otherwise("Train"))
    got = probe.feature_blocks(rows, "x", ["site"]).cache()
    train = got.filter("role = 'Train'").groupBy("fold").agg(F.avg(F.col("image_only")[0]).alias("m"), F.stddev_pop(F.col("image_only")[0]).alias("s"), F.max(F.col("image_only")[1]).alias("c")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 and r.c == 0 for r in train)
    # one-hot columns aren't scaled
    assert {tuple(r.metadata_only) for r in got.filter("fold = 2").select("metadata_only").distinct().collect()} <= {(0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0), (0.0, 1.0)}
    moved = probe.randomized_training(rows, ["site"], "joint", "s")
    same = ["id", "fold", "site"]
    assert moved.count() == rows.count() and rows.filter("role = 'Test'").select(*same).exceptAll(moved.filter("role = 'Test'").select(*same)).isEmpty()
    tally = lambda df: sorted(map(tuple, df.filter("role = 'Train'").groupBy("fold", "site").count().collect()))
    assert tally(rows) == tally(moved)
    log = probe.fold_log(probe.logistic_oof(got, "concat"), got, "concat").collect()
    assert all((r.n_train, r.n_test) == (20, 20) and r.n_features in (4, 5) and r.iterations > 0 for r in log)
