"""Operators that must not gather a group: results by brute force, and what their plans hold."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from foldlens import __main__ as cli
from foldlens import runs
from foldlens.functions import ordering
from foldlens.operators import comparison, duplicates, folds, metrics, probe, profile


def near_hashes(n, seed):
    """Hashes in families that differ in 0 ... 12 bits."""
    rng, rows = random.Random(seed), []
    while len(rows) < n:
        base = rng.getrandbits(64)
        for flips in range(0, 13, 3):
            value = base
            for bit in rng.sample(range(64), flips):
                value ^= 1 << bit
            rows.append((len(rows), value & 0xFFFFFFFF, value >> 32))
    return rows


@pytest.mark.parametrize(("distance", "bands"), [(0, 1), (3, 4), (6, None), (9, 4), (12, 3), (12, 13), (20, 0), (64, None)])
def test_hamming_pairs_by_probes_and_blocks(spark, monkeypatch, distance, bands):
    monkeypatch.setattr(duplicates, "BLOCK", 40)
    rows = near_hashes(150, 3)
    want = {(a[0], b[0], ((a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count())) for i, a in enumerate(rows) for b in rows[i + 1 :]}
    want = {w for w in want if w[2] <= distance}
    found = duplicates.hamming_pairs(spark.createDataFrame(rows, "id long, low long, high long"), distance, bands)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bands_are_chosen_by_cost(spark):
    assert duplicates.plan_bands(500, 20) == 0
    assert duplicates.plan_bands(10**7, 15) > 0
    bands = duplicates.plan_bands(10**6, 6)
    edges = duplicates._edges(bands)
    probes = [duplicates._ball(e - b, 6 // bands) for b, e in zip(edges, edges[1:], strict=False)]
    met = 10**6 / 2 * sum(p / 2 ** (e - b) for p, b, e in zip(probes, edges, edges[1:], strict=False))
    assert met < 2000 and sum(probes) < 2000  # a row's chance meetings and look-ups, of a million
    rng = random.Random(1)
    rows = [(i, rng.getrandbits(32), rng.getrandbits(32)) for i in range(2000)]
    met = duplicates._probed(spark.createDataFrame(rows, "id long, low long, high long"), 15, 4)
    assert met.count() / 2000 < 100  # 16 short bands would bring every row together with about 640


def test_rows_are_numbered_in_parts(spark):
    rows = [(i % 3, i * 7919 % 1000, str(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(4)
    got = [r[:3] for r in ordering.numbered(df, [F.col("a").desc(), F.col("b"), F.col("c")], "n").orderBy("n").collect()]
    assert got == sorted(rows, key=lambda r: (-r[0], r[1], r[2]))


def test_medians_without_gathering(spark, monkeypatch):
    monkeypatch.setattr(profile, "PARTS", 8)
    monkeypatch.setattr(profile, "SORTED", 5)
    rng = random.Random(2)
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(500)], "odd": [rng.expovariate(1) ** 9 for _ in range(501)], "ties": [1.0] * 300 + [2.0] * 300, "one": [3.5],
        "wide": [-1.7e308, 1.7e308, 5.0, 6.0, *[rng.random() * 1e-300 for _ in range(40)]], None: [float(i % 7) for i in range(100)],
    }
    rows = [(g, x) for g, values in groups.items() for x in values] + [("even", None), ("odd", float("nan")), ("gone", None)]
    rng.shuffle(rows)
    got = {r["g"]: r for r in profile.numeric_profile(spark.createDataFrame(rows, "g string, x double"), "g", ["x"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert (got[g]["count"], got[g]["median"], got[g]["min"], got[g]["max"]) == (len(values), statistics.median(values), min(values), max(values)), g


def test_digest_tree_grows_with_the_table(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("k"))
    flat = profile.table_fingerprint(df, df.columns).first()
    assert flat["rows"] == 3000 and profile.tree_depth(3000) == 2 and profile.tree_depth(64) == 1 and profile.tree_depth(64 * 16**4 + 1) == 5
    assert profile.table_fingerprint(df.orderBy(F.desc("id")).repartition(5), df.columns).first() == flat
    repeated = df.unionByName(df.limit(1))
    assert profile.table_fingerprint(repeated, df.columns).first()["digest"] != flat["digest"]
    monkeypatch.setattr(profile, "LEAF", 1)
    longest = df.select(F.sha2(F.concat_ws("\x1f", "id", "k"), 256).alias("h")).groupBy(F.substring("h", 1, profile.tree_depth(3000))).count().agg(F.max("count")).first()[0]
    assert longest < 10 and profile.table_fingerprint(df, df.columns).first()["rows"] == 3000
    assert profile.table_fingerprint(df.limit(0), df.columns).count() == 0


def test_macro_roc_within_stretches(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("m", c, rng.randint(0, 40) / 40, rng.random()) for c in "xyz" for _ in range(60)]
    for c in "xyz":  # curves rise
        mine = sorted([r for r in rows if r[1] == c], key=lambda r: r[2])
        heights = sorted(r[3] for r in mine)
        rows = [r for r in rows if r[1] != c] + [(m, k, f, h) for (m, k, f, _), h in zip(mine, heights, strict=True)]
    points = spark.createDataFrame(rows, "model string, cls string, fpr double, tpr double")
    results = []
    for stretches in (1, 7, 4096):
        monkeypatch.setattr(metrics, "STRETCHES", stretches)
        macro = metrics.macro_roc(points, 3)
        results.append((sorted((r["fpr"], round(r["tpr"], 9)) for r in macro.collect()), round(metrics.trapezoid_area(macro, "model").first()["area"], 9), {r["cls"]: round(r["area"], 9) for r in metrics.trapezoid_area(points, "model", "cls").collect()}))
    assert results[0] == results[1] == results[2]
    plan = metrics.trapezoid_area(points, "model", "cls")._jdf.queryExecution().optimizedPlan().toString()
    assert all("stretch" in line for line in plan.splitlines() if "Window" in line)


def test_results_are_paired_by_fold(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.8), ("a", 2, 0.7), ("b", 2, 0.8), ("c", 1, 0.1)], "model string, fold int, accuracy double")
    got = {r["fold"]: round(r["delta"], 6) for r in comparison.paired_folds(rows, "a", "b", ["accuracy"]).collect()}
    assert got == {1: 0.1, 2: -0.1}
    with pytest.raises(Exception, match="exactly one row of fold"):
        comparison.paired_folds(rows, "a", "c", ["accuracy"]).collect()


def test_a_review_must_match_the_candidates(spark):
    pairs = spark.createDataFrame([("a", "b", "yes"), ("b", "c", "no"), ("b", "c", "no")], "id_a string, id_b string, verified_related string")
    current = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "id_a string, id_b string")
    got = {(r["id_a"], r["problem"]) for r in duplicates.stale_reviews(pairs, current).collect()}
    assert got == {("b", "reviewed twice"), ("c", "not reviewed")}
    assert {r["problem"] for r in duplicates.stale_reviews(pairs.dropDuplicates(), current.limit(1)).collect()} == {"not a candidate"}
    meta = spark.createDataFrame([(x, "l") for x in "abcd"], "sample_id string, label string")
    with pytest.raises(Exception, match="current candidates"):
        runs.grouped_splits(meta, pairs.dropDuplicates(), candidates=current)


def test_runs_leave_their_provenance(spark, tmp_path):
    meta = tmp_path / "meta.csv"
    meta.write_text("sample_id,label\n" + "".join(f"s{i},{'ab'[i % 2]}\n" for i in range(40)))
    cli.main(["splits", "--metadata", str(meta), "--out", str(tmp_path / "run"), "--confirm-hash-order", "--seed", "7"])
    files = list((tmp_path / "run" / "provenance").glob("part-*.json"))
    told = json.loads(files[0].read_text())
    assert len(files) == 1 and told["run"] == "splits" and told["parameters"]["seed"] == "7" and told["version"]
    assert told["inputs"] == [{"name": "metadata", "rows": 40, "digest": profile.table_fingerprint(spark.read.csv(str(meta), header=True), ["sample_id", "label"]).first()["digest"]}]
    assert {r["name"]: r["rows"] for r in told["reports"]}["manifest"] == spark.read.parquet(str(tmp_path / "run" / "manifest")).count()
    cli.main(["splits", "--metadata", str(meta), "--out", str(tmp_path / "again"), "--confirm-hash-order", "--seed", "7"])
    again = json.loads(next((tmp_path / "again" / "provenance").glob("part-*.json")).read_text())
    assert again["reports"] == told["reports"]


def probe_rows(spark, n=120):
    rng = random.Random(6)
    rows = [(i, fold, rng.choice(["Train"] * 3 + ["Test"]), i % 3, [rng.gauss(i % 3, 2), rng.gauss(0, 1), 7.0], rng.choice("abc") + str(i % 3 if rng.random() < 0.5 else 9), rng.choice("xyz")) for i in range(n) for fold in (1, 2, 5)]
    rows += [(1000 + i, 1, "Test", i % 3, [0.0, 0.0, 0.0], "unseen", None) for i in range(3)]
    return spark.createDataFrame(rows, "id long, fold int, role string, label int, x array<double>, site string, device string")


def test_joint_probes_equal_separate_fits(spark):
    rows = probe_rows(spark)
    sparse, dense = probe.sparse_blocks(rows, "x", ["site", "device"]), probe.feature_blocks(rows, "x", ["site", "device"])
    joint = probe.logistic_joint(sparse)
    for block, _, _ in probe.BLOCKS:
        one = {(r["id"], r["fold"]): r for r in probe.logistic_oof(dense, block).collect()}
        got = {(r["id"], r["fold"]): r for r in joint.filter(F.col("block") == block).collect()}
        assert set(one) == set(got)
        assert max(abs(a - b) for k in one for a, b in zip(one[k]["p"], got[k]["p"], strict=True)) < 2e-3
        assert {r["n_features"] for r in got.values()} == {r[0] for r in dense.filter("role = 'Test'").select(F.size(block)).distinct().collect()}
    log = {(r["block"], r["fold"]): r for r in probe.joint_fold_log(joint, sparse).collect()}
    assert len(log) == 9 and all(r["n_train"] + r["n_test"] in (120, 123) and 0 < r["iterations"] < 200 for r in log.values())


def test_joint_probes_reach_the_minimum(spark):
    """The gradient of the penalised loss, in plain loops, is below the bound at what the models predict by."""
    import numpy as np

    rows = probe.sparse_blocks(probe_rows(spark), "x", ["site", "device"]).cache()
    # the first order condition: training residuals times features equal the penalty's pull
    told = []
    real = probe._Descent.tell
    probe._Descent.tell = lambda self, loss, gradient: (real(self, loss, gradient), told.append((id(self), self.done, np.abs(gradient).max(), loss)))[0]
    try:
        probe.logistic_joint(rows)
    finally:
        probe._Descent.tell = real
    assert len({t[0] for t in told}) == 9 and sorted(t[1] for t in told).count(True) == 9
    assert all(t[2] <= 1e-6 for t in told if t[1])
    passes = max(sum(t[0] == m for t in told) for m in {t[0] for t in told})
    assert passes < 120  # passes over the rows for all nine models together
    with pytest.raises(ValueError, match="converged"):
        probe.logistic_joint(rows, max_passes=3)
    with pytest.raises(ValueError, match="lack a class"):
        probe.logistic_joint(rows.filter("not (role = 'Train' and label = 2 and fold = 5)"))


def test_cells_are_drawn_as_rows_are(spark):
    rng = random.Random(8)
    rows = [(str(i), a, a if rng.random() < 0.7 else rng.choice("pqr")) for i in range(200) for a in [rng.choice("pqr")]] + [("x", "p", ""), ("y", None, "q")]
    raters = spark.createDataFrame(rows, "sample_id string, a string, b string")
    slow, fast = (f(raters, "a", "b", 400).first() for f in (comparison.bootstrap_kappa, comparison.bootstrap_kappa_cells))
    assert fast["valid"] == slow["valid"] == 400
    assert abs(fast["kappa95_low"] - slow["kappa95_low"]) < 0.03 and abs(fast["kappa95_high"] - slow["kappa95_high"]) < 0.03
    assert comparison.bootstrap_kappa_cells(raters, "a", "b", 400).first() == fast
    assert comparison.bootstrap_kappa_cells(raters.filter("a = 'p'").withColumn("b", F.lit("p")), "a", "b", 50).first()["kappa95_low"] is None
    assert comparison.bootstrap_kappa_cells(raters.limit(0), "a", "b", 50).first()["valid"] == 0


def test_grouped_folds_of_many_different_clusters(spark, monkeypatch):
    """Beyond the bound of the greedy pass larger clusters are dealt in rounds; labels stay as even."""
    monkeypatch.setattr(folds, "GREEDY", 60)
    rng = random.Random(12)
    rows = []
    for cluster in range(700):
        main = rng.choice("abc")
        for label in [main] * rng.randint(1, 25) + [rng.choice(["a", "b", "c", None]) for _ in range(rng.randint(0, 9))]:
            rows.append((len(rows), label, cluster))
    df = spark.createDataFrame(rows, "id long, label string, cluster long")
    own = folds.grouped_folds(df, "id", "label", "cluster").cache()
    got = [tuple(r) for r in own.select("id", "label", "cluster", "fold").collect()]
    assert sorted(r[:3] for r in got) == rows
    assert all(len({r[3] for r in got if r[2] == c}) == 1 for c in range(0, 700, 7))
    for label in ("a", "b", "c", None):
        counts = [sum(r[1] == label and r[3] == f for r in got) for f in range(1, 8)]
        assert max(counts) - min(counts) <= 0.02 * sum(counts) + 2, (label, counts)
    manifest = folds.grouped_manifest(own)
    assert folds.role_violations(manifest).isEmpty() and manifest.count() == 7 * len(rows)
    sizes = {(r["fold"], r["role"]): r["count"] for r in manifest.groupBy("fold", "role").count().collect()}
    assert len(sizes) == 21 and all(abs(sizes[f, "Val"] - len(rows) / 7) < 0.05 * len(rows) / 7 for f in range(1, 8))


def test_manifest_moves_no_row_for_each_fold(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i // 4) for i in range(400)], "id long, label string, cluster long")
    own = folds.stratified_folds(rows, "id", "label", keep=("cluster",))
    made = folds.manifest(own, keep=("cluster",))
    found = folds.role_violations(made, folds.ROLES)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, folds.role_violations(made).collect()))
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortMergeJoin" not in plan
    assert plan.count("hashpartitioning(cluster") == 1  # the deal before there are seven rows of each serves the count, too
    with pytest.raises(Exception, match="unknown role"):
        folds.role_violations(made.withColumn("role", F.lit("test")), folds.ROLES).collect()


def test_bootstrap_draws_are_spread_and_counted_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(comparison, "PIECE", 7)
    raters = spark.createDataFrame([(i, "xyz"[i % 3], "xyz"[i * i % 3]) for i in range(60)], "sample_id long, a string, b string")
    small = comparison.bootstrap_kappa(raters, "a", "b", 20)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "REPARTITION_BY_NUM" in plan and "hashpartitioning(replicate#" in plan and ", at#" not in plan.split("hashpartitioning(replicate#")[-1].split("\n")[0]
    monkeypatch.undo()
    assert small.collect() == comparison.bootstrap_kappa(raters, "a", "b", 20).collect()
