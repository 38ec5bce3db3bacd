from pyspark.sql import functions as F

from foldlens.operators import subgroups


def rows_of(spark, spec):
    """spec: (group, truths, predictions)"""
    rows = [("m", "all", "axis", g, t, p) for g, ts, ps in spec for t, p in zip(ts, ps, strict=True)]
    return spark.createDataFrame(rows, "model string, scope string, attribute string, group string, y_true string, y_pred string")


def eod(spark, spec, minimum):
    found = subgroups.eod_per_class(subgroups.rate_table(rows_of(spark, spec), ["a", "b"]), (minimum,))
    return {r.cls: r for r in found.collect()}


def test_undefined_rates_are_null(spark):
    spec = [("x", "aa", "aa"), ("y", "aa", "aa")]
    rates = {(r.group, r.cls): r for r in subgroups.rate_table(rows_of(spark, spec), ["a", "b"]).collect()}
    assert rates["x", "b"].tpr is None and rates["x", "a"].fpr is None
    assert all(r.eod is None for r in eod(spark, spec, 1).values())


def test_false_positive_disparity_counts(spark):
    got = eod(spark, [("x", "aabb", "aabb"), ("y", "aabb", "aaaa")], 1)
    assert (got["a"].tpr_gap, got["a"].fpr_gap, got["a"].eod) == (0, 1, 1)


def test_one_retained_group_has_no_gap(spark):
    got = eod(spark, [("x", "abab", "abab"), ("y", "ab", "ba")], 3)
    assert all(r.eod is None for r in got.values())


def test_unattainable_support_leaves_a_row(spark):
    groups = subgroups.subgroup_accuracy(rows_of(spark, [("x", "ab", "aa"), ("y", "a", "a")]))
    got = {r.minimum_n: r for r in subgroups.wga_sensitivity(groups, (1, 2, 99)).collect()}
    assert (got[1].wga, got[2].wga, got[99].wga) == (0.5, 0.5, None)
    assert got[99].coverage == 0 and got[99].ranks_low_to_high == "[]"
    assert got[1].ranks_low_to_high == '["x","y"]'


def test_legacy_gap_modes(spark):
    spec = [("x", "aab", "aab"), ("y", "aa", "aa")]
    skip = subgroups.legacy_fairness(rows_of(spark, spec), ["a", "b"], "skip").first()
    zero = subgroups.legacy_fairness(rows_of(spark, spec), ["a", "b"], "zero").first()
    assert skip.eod == 0 and zero.eod == 0.5 and (zero.group_a, zero.group_b) == ("x", "y")


def test_exact_bounds_of_gaps_enclose_the_point(spark):
    spec = [("x", "aabb" * 10, "aabb" * 10), ("y", "aabb" * 10, "aaba" * 10)]
    rates = subgroups.rate_table(rows_of(spark, spec), ["a", "b"])
    for r in subgroups.eod_bounds(rates, 1).collect():
        assert r.eod95_low <= r.eod <= r.eod95_high
    assert subgroups.wga_bounds(subgroups.subgroup_accuracy(rows_of(spark, spec)), (1,)).filter(F.col("wga95_low") > F.col("wga95_high")).isEmpty()
