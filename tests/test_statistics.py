import pytest
from pyspark.sql import functions as F

from foldlens.functions import statistics as st
from foldlens.operators import comparison, metrics

CLASSES = ["Herpes", "Melanoma", "Monkeypox", "Sarampion", "Varicela"]
MATRIX = [[11, 0, 6, 11, 17], [0, 0, 2, 5, 10], [3, 0, 60, 32, 33], [2, 0, 33, 102, 68], [0, 0, 9, 51, 110]]


def test_wilson_bounds(spark):
    rows = spark.createDataFrame([(531, 565), (42, 45), (3, 3), (0, 0)], "k long, n long")
    low, high = st.wilson(F.col("k"), F.col("n"))
    got = {(r.k, r.n): (r.low, r.high) for r in rows.withColumns({"low": low, "high": high}).collect()}
    assert got[531, 565] == pytest.approx((0.917085431659475, 0.9566202244478808), abs=1e-14)
    assert got[42, 45] == pytest.approx((0.8214339803640811, 0.977067967400749), abs=1e-14)
    assert got[3, 3][0] < 0.45 and got[3, 3][1] == pytest.approx(1)
    assert got[0, 0] == (None, None)


def test_exact_binomial_bounds():
    low, high = st.clopper_pearson_bounds(3, 10, 0.05)
    assert (low, high) == pytest.approx((0.06673951117773447, 0.6524528500599972), abs=1e-12)
    assert st.clopper_pearson_bounds(0, 5, 0.05)[0] == 0 and st.clopper_pearson_bounds(5, 5, 0.05)[1] == 1
    assert st.clopper_pearson_bounds(0, 0, 0.05) == (None, None)


def test_student():
    assert st.student_quantile(0.975, 6) == pytest.approx(2.4469118511449692, abs=1e-9)
    assert st.student_two_sided(-0.008818342151675476 / 0.006877481166556943, 6) == pytest.approx(0.2470804753931154, abs=1e-13)


def test_overall_of_a_known_matrix(spark):
    rows = [("m", t, p, n) for t, line in zip(CLASSES, MATRIX, strict=True) for p, n in zip(CLASSES, line, strict=True)]
    preds = spark.createDataFrame(rows, "model string, y_true string, y_pred string, n int").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).filter("n > 0")
    got = metrics.overall(preds, CLASSES).first()
    assert got.n == 565
    assert got.accuracy == pytest.approx(0.5008849557522124, abs=1e-14)
    assert got.kappa == pytest.approx(0.2847459148859759, abs=1e-14)
    assert got.mcc == pytest.approx(0.288987659059067, abs=1e-14)
    assert got.macro_f1 == pytest.approx(0.38130723176777775, abs=1e-14)


DELTAS = [0.024691358024691357, -0.024691358024691135, 0.0, 0.012345679012345734, 0.012345679012345845, 0.0, 0.09999999999999998]


def test_sign_flip_and_corrected_test(spark):
    deltas = spark.createDataFrame(list(enumerate(DELTAS, 1)), "fold int, delta double")
    assert comparison.sign_flip(deltas).first().p == pytest.approx(0.375)
    ratios = spark.createDataFrame([(0.20214822771213745,)], "ratio double")
    got = comparison.corrected_paired_test(deltas, ratios).first()
    assert got.two_sided_p is not None and got.ci_low < got.mean_difference < got.ci_high
    flat = spark.createDataFrame([(i, 0.5) for i in range(7)], "fold int, delta double")
    got = comparison.corrected_paired_test(flat, ratios).first()
    assert got.corrected_se == 0 and got.ci_low is None and got.two_sided_p is None
