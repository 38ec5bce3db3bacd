"""Queries about predictions: metrics, calibration, subgroups, comparison, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax, softmax
from ..functions.statistics import Z95
from ..operators import comparison, contracts, metrics, subgroups
from . import views as v

Z = f"{Z95!r}::DOUBLE"
THRESHOLDS = "(SELECT unnest([1, 5, 10, 15, 20, 30, 50]) AS minimum_n)"


def R(expression: str, name: str) -> str:
    return f"round({expression}, 9) + 0.0::DOUBLE AS {name}"


def D(a: str, b: str) -> str:
    """a / b as doubles, NULL for b = 0."""
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, n2 = D(k, n), f"nullif(({n})::DOUBLE, 0)"
    centre = f"({p} + {Z} * {Z} / (2 * {n2})) / (1 + {Z} * {Z} / {n2})"
    half = f"{Z} * sqrt({p} * (1 - {p}) / {n2} + {Z} * {Z} / (4 * {n2} * {n2})) / (1 + {Z} * {Z} / {n2})"
    # an expression with NULL stays NULL, other than with greatest() and least()
    return f"CASE WHEN ({n}) > 0 THEN greatest(0::DOUBLE, {centre} - {half}) END", f"CASE WHEN ({n}) > 0 THEN least(1::DOUBLE, {centre} + {half}) END"


def orders(spark, d) -> DataFrame:
    return v.pred_orders(spark, d)


def order_rows(spark, d) -> DataFrame:
    return subgroups.by_axes(v.pred_orders(spark, d), v.AXES)


def doc_rows(spark, d) -> DataFrame:
    return subgroups.by_axes(v.pred_docs(spark, d), ["lang", "source", "toxic"], "lang")


W = "WITH "
ORDERS, ORDER_ROWS = W + v.PRED_ORDERS, W + v.PRED_ORDERS + ", " + v.ORDER_AXES
DOCS, DOC_ROWS = W + v.PRED_DOCS, W + v.PRED_DOCS + ", " + v.DOC_AXES
GROUPS = """, grouped AS (SELECT model, scope, attribute, "group", count(*) AS n, count(*) FILTER (y_true = y_pred) AS correct FROM axis_rows GROUP BY ALL)"""


def ovr_sql(source: str, keys: str, classes: str) -> str:
    return f"""ovr AS (
  SELECT {keys}, cls, count(*) AS n, count(*) FILTER (y_true = cls AND y_pred = cls) AS tp, count(*) FILTER (y_true = cls AND y_pred <> cls) AS fn,
         count(*) FILTER (y_true <> cls AND y_pred = cls) AS fp, count(*) FILTER (y_true <> cls AND y_pred <> cls) AS tn
  FROM {source} CROSS JOIN (SELECT unnest({classes}) AS cls) GROUP BY ALL)"""


STATUS = "['F', 'O', 'P']"
OVR = ", " + ovr_sql("pred_orders", "model", STATUS)
RATES = ", " + ovr_sql("axis_rows", 'model, scope, attribute, "group"', STATUS) + ", rates AS (SELECT *, tp + fn AS positive_n, fp + tn AS negative_n, " + D("tp", "tp + fn") + " AS tpr, " + D("fp", "fp + tn") + " AS fpr FROM ovr)"
DOC_RATES = RATES.replace(STATUS, "['0', '1']")


def _bounds(*pairs: tuple[str, str, str]) -> str:
    out = []
    for k, n, name in pairs:
        low, high = wilson_sql(k, n)
        out += [R(low, f"{name}95_low"), R(high, f"{name}95_high")]
    return ", ".join(out)


def _spec() -> str:
    low, high = wilson_sql("fp", "fp + tn")
    return f"{R(f'1 - ({high})', 'specificity95_low')}, {R(f'1 - ({low})', 'specificity95_high')}"


OVERALL_TAIL = f"""
, sums AS (SELECT model, any_value(n) AS n, sum(tp) AS c, sum((tp + fn)::DOUBLE * (tp + fp)) AS x, sum((tp + fn)::DOUBLE * (tp + fn)) AS tt, sum((tp + fp)::DOUBLE * (tp + fp)) AS pp, avg(coalesce({D("2 * tp", "2 * tp + fp + fn")}, 0)) AS macro_f1 FROM ovr GROUP BY model)
SELECT model, n::BIGINT AS n, {R("c / n::DOUBLE", "accuracy")}, {_bounds(("c", "n", "accuracy"))}, {R("macro_f1", "macro_f1")},
       {R("(c / n::DOUBLE - x / (n::DOUBLE * n)) / nullif(1 - x / (n::DOUBLE * n), 0)", "kappa")},
       {R("coalesce((c::DOUBLE * n - x) / nullif(sqrt((n::DOUBLE * n - pp) * (n::DOUBLE * n - tt)), 0), 0)", "mcc")} FROM sums"""

REPORT_SQL = f"""
, rows_ AS (SELECT model, cls, coalesce({D("tp", "tp + fp")}, 0) AS precision, coalesce({D("tp", "tp + fn")}, 0) AS recall, coalesce({D("2 * tp", "2 * tp + fp + fn")}, 0) AS f1, tp + fn AS support, tp FROM ovr)
, out_ AS (SELECT model, cls, precision, recall, f1, support FROM rows_
  UNION ALL SELECT model, 'accuracy', sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(support) FROM rows_ GROUP BY model
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rows_ GROUP BY model
  UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rows_ GROUP BY model)
SELECT model, cls, {R("precision", "precision")}, {R("recall", "recall")}, {R("f1", "f1")}, support::BIGINT AS support FROM out_"""

RELIABILITY = """, binned AS (
  SELECT model, least(floor(list_max(p) * 10)::INT, 9) AS bin, list_max(p) AS conf, (['F', 'O', 'P'][list_position(p, list_max(p))] = y_true)::INT AS hit FROM pred_orders
), bins AS (SELECT model, bin, count(*) AS n, avg(hit) AS accuracy, avg(conf) AS mean_confidence FROM binned GROUP BY ALL)"""

SCORED = """, scored AS (
  SELECT model, cls, score, sum(pos)::BIGINT AS pos, sum(1 - pos)::BIGINT AS neg FROM (
    SELECT model, unnest(['F', 'O', 'P']) AS cls, unnest(p) AS score, (y_true = unnest(['F', 'O', 'P']))::INT AS pos FROM pred_orders) GROUP BY ALL
)"""

_OWN = "p[list_position(['F', 'O', 'P'], y_true)]"
_LOSS = f"-avg(ln(least(greatest({_OWN}, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE)))"
_BRIER = "avg((p[1] - (y_true = 'F')::INT) ** 2 + (p[2] - (y_true = 'O')::INT) ** 2 + (p[3] - (y_true = 'P')::INT) ** 2)"
LOSS_SQL = f" SELECT model, count(*) AS n, {R(_LOSS, 'log_loss')}, {R(_BRIER, 'brier_sum')} FROM pred_orders GROUP BY model"

AUC_SQL = f"""{SCORED}, under AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM scored)
, per AS (SELECT model, cls, sum(pos) AS positives, sum(neg) AS negatives, sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auc FROM under GROUP BY ALL)
SELECT model, cls, positives::BIGINT AS positives, negatives::BIGINT AS negatives, {R("auc", "auc")}, count(auc) OVER m AS classes_estimable,
       round(CASE WHEN count(auc) OVER m = count(*) OVER m THEN avg(auc) OVER m END, 9) + 0.0::DOUBLE AS macro_auc
FROM per WINDOW m AS (PARTITION BY model)"""

ROC_SQL = f"""{SCORED}
SELECT model, cls, {R("score", "threshold")}, {R("sum(neg) OVER w / nullif(sum(neg) OVER e, 0)::DOUBLE", "fpr")}, {R("sum(pos) OVER w / nullif(sum(pos) OVER e, 0)::DOUBLE", "tpr")}
FROM scored WINDOW w AS (PARTITION BY model, cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY model, cls)"""

EOD = f""", per AS (
  SELECT model, scope, attribute, cls, minimum_n, count(tpr) FILTER (n >= minimum_n) AS tpr_groups, max(tpr) FILTER (n >= minimum_n) - min(tpr) FILTER (n >= minimum_n) AS tpr_range,
         count(fpr) FILTER (n >= minimum_n) AS fpr_groups, max(fpr) FILTER (n >= minimum_n) - min(fpr) FILTER (n >= minimum_n) AS fpr_range
  FROM rates CROSS JOIN {THRESHOLDS} GROUP BY ALL
), eods AS (
  SELECT model, scope, attribute, cls, minimum_n, tpr_groups, fpr_groups, CASE WHEN tpr_groups >= 2 THEN tpr_range END AS tpr_gap, CASE WHEN fpr_groups >= 2 THEN fpr_range END AS fpr_gap,
         CASE WHEN tpr_groups >= 2 AND fpr_groups >= 2 THEN greatest(tpr_range, fpr_range) END AS eod FROM per)"""


def legacy_sql(absent: str) -> str:
    tpr = "tpr" if absent == "skip" else "coalesce(tpr, 0)"
    return f"""{DOC_ROWS}{DOC_RATES}, side AS (SELECT model, scope, attribute, cls, "group", {tpr} AS tpr FROM rates WHERE {tpr} IS NOT NULL)
, gaps AS (SELECT a.model, a.scope, a.attribute, a."group" AS group_a, b."group" AS group_b, avg(abs(a.tpr - b.tpr)) AS gap
  FROM side a JOIN side b ON a.model = b.model AND a.scope = b.scope AND a.attribute = b.attribute AND a.cls = b.cls AND a."group" < b."group" GROUP BY ALL HAVING gap > 0)
, worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, scope, attribute ORDER BY round(gap, 12) DESC, group_a, group_b) AS place FROM gaps) WHERE place = 1)
{GROUPS}, least_ AS (SELECT model, scope, attribute, min(correct / n::DOUBLE) AS wga FROM grouped GROUP BY ALL)
SELECT model, scope, attribute, {R("wga", "wga")}, {R("coalesce(gap, 0)", "eod")}, group_a, group_b FROM least_ LEFT JOIN worst USING (model, scope, attribute)"""


PAIRED = """, paired AS (
  SELECT sample_id, fold, max(CASE WHEN model = 'a' THEN (y_true = y_pred)::INT END) AS correct_a, max(CASE WHEN model = 'b' THEN (y_true = y_pred)::INT END) AS correct_b FROM pred_orders GROUP BY ALL
), deltas AS (SELECT fold, avg(correct_a) AS accuracy_a, avg(correct_b) AS accuracy_b, avg(correct_a) - avg(correct_b) AS delta FROM paired GROUP BY fold)"""

BOOT_SQL = f"""{W}{v.RATERS}
, cells AS (SELECT y_true, y_pred, count(*) AS n FROM rated GROUP BY ALL)
, spans AS (SELECT *, sum(n) OVER (ORDER BY y_true, y_pred ROWS UNBOUNDED PRECEDING) AS end_, sum(n) OVER () AS total FROM cells)
, draws AS (SELECT b.replicate, ('0x' || substr(md5('boot|' || b.replicate || '|' || p.place), 1, 8))::BIGINT % t.total AS at_
  FROM (SELECT max(total)::BIGINT AS total FROM spans) t, range(1, 2001) b(replicate), range(0, (SELECT max(total)::BIGINT FROM spans)) p(place))
, drawn AS (SELECT replicate, y_true, y_pred, count(*) AS n FROM draws JOIN spans ON at_ >= end_ - n AND at_ < end_ GROUP BY ALL)
, t AS (SELECT replicate, y_true AS c, sum(n) AS m FROM drawn GROUP BY ALL), p AS (SELECT replicate, y_pred AS c, sum(n) AS m FROM drawn GROUP BY ALL)
, chance AS (SELECT replicate, sum(t.m * p.m) AS x FROM t JOIN p USING (replicate, c) GROUP BY ALL)
, hit AS (SELECT replicate, sum(n) AS n, coalesce(sum(n) FILTER (y_true = y_pred), 0) AS h FROM drawn GROUP BY ALL)
, kappas AS (SELECT (h / n::DOUBLE - coalesce(x, 0) / (n::DOUBLE * n)) / nullif(1 - coalesce(x, 0) / (n::DOUBLE * n), 0) AS kappa FROM hit LEFT JOIN chance USING (replicate))
SELECT count(kappa) AS valid, {R("CASE WHEN count(kappa) >= 1800 THEN quantile_cont(kappa, 0.025::DOUBLE) END", "kappa95_low")}, {R("CASE WHEN count(kappa) >= 1800 THEN quantile_cont(kappa, 0.975::DOUBLE) END", "kappa95_high")} FROM kappas"""


def exact_sql(cells: str) -> str:
    """Recursive tables: Clopper-Pearson bounds of ``cells`` (k, n, alpha), by halving on sums of binomial terms.

    A bound p solves P(X >= k) = alpha / 2 (low) or P(X <= k) = alpha / 2 (high).
    """
    term = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2))"
    tail = f"list_sum(list_transform(range(CASE side WHEN 'low' THEN k ELSE 0 END, CASE side WHEN 'low' THEN n + 1 ELSE k + 1 END), lambda i: {term}))"
    right = f"CASE side WHEN 'low' THEN {tail} < alpha / 2 ELSE {tail} > alpha / 2 END"
    return f"""halved(k, n, alpha, side, lo, hi, step) AS (
  SELECT DISTINCT k::BIGINT, n::BIGINT, alpha::DOUBLE, side, 0::DOUBLE, 1::DOUBLE, 0 FROM ({cells}) CROSS JOIN (VALUES ('low'), ('high')) s(side) WHERE n > 0
  UNION ALL
  SELECT k, n, alpha, side, CASE WHEN {right} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {right} THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM halved WHERE step < 52
), exact_bounds AS (
  SELECT k, n, alpha, max(CASE WHEN side = 'low' THEN CASE WHEN k = 0 THEN 0 ELSE (lo + hi) / 2 END END) AS low, max(CASE WHEN side = 'high' THEN CASE WHEN k = n THEN 1 ELSE (lo + hi) / 2 END END) AS high
  FROM halved WHERE step = 52 GROUP BY k, n, alpha)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


CP_SQL = recursive(DOC_ROWS) + GROUPS + ", " + exact_sql("SELECT correct AS k, n, 0.05::DOUBLE AS alpha FROM grouped") + f"""
SELECT model, scope, attribute, "group", g.n, correct, {R("correct / g.n::DOUBLE", "accuracy")}, {_bounds(("correct", "g.n", "wilson"))}, 0.05::DOUBLE AS alpha, {R("low", "low")}, {R("high", "high")}
FROM grouped g JOIN exact_bounds b ON b.k = correct AND b.n = g.n"""

WGA_BOUNDS_SQL = recursive(DOC_ROWS) + GROUPS + f""", eligible AS (
  SELECT *, 0.05::DOUBLE / count(*) OVER (PARTITION BY model, scope, attribute, minimum_n) AS alpha FROM grouped CROSS JOIN {THRESHOLDS} WHERE n >= minimum_n
), """ + exact_sql("SELECT correct AS k, n, alpha FROM eligible") + f"""
SELECT model, scope, attribute, minimum_n, {R("min(low)", "wga95_low")}, {R("min(high)", "wga95_high")}
FROM eligible e JOIN exact_bounds b ON b.k = correct AND b.n = e.n AND b.alpha = e.alpha GROUP BY model, scope, attribute, minimum_n"""

EOD_BOUNDS_SQL = recursive(DOC_ROWS) + DOC_RATES + """, sides AS (
  SELECT model, scope, attribute, "group", cls, 'tpr' AS rate, tp AS k, positive_n AS n, tpr AS value FROM rates WHERE n >= 15 AND positive_n >= 1
  UNION ALL SELECT model, scope, attribute, "group", cls, 'fpr', fp, negative_n, fpr FROM rates WHERE n >= 15 AND negative_n >= 1
), cells AS (SELECT *, 0.05::DOUBLE / count(*) OVER (PARTITION BY model, scope, attribute) AS alpha FROM sides
), """ + exact_sql("SELECT k, n, alpha FROM cells") + f"""
, bounded AS (SELECT c.*, low, high FROM cells c JOIN exact_bounds b USING (k, n, alpha)
), pairs AS (
  SELECT x.model, x.scope, x.attribute, x.cls, x.rate, max(abs(x.value - y.value)) AS gap, max(greatest(0, x.low - y.high, y.low - x.high)) AS gap_low, max(greatest(0, x.high - y.low, y.high - x.low)) AS gap_high
  FROM bounded x JOIN bounded y ON x.model = y.model AND x.scope = y.scope AND x.attribute = y.attribute AND x.cls = y.cls AND x.rate = y.rate AND x."group" < y."group" GROUP BY ALL)
SELECT model, scope, attribute, cls, {R("max(gap)", "eod")}, {R("max(gap_low)", "eod95_low")}, {R("max(gap_high)", "eod95_high")} FROM pairs GROUP BY model, scope, attribute, cls HAVING count(*) = 2"""

#: P(|T| < t) of Student's distribution with 6 degrees, of seven folds, in closed form.
_WITHIN = "sin(atan({t} / sqrt(6::DOUBLE))) * (1 + cos(atan({t} / sqrt(6::DOUBLE))) ** 2 / 2 + 3 * cos(atan({t} / sqrt(6::DOUBLE))) ** 4 / 8)"
PAIRED_TEST_SQL = recursive(ORDERS) + PAIRED + ", " + v.MANIFEST + f"""
, ratios AS (SELECT avg(ratio) AS test_train_ratio FROM (SELECT count(*) FILTER (role = 'Test')::DOUBLE / count(*) FILTER (role = 'Train') AS ratio FROM manifest GROUP BY fold))
, sums AS (SELECT avg(delta) AS mean_difference, stddev_samp(delta) AS sample_sd, count(delta) AS k, any_value(test_train_ratio) AS test_train_ratio FROM deltas CROSS JOIN ratios)
, errors AS (SELECT *, sample_sd * sqrt(1 / k::DOUBLE + test_train_ratio) AS corrected_se FROM sums)
, halved(lo, hi, step) AS (SELECT 0::DOUBLE, 100::DOUBLE, 0 UNION ALL SELECT CASE WHEN {_WITHIN.format(t="((lo + hi) / 2)")} < 0.95::DOUBLE THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_WITHIN.format(t="((lo + hi) / 2)")} < 0.95::DOUBLE THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM halved WHERE step < 60)
SELECT {R("mean_difference", "mean_difference")}, {R("sample_sd", "sample_sd")}, {R("corrected_se", "corrected_se")}, {R("test_train_ratio", "test_train_ratio")}, k,
       {R("mean_difference - lo * corrected_se", "ci_low")}, {R("mean_difference + lo * corrected_se", "ci_high")}, {R("1 - " + _WITHIN.format(t="abs(mean_difference / corrected_se)"), "two_sided_p")} FROM errors CROSS JOIN halved WHERE step = 60"""

MACRO_ROC_SQL = f"""{SCORED}
, points AS (SELECT model, cls, sum(neg) OVER w / (sum(neg) OVER e)::DOUBLE AS fpr, sum(pos) OVER w / (sum(pos) OVER e)::DOUBLE AS tpr FROM scored
  WINDOW w AS (PARTITION BY model, cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY model, cls)
), curve AS (SELECT model, cls, fpr, max(tpr) AS top, min(tpr) AS bottom FROM (SELECT * FROM points UNION ALL SELECT DISTINCT model, cls, 0::DOUBLE, 0::DOUBLE FROM points) GROUP BY ALL
), grid AS (SELECT model, fpr, cls FROM (SELECT DISTINCT model, fpr FROM curve) JOIN (SELECT DISTINCT model, cls FROM curve) USING (model)
), before AS (SELECT g.*, c.fpr AS x0, c.top AS y0 FROM grid g ASOF JOIN curve c ON g.model = c.model AND g.cls = c.cls AND g.fpr >= c.fpr
), around AS (SELECT b.*, c.fpr AS x1, c.bottom AS y1 FROM before b ASOF LEFT JOIN curve c ON b.model = c.model AND b.cls = c.cls AND b.fpr <= c.fpr
), macro AS (SELECT model, fpr, sum(CASE WHEN x0 = fpr OR x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (fpr - x0) / (x1 - x0) END) / 3 AS tpr FROM around GROUP BY ALL
), steps AS (SELECT model, (fpr - lag(fpr, 1, 0::DOUBLE) OVER o) * (tpr + lag(tpr, 1, 0::DOUBLE) OVER o) / 2 AS part FROM macro WINDOW o AS (PARTITION BY model ORDER BY fpr, tpr))
SELECT model, {R("sum(part)", "area")} FROM steps GROUP BY model"""


def bounds_of_groups(spark, d) -> DataFrame:
    return subgroups.with_exact_bounds(subgroups.subgroup_accuracy(doc_rows(spark, d)).withColumn("alpha", F.lit(0.05)), "correct", "n", "alpha")


def argmax_rows(spark, d) -> DataFrame:
    p = orders(spark, d)
    scores = F.transform("p", lambda x: F.ln(x))
    return p.select("model", "sample_id", argmax(F.col("p")).cast("long").alias("predicted"), F.array_max("p").alias("confidence"), F.element_at(softmax(scores), 1).alias("first_p"))


def macro_roc_area(spark, d) -> DataFrame:
    return metrics.macro_roc_areas(orders(spark, d), v.STATUS)


def class_areas(spark, d) -> DataFrame:
    return metrics.roc_areas(orders(spark, d), v.STATUS)


def normalized_confusion(spark, d) -> DataFrame:
    return metrics.confusion_normalized(v.pred_docs(spark, d), ["0", "1", "2"])


QUERIES = {
    "confusion_matrix": (
        lambda s, d: metrics.confusion(orders(s, d), v.STATUS),
        ORDERS + " SELECT model, y_true, y_pred, count(sample_id) AS n FROM (SELECT DISTINCT model FROM pred_orders) CROSS JOIN (SELECT unnest(['F', 'O', 'P']) AS y_true) CROSS JOIN (SELECT unnest(['F', 'O', 'P']) AS y_pred) LEFT JOIN pred_orders USING (model, y_true, y_pred) GROUP BY ALL",
    ),
    "confusion_normalized": (
        normalized_confusion,
        DOCS + f", c AS (SELECT model, y_true, y_pred, count(sample_id) AS n FROM (SELECT DISTINCT model FROM pred_docs) CROSS JOIN (SELECT unnest(['0', '1', '2']) AS y_true) CROSS JOIN (SELECT unnest(['0', '1', '2']) AS y_pred) LEFT JOIN pred_docs USING (model, y_true, y_pred) GROUP BY ALL) SELECT model, y_true, y_pred, n, {R('coalesce(n / nullif(sum(n) OVER (PARTITION BY model, y_true), 0)::DOUBLE, 0)', 'share')} FROM c",
    ),
    "class_report": (
        lambda s, d: metrics.class_report(orders(s, d), v.STATUS),
        ORDERS + OVR + f" SELECT model, cls, tp + fn AS support, fp + tn AS negative_n, tp, fn, fp, tn, {R(D('tp', 'tp + fn'), 'recall')}, {_bounds(('tp', 'tp + fn', 'recall'), ('tp', 'tp + fp', 'precision'))}, {R(D('tn', 'tn + fp'), 'specificity')}, {_spec()}, {R(D('tp', 'tp + fp'), 'precision')}, {R(D('2 * tp', '2 * tp + fp + fn'), 'f1')} FROM ovr",
    ),
    "text_report": (lambda s, d: metrics.text_report(orders(s, d), v.STATUS, "model"), ORDERS + OVR + REPORT_SQL),
    "overall_metrics": (lambda s, d: metrics.overall(orders(s, d), v.STATUS), ORDERS + OVR + OVERALL_TAIL),
    "log_loss_brier": (
        lambda s, d: metrics.log_loss_brier(orders(s, d), v.STATUS),
        ORDERS + LOSS_SQL,
    ),
    "reliability_bins": (
        lambda s, d: metrics.reliability(orders(s, d), v.STATUS),
        ORDERS + RELIABILITY + f" SELECT model, bin, {R('bin / 10.0::DOUBLE', 'lower')}, {R('(bin + 1) / 10.0::DOUBLE', 'upper')}, n, {R('accuracy', 'accuracy')}, {R('mean_confidence', 'mean_confidence')} FROM bins",
    ),
    "calibration_error": (
        lambda s, d: metrics.expected_calibration_error(orders(s, d), v.STATUS),
        ORDERS + RELIABILITY + f" SELECT model, {R('sum(n * abs(accuracy - mean_confidence)) / sum(n)', 'ece')} FROM bins GROUP BY model",
    ),
    "ovr_auc": (lambda s, d: metrics.ovr_auc(orders(s, d), v.STATUS), ORDERS + AUC_SQL),
    "roc_points": (lambda s, d: metrics.roc_points(orders(s, d), v.STATUS), ORDERS + ROC_SQL),
    "roc_class_areas": (
        class_areas,
        ORDERS + AUC_SQL.split("SELECT model, cls, positives")[0] + f" SELECT model, cls, {R('auc', 'area')} FROM per",
    ),
    "macro_roc_area": (macro_roc_area, ORDERS + MACRO_ROC_SQL),
    "class_weights": (
        lambda s, d: metrics.class_weights(v.pred_docs(s, d), ["0", "1", "2"], "y_true"),
        DOCS + f", c AS (SELECT cls, count(sample_id) AS n FROM (SELECT unnest(['0', '1', '2']) AS cls) LEFT JOIN pred_docs ON y_true = cls GROUP BY cls), w AS (SELECT *, CASE WHEN n > 0 THEN 1 / (n + 1e-6::DOUBLE) ELSE 0 END AS raw FROM c) SELECT cls, n, {R('raw / (SELECT sum(raw) FROM w) * 3', 'weight')} FROM w",
    ),
    "argmax_softmax": (
        argmax_rows,
        ORDERS + f" SELECT model, sample_id, list_position(p, list_max(p))::BIGINT - 1 AS predicted, {R('list_max(p)', 'confidence')}, {R('p[1] / (p[1] + p[2] + p[3])', 'first_p')} FROM pred_orders",
    ),
    "subgroup_accuracy_wilson": (
        lambda s, d: subgroups.subgroup_accuracy(order_rows(s, d)),
        ORDER_ROWS + GROUPS + f""" SELECT model, scope, attribute, "group", n, correct, {R("correct / n::DOUBLE", "accuracy")}, {_bounds(("correct", "n", "wilson"))} FROM grouped""",
    ),
    "subgroup_scopes": (
        lambda s, d: subgroups.subgroup_accuracy(doc_rows(s, d)),
        DOC_ROWS + GROUPS + f""" SELECT model, scope, attribute, "group", n, correct, {R("correct / n::DOUBLE", "accuracy")}, {_bounds(("correct", "n", "wilson"))} FROM grouped""",
    ),
    "wga_sensitivity": (
        lambda s, d: subgroups.wga_sensitivity(subgroups.subgroup_accuracy(order_rows(s, d))),
        ORDER_ROWS + GROUPS + f""" SELECT model, scope, attribute, minimum_n, count(*) FILTER (n >= minimum_n) AS groups_retained, count(*) FILTER (n < minimum_n) AS groups_excluded, count(*) AS groups_total, coalesce(sum(n) FILTER (n >= minimum_n), 0)::BIGINT AS images_retained, sum(n)::BIGINT AS images_total, {R("coalesce(sum(n) FILTER (n >= minimum_n), 0) / sum(n)::DOUBLE", "coverage")}, {R("min(correct / n::DOUBLE) FILTER (n >= minimum_n)", "wga")},
          '[' || coalesce(string_agg('"' || "group" || '"', ',' ORDER BY correct / n::DOUBLE, "group") FILTER (n >= minimum_n), '') || ']' AS ranks_low_to_high FROM grouped CROSS JOIN {THRESHOLDS} GROUP BY ALL""",
    ),
    "rate_table": (
        lambda s, d: subgroups.rate_table(order_rows(s, d), v.STATUS),
        ORDER_ROWS + RATES + f""" SELECT model, scope, attribute, "group", cls, n, tp, fn, fp, tn, positive_n, negative_n, {R("tpr", "tpr")}, {R("fpr", "fpr")}, {_bounds(("tp", "positive_n", "tpr"), ("fp", "negative_n", "fpr"))} FROM rates""",
    ),
    "eod_corrected": (
        lambda s, d: subgroups.eod_per_class(subgroups.rate_table(doc_rows(s, d), ["0", "1"])),
        DOC_ROWS + DOC_RATES + EOD + f" SELECT model, scope, attribute, cls, minimum_n, tpr_groups, fpr_groups, {R('tpr_gap', 'tpr_gap')}, {R('fpr_gap', 'fpr_gap')}, {R('eod', 'eod')} FROM eods",
    ),
    "eod_summary": (
        lambda s, d: subgroups.eod_summary(subgroups.eod_per_class(subgroups.rate_table(doc_rows(s, d), ["0", "1"]))),
        DOC_ROWS + DOC_RATES + EOD + f" SELECT model, scope, attribute, minimum_n, count(eod) AS classes_estimable, {R('CASE WHEN count(eod) = count(*) THEN avg(eod) END', 'macro_eod_all')}, {R('avg(eod)', 'macro_eod_available')}, {R('max(eod)', 'max_eod_available')} FROM eods GROUP BY ALL",
    ),
    "eod_legacy_skip": (lambda s, d: subgroups.legacy_fairness(doc_rows(s, d), ["0", "1"], "skip"), legacy_sql("skip")),
    "eod_legacy_zero": (lambda s, d: subgroups.legacy_fairness(doc_rows(s, d), ["0", "1"], "zero"), legacy_sql("zero")),
    "pooled_counts": (
        lambda s, d: subgroups.pooled_counts(order_rows(s, d), 15),
        ORDER_ROWS + """ SELECT model, attribute, "group", count(*) FILTER (y_true = y_pred) AS correct, count(*) AS n FROM axis_rows GROUP BY ALL HAVING count(*) >= 15""",
    ),
    "group_reports": (
        lambda s, d: metrics.text_report(subgroups.by_axes(v.pred_docs(s, d), ["toxic"]).withColumn("model", F.col("group")), ["0", "1"], "model"),
        DOCS + ", g AS (SELECT toxic AS model, y_true, y_pred FROM pred_docs), " + ovr_sql("g", "model", "['0', '1']") + REPORT_SQL,
    ),
    "cp_bounds": (bounds_of_groups, CP_SQL),
    "wga_bounds": (lambda s, d: subgroups.wga_bounds(subgroups.subgroup_accuracy(doc_rows(s, d))), WGA_BOUNDS_SQL),
    "eod_bounds": (lambda s, d: subgroups.eod_bounds(subgroups.rate_table(doc_rows(s, d), ["0", "1"]), 15), EOD_BOUNDS_SQL),
    "paired_fold_delta": (
        lambda s, d: comparison.fold_deltas(comparison.paired(orders(s, d), "a", "b")),
        ORDERS + PAIRED + f" SELECT fold, {R('accuracy_a', 'accuracy_a')}, {R('accuracy_b', 'accuracy_b')}, {R('delta', 'delta')} FROM deltas",
    ),
    "mcnemar_cells": (
        lambda s, d: comparison.discordant(comparison.paired(orders(s, d), "a", "b")),
        ORDERS + PAIRED + " SELECT count(*) AS n, count(*) FILTER (correct_a = 1 AND correct_b = 0) AS correct_a_wrong_b, count(*) FILTER (correct_a = 0 AND correct_b = 1) AS wrong_a_correct_b FROM paired",
    ),
    "sign_flip_test": (
        lambda s, d: comparison.sign_flip(comparison.fold_deltas(comparison.paired(orders(s, d), "a", "b"))),
        ORDERS + PAIRED + f", n AS (SELECT delta, row_number() OVER (ORDER BY fold) - 1 AS place FROM deltas), m AS (SELECT avg(delta) AS observed, count(*) AS k FROM deltas), f AS (SELECT mask, avg(CASE WHEN (mask >> place::INT) & 1 = 1 THEN -delta ELSE delta END) AS mean_ FROM range(0, 128) r(mask) CROSS JOIN n GROUP BY mask) SELECT {R('any_value(observed)', 'mean_delta')}, count(*) AS patterns, {R('avg((abs(mean_) >= abs(observed) - 1e-12)::INT)', 'p')} FROM f CROSS JOIN m",
    ),
    "corrected_paired_test": (
        lambda s, d: comparison.corrected_paired_test(comparison.fold_deltas(comparison.paired(orders(s, d), "a", "b")), comparison.test_train_ratio(v.manifest(s, d))),
        PAIRED_TEST_SQL,
    ),
    "rater_agreement_kappa": (
        lambda s, d: comparison.agreement(v.raters(s, d), "rater_a", "rater_b"),
        W + v.RATERS + ", labelled AS (SELECT 'raters' AS model, * FROM rated), " + ovr_sql("labelled", "model", "['0', '1']") + f", o AS ({OVERALL_TAIL.strip().removeprefix(',').replace('sums AS', 'WITH sums AS', 1)}), h AS (SELECT count(*) FILTER (y_true = y_pred) AS c, count(*) AS n FROM rated) SELECT h.n, (SELECT count(*) FROM raters) - h.n AS missing_pairs, {R('h.c / h.n::DOUBLE', 'agreement')}, {_bounds(('h.c', 'h.n', 'agreement'))}, o.kappa FROM o CROSS JOIN h",
    ),
    "bootstrap_kappa": (lambda s, d: comparison.bootstrap_kappa(v.raters(s, d), "rater_a", "rater_b", 2000), BOOT_SQL),
    "bootstrap_kappa_cells": (lambda s, d: comparison.bootstrap_kappa_cells(v.raters(s, d), "rater_a", "rater_b", 2000), None),
    "prediction_contract_violations": (
        lambda s, d: contracts.prediction_violations(orders(s, d), ["F", "O"]),
        ORDERS + " SELECT 0::BIGINT AS missing_fields, (count(*) FILTER (y_true NOT IN ('F', 'O') OR y_pred NOT IN ('F', 'O')))::BIGINT AS unknown_labels, count(*) AS invalid_probabilities, 0::BIGINT AS not_summing_to_one, (count(*) FILTER (['F', 'O'][list_position(p, list_max(p))] <> y_pred))::BIGINT AS argmax_mismatches, 0::BIGINT AS repeated_predictions, 0::BIGINT AS disagreeing_truths FROM pred_orders",
    ),
    "pairing_violations": (
        lambda s, d: contracts.pairing_violations(orders(s, d).filter("not (model = 'b' and sample_id % 97 = 0)"), "a", "b"),
        ORDERS + " SELECT sample_id, count(DISTINCT model) AS models, count(DISTINCT fold) AS folds, count(DISTINCT y_true) AS truths FROM pred_orders WHERE NOT (model = 'b' AND sample_id % 97 = 0) GROUP BY sample_id HAVING count(DISTINCT model) <> 2 OR count(DISTINCT fold) <> 1 OR count(DISTINCT y_true) <> 1",
    ),
}
