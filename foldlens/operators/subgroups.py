"""Subgroup accuracy, worst groups and equalized odds.

Everything starts from counts by (model, scope, attribute, group): predictions are
unpivoted over their axes once, counted, and what follows works on a few rows per group,
whatever the size of the prediction table. Undefined rates are NULL, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import clopper_pearson, ratio, wilson
from .metrics import one_vs_rest

#: Support thresholds of the sensitivity curves.
THRESHOLDS = (1, 5, 10, 15, 20, 30, 50)
GROUP = ("model", "scope", "attribute", "group")


def by_axes(preds: DataFrame, axes: list[str], scope_col: str | None = None) -> DataFrame:
    """(model, scope, attribute, group, y_true, y_pred): a row for each axis and scope.

    Scopes are 'all' and, with ``scope_col``, one for each of its values.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("missing")).alias("group")) for a in axes])
    scopes = F.array(F.lit("all"), *([F.concat(F.lit("route="), F.coalesce(F.col(scope_col), F.lit("missing")))] if scope_col else []))
    rows = preds.select("model", "y_true", "y_pred", F.explode(pairs).alias("a"), scopes.alias("scopes"))
    return rows.select("model", F.explode("scopes").alias("scope"), "a.attribute", "a.group", "y_true", "y_pred")


def subgroup_accuracy(rows: DataFrame) -> DataFrame:
    """n, correct, accuracy and Wilson bounds of each group of ``by_axes`` rows."""
    hit = F.count_if(F.col("y_true") == F.col("y_pred"))
    counted = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), hit.alias("correct"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return counted.select(
        *GROUP, "n", "correct", ratio(F.col("correct"), F.col("n")).alias("accuracy"), low.alias("wilson95_low"), high.alias("wilson95_high")
    )


def rate_table(rows: DataFrame, classes: list[str]) -> DataFrame:
    """One-vs-rest counts and rates of each group and class, with Wilson bounds."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    tpr_low, tpr_high = wilson(tp, tp + fn)
    fpr_low, fpr_high = wilson(fp, fp + tn)
    return one_vs_rest(rows, classes, *GROUP).select(
        *GROUP, "cls", "n", "tp", "fn", "fp", "tn", (tp + fn).alias("positive_n"), (fp + tn).alias("negative_n"),
        ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"), tpr_low.alias("tpr95_low"), tpr_high.alias("tpr95_high"),
        fpr_low.alias("fpr95_low"), fpr_high.alias("fpr95_high"),
    )


def _thresholds(thresholds: tuple[int, ...]) -> Column:
    return F.explode(F.array(*[F.lit(t) for t in thresholds]))


def wga_sensitivity(groups: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Worst-group accuracy and coverage by support threshold; no eligible group leaves NULL.

    ``groups`` are rows of ``subgroup_accuracy``. ranks lists the groups from low accuracy,
    ties by name.
    """
    keys = ("model", "scope", "attribute")
    rows = groups.withColumn("minimum_n", _thresholds(thresholds))
    enough = F.col("n") >= F.col("minimum_n")
    ranked = F.array_sort(F.collect_list(F.when(enough, F.struct("accuracy", "group"))))
    return rows.groupBy(*keys, "minimum_n").agg(
        F.count_if(enough).alias("groups_retained"), F.count_if(~enough).alias("groups_excluded"), F.count(F.lit(1)).alias("groups_total"),
        F.coalesce(F.sum(F.when(enough, F.col("n"))), F.lit(0)).alias("images_retained"), F.sum("n").alias("images_total"),
        ratio(F.coalesce(F.sum(F.when(enough, F.col("n"))), F.lit(0)), F.sum("n")).alias("coverage"),
        F.min(F.when(enough, F.col("accuracy"))).alias("wga"),
        F.to_json(F.transform(ranked, lambda r: r["group"])).alias("ranks_low_to_high"),
    )


def wga_bounds(groups: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Simultaneous bounds of the worst group: the minima of exact bounds at .05 / eligible groups."""
    keys = ("model", "scope", "attribute", "minimum_n")
    rows = groups.withColumn("minimum_n", _thresholds(thresholds)).filter(F.col("n") >= F.col("minimum_n"))
    rows = rows.withColumn("alpha", 0.05 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    bounded = with_exact_bounds(rows, "correct", "n", "alpha")
    return bounded.groupBy(*keys).agg(F.min("low").alias("wga95_low"), F.min("high").alias("wga95_high"))


def with_exact_bounds(rows: DataFrame, k: str, n: str, alpha: str) -> DataFrame:
    """``rows`` with Clopper-Pearson low and high, computed once for each distinct (k, n, alpha)."""
    cells = rows.select(F.col(k).alias("__k"), F.col(n).alias("__n"), F.col(alpha).alias("__a")).distinct()
    cells = cells.withColumn("b", clopper_pearson("__k", "__n", "__a")).select("__k", "__n", "__a", "b.low", "b.high")
    return rows.join(cells, (F.col(k) == F.col("__k")) & (F.col(n) == F.col("__n")) & (F.col(alpha) == F.col("__a"))).drop("__k", "__n", "__a")


def eod_per_class(rates: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS, minimum_rate_n: int = 1) -> DataFrame:
    """For each class the ranges of TPR and FPR over eligible groups and the larger one.

    A range needs two groups with a denominator; without both ranges eod is NULL.
    """
    rows = rates.withColumn("minimum_n", _thresholds(thresholds))
    out = rows.groupBy("model", "scope", "attribute", "cls", "minimum_n")
    aggregates = []
    for rate, base in (("tpr", "positive_n"), ("fpr", "negative_n")):
        value = F.when((F.col("n") >= F.col("minimum_n")) & (F.col(base) >= minimum_rate_n), F.col(rate))
        aggregates += [F.count(value).alias(f"{rate}_groups"), (F.max(value) - F.min(value)).alias(f"{rate}_range")]
    found = out.agg(*aggregates)
    gaps = {f"{r}_gap": F.when(F.col(f"{r}_groups") >= 2, F.col(f"{r}_range")) for r in ("tpr", "fpr")}
    both = F.col("tpr_gap").isNotNull() & F.col("fpr_gap").isNotNull()
    return found.withColumns(gaps).withColumn("eod", F.when(both, F.greatest("tpr_gap", "fpr_gap"))).drop("tpr_range", "fpr_range")


def eod_summary(eod: DataFrame) -> DataFrame:
    """Macro over all classes (NULL unless all can be estimated), macro and maximum over the available."""
    return eod.groupBy("model", "scope", "attribute", "minimum_n").agg(
        F.count("eod").alias("classes_estimable"),
        F.when(F.count("eod") == F.count(F.lit(1)), F.avg("eod")).alias("macro_eod_all"),
        F.avg("eod").alias("macro_eod_available"),
        F.max("eod").alias("max_eod_available"),
    )


def eod_bounds(rates: DataFrame, minimum_n: int, minimum_rate_n: int = 1) -> DataFrame:
    """Simultaneous bounds of the gaps per class, by exact bounds at .05 / eligible rate cells.

    The largest hi_i - lo_j over different groups i, j comes from the two largest highs and
    the two smallest lows, so no groups are paired.
    """
    keys = ("model", "scope", "attribute")
    kept = rates.filter(F.col("n") >= minimum_n)
    cell = F.explode(
        F.array(
            F.struct(F.lit("tpr").alias("rate"), F.col("tp").alias("k"), F.col("positive_n").alias("m"), F.col("tpr").alias("value")),
            F.struct(F.lit("fpr").alias("rate"), F.col("fp").alias("k"), F.col("negative_n").alias("m"), F.col("fpr").alias("value")),
        )
    )
    cells = kept.select(*keys, "group", "cls", cell.alias("c")).select(*keys, "group", "cls", "c.*").filter(F.col("m") >= minimum_rate_n)
    cells = cells.withColumn("alpha", 0.05 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    per = with_exact_bounds(cells, "k", "m", "alpha").groupBy(*keys, "cls", "rate").agg(
        F.count(F.lit(1)).alias("groups"), (F.max("value") - F.min("value")).alias("gap"), F.greatest(F.lit(0.0), F.max("low") - F.min("high")).alias("gap_low"),
        F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("high", "group")))), 1, 2).alias("tops"),
        F.slice(F.array_sort(F.collect_list(F.struct("low", "group"))), 1, 2).alias("bottoms"),
    )
    spans = F.flatten(F.transform("tops", lambda a: F.transform("bottoms", lambda b: F.when(a["group"] != b["group"], a["high"] - b["low"]))))
    per = per.withColumn("gap_high", F.greatest(F.lit(0.0), F.array_max(spans))).filter("groups >= 2")
    wide = per.groupBy(*keys, "cls").agg(
        F.count(F.lit(1)).alias("rates"), F.max("gap").alias("eod"), F.max("gap_low").alias("eod95_low"), F.max("gap_high").alias("eod95_high")
    )
    return wide.filter("rates = 2").drop("rates")


def legacy_fairness(rows: DataFrame, classes: list[str], absent_class: str = "skip", min_support: int | None = None) -> DataFrame:
    """The older definitions: wga and a TPR-only eod, the largest mean absolute TPR gap of two groups.

    ``absent_class``: a class that a group lacks is skipped in its pairs ('skip') or has TPR
    0 ('zero'). With no comparable pair eod is 0, not NULL. Of equal gaps the first pair by
    name is the worst. Groups are few (attribute values), so their pairs may be joined.
    """
    if absent_class not in ("skip", "zero"):
        raise ValueError("absent_class is 'skip' or 'zero'")
    rates = rate_table(rows, classes)
    if min_support is not None:
        rates = rates.filter(F.col("n") >= min_support)
    keys = ["model", "scope", "attribute"]
    tpr = F.col("tpr") if absent_class == "skip" else F.coalesce("tpr", F.lit(0.0))
    side = rates.select(*keys, "cls", "group", tpr.alias("tpr")).filter("tpr is not null")
    a = side.withColumnsRenamed({"group": "group_a", "tpr": "tpr_a"})
    b = side.withColumnsRenamed({"group": "group_b", "tpr": "tpr_b"})
    gaps = a.join(b, [*keys, "cls"]).filter("group_a < group_b").groupBy(*keys, "group_a", "group_b")
    gaps = gaps.agg(F.avg(F.abs(F.col("tpr_a") - F.col("tpr_b"))).alias("gap")).filter("gap > 0")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("gap", 12).desc(), "group_a", "group_b"))
    worst = gaps.withColumn("place", first).filter("place = 1").select(*keys, "group_a", "group_b", "gap")
    accuracy = F.min(F.when(F.col("cls") == classes[0], ratio(F.col("correct"), F.col("n"))))
    correct = rates.join(rates.groupBy(*GROUP).agg(F.sum("tp").alias("correct")), list(GROUP))
    wga = correct.groupBy(*keys).agg(accuracy.alias("wga"))
    return wga.join(worst, keys, "left").select(*keys, "wga", F.coalesce("gap", F.lit(0.0)).alias("eod"), "group_a", "group_b")


def pooled_counts(rows: DataFrame, minimum: int = 0) -> DataFrame:
    """Correct and total of each attribute's groups, pooled over folds."""
    hit = F.count_if(F.col("y_true") == F.col("y_pred"))
    return rows.groupBy("model", "attribute", "group").agg(hit.alias("correct"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)
