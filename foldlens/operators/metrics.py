"""Classification metrics over prediction tables.

A prediction table has model, sample_id, y_true, y_pred and, for calibration, the
probability vector p in class order. All metrics start from counts by (model, true,
predicted), so that one combined shuffle of a few rows serves them; ranks (AUC, ROC)
are the exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..functions.ordering import running_sums
from ..functions.statistics import ratio, wilson
from ..shared_folder import durable

#: Clipping of probabilities in the log-loss: the spacing of doubles at 1.
EPS = 2.220446049250313e-16


def class_rows(preds: DataFrame, classes: list[str], *keys: str) -> DataFrame:
    """The distinct ``keys`` of ``preds`` with every class (columns cls, idx)."""
    table = F.posexplode(F.array(*[F.lit(c) for c in classes]))
    return preds.select(*keys).distinct().select(*keys, table.alias("idx", "cls"))


def pair_counts(preds: DataFrame, *keys: str) -> DataFrame:
    return preds.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion(preds: DataFrame, classes: list[str]) -> DataFrame:
    """model, y_true, y_pred, n over the whole class list, 0 where nothing was counted."""
    grid = class_rows(preds, classes, "model").select("model", F.col("cls").alias("y_true"))
    grid = grid.withColumn("y_pred", F.explode(F.array(*[F.lit(c) for c in classes])))
    counted = grid.join(pair_counts(preds, "model"), ["model", "y_true", "y_pred"], "left")
    return counted.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def confusion_normalized(preds: DataFrame, classes: list[str]) -> DataFrame:
    row = Window.partitionBy("model", "y_true")
    share = F.coalesce(ratio(F.col("n"), F.sum("n").over(row)), F.lit(0.0))
    return confusion(preds, classes).withColumn("share", share)


def one_vs_rest(preds: DataFrame, classes: list[str], *keys: str) -> DataFrame:
    """keys, cls, n, tp, fn, fp, tn for every class, from the counts of pairs."""
    counts = pair_counts(preds, *keys)
    per = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[
            F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(f"{name}_{i}")
            for i, c in enumerate(classes)
            for name, condition in (
                ("tp", (F.col("y_true") == c) & (F.col("y_pred") == c)),
                ("fn", (F.col("y_true") == c) & (F.col("y_pred") != c)),
                ("fp", (F.col("y_true") != c) & (F.col("y_pred") == c)),
            )
        ],
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("cls"), *[F.col(f"{x}_{i}").alias(x) for x in ("tp", "fn", "fp")]) for i, c in enumerate(classes)])
    )
    out = per.select(*keys, "n", rows.alias("r")).select(*keys, "n", "r.*")
    return out.withColumn("tn", F.col("n") - F.col("tp") - F.col("fn") - F.col("fp"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def class_report(preds: DataFrame, classes: list[str]) -> DataFrame:
    """Support, counts, recall, specificity, precision and F1 of each class with bounds."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    recall_low, recall_high = wilson(tp, tp + fn)
    fall_low, fall_high = wilson(fp, fp + tn)
    precision_low, precision_high = wilson(tp, tp + fp)
    return one_vs_rest(preds, classes, "model").select(
        "model", "cls", (tp + fn).alias("support"), (fp + tn).alias("negative_n"), "tp", "fn", "fp", "tn",
        ratio(tp, tp + fn).alias("recall"), recall_low.alias("recall95_low"), recall_high.alias("recall95_high"),
        ratio(tn, tn + fp).alias("specificity"), (1 - fall_high).alias("specificity95_low"), (1 - fall_low).alias("specificity95_high"),
        ratio(tp, tp + fp).alias("precision"), precision_low.alias("precision95_low"), precision_high.alias("precision95_high"),
        f1(tp, fp, fn).alias("f1"),
    )


def text_report(preds: DataFrame, classes: list[str], *keys: str) -> DataFrame:
    """The usual report as rows: each class, accuracy, macro avg and weighted avg; 0 for undefined."""
    tp, fn, fp = (F.col(c) for c in ("tp", "fn", "fp"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = one_vs_rest(preds, classes, *keys).select(
        *keys, "cls", zero(ratio(tp, tp + fp)).alias("precision"), zero(ratio(tp, tp + fn)).alias("recall"),
        zero(f1(tp, fp, fn)).alias("f1"), (tp + fn).alias("support"), "tp",
    )
    scores = ("precision", "recall", "f1")
    summary = rows.groupBy(*keys).agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[ratio(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(f"weighted_{s}") for s in scores],
    )
    accuracy = ratio(F.col("tp"), F.col("support"))
    lines = F.explode(
        F.array(
            F.struct(F.lit("accuracy").alias("cls"), *[accuracy.alias(s) for s in scores], "support"),
            *[F.struct(F.lit(f"{k} avg").alias("cls"), *[F.col(f"{k}_{s}").alias(s) for s in scores], "support") for k in ("macro", "weighted")],
        )
    )
    return rows.drop("tp").unionByName(summary.select(*keys, lines.alias("r")).select(*keys, "r.*"))


def overall(preds: DataFrame, classes: list[str], *keys: str) -> DataFrame:
    """n, accuracy with bounds, macro F1, Cohen's kappa and the multiclass MCC per ``keys``."""
    keys = keys or ("model",)
    rows = one_vs_rest(preds, classes, *keys)
    tp, t, p = F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"), (F.col("tp") + F.col("fp")).cast("double")
    sums = rows.groupBy(*keys).agg(
        F.first("n").alias("n"), F.sum("tp").alias("correct"), F.sum(t * p).alias("tp_sum"), F.sum(t * t).alias("tt"), F.sum(p * p).alias("pp"),
        F.avg(F.coalesce(f1(tp, F.col("fp"), F.col("fn")), F.lit(0.0))).alias("macro_f1"),
    )
    n, c = F.col("n").cast("double"), F.col("correct").cast("double")
    chance = F.col("tp_sum") / (n * n)
    low, high = wilson(F.col("correct"), F.col("n"))
    root = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    return sums.select(
        *keys, "n", (c / n).alias("accuracy"), low.alias("accuracy95_low"), high.alias("accuracy95_high"), "macro_f1",
        F.try_divide(c / n - chance, 1 - chance).alias("kappa"),
        F.coalesce(F.try_divide(c * n - F.col("tp_sum"), root), F.lit(0.0)).alias("mcc"),
    )


def class_index(label: Column, classes: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in classes]), label).cast("int") - 1


def log_loss_brier(preds: DataFrame, classes: list[str]) -> DataFrame:
    truth = class_index(F.col("y_true"), classes)
    own = F.element_at("p", truth + 1)
    squares = F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x)
    # sum (p - onehot)^2 = sum p^2 - 2 p_y + 1
    clipped = F.least(F.greatest(own, F.lit(EPS)), F.lit(1 - EPS))
    return preds.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), (-F.avg(F.ln(clipped))).alias("log_loss"), F.avg(squares - 2 * own + 1).alias("brier_sum")
    )


def reliability(preds: DataFrame, classes: list[str], bins: int = 10) -> DataFrame:
    """Equal-width bins of the top probability; 1.0 belongs to the last, empty bins have no row."""
    confidence = F.array_max("p")
    correct = (argmax(F.col("p")) == class_index(F.col("y_true"), classes)).cast("double")
    place = F.least(F.floor(confidence * bins).cast("int"), F.lit(bins - 1))
    out = preds.groupBy("model", place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(correct).alias("accuracy"), F.avg(confidence).alias("mean_confidence")
    )
    return out.withColumns({"lower": F.col("bin") / F.lit(float(bins)), "upper": (F.col("bin") + 1) / F.lit(float(bins))})


def expected_calibration_error(preds: DataFrame, classes: list[str]) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return reliability(preds, classes).groupBy("model").agg((F.sum(gap) / F.sum("n")).alias("ece"))


def one_vs_rest_scores(preds: DataFrame, classes: list[str]) -> DataFrame:
    """model, cls, positive (0 or 1), score: one row for each prediction and class."""
    table = F.array(*[F.lit(c) for c in classes])
    rows = preds.select("model", "y_true", F.posexplode("p").alias("idx", "score"))
    cls = F.element_at(table, F.col("idx") + 1)
    return rows.select("model", cls.alias("cls"), (F.col("y_true") == cls).cast("long").alias("positive"), "score")


def _by_score(preds: DataFrame, classes: list[str]) -> DataFrame:
    """Counts by (model, cls, score): equal scores are combined before any window."""
    return one_vs_rest_scores(preds, classes).groupBy("model", "cls", "score").agg(
        F.sum("positive").alias("pos"), F.sum(1 - F.col("positive")).alias("neg")
    )


def _score_bucket(score: Column) -> Column:
    """65,536 buckets of probabilities, in their order."""
    return F.floor(score * 65_535).cast("long")


def ovr_auc(preds: DataFrame, classes: list[str]) -> DataFrame:
    """One-vs-rest AUC per class by average ranks; NULL if a class is absent or universal.

    macro is the mean only if all classes can be estimated.
    """
    scored = running_sums(_by_score(preds, classes), ["model", "cls"], _score_bucket(F.col("score")), [F.col("score")], {"under": F.col("neg")}, own=False)
    won = F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2))
    per = scored.groupBy("model", "cls").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), won.alias("won"))
    per = per.withColumn("auc", F.try_divide(F.col("won"), (F.col("positives") * F.col("negatives")).cast("double")))
    every = Window.partitionBy("model")
    estimable = F.count("auc").over(every)
    return per.select(
        "model", "cls", "positives", "negatives", "auc", estimable.alias("classes_estimable"),
        F.when(estimable == F.count(F.lit(1)).over(every), F.avg("auc").over(every)).alias("macro_auc"),
    )


def roc_points(preds: DataFrame, classes: list[str]) -> DataFrame:
    """(model, cls, threshold, fpr, tpr): one point for each distinct score, from the highest."""
    keys = ["model", "cls"]
    sums = {"false_upto": F.col("neg"), "true_upto": F.col("pos")}
    scored = running_sums(_by_score(preds, classes), keys, -_score_bucket(F.col("score")), [F.col("score").desc()], sums)
    totals = one_vs_rest_totals(preds, classes)
    return scored.join(F.broadcast(totals), keys).select(
        *keys, F.col("score").alias("threshold"), ratio(F.col("false_upto"), F.col("negatives")).alias("fpr"), ratio(F.col("true_upto"), F.col("positives")).alias("tpr")
    )


def one_vs_rest_totals(preds: DataFrame, classes: list[str]) -> DataFrame:
    """(model, cls, positives, negatives): a few rows."""
    counts = preds.groupBy("model").agg(*[F.count_if(F.col("y_true") == c).alias(f"c{i}") for i, c in enumerate(classes)], F.count(F.lit(1)).alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"c{i}").alias("positives")) for i, c in enumerate(classes)]))
    return counts.select("model", "n", rows.alias("r")).select("model", "r.cls", "r.positives", (F.col("n") - F.col("r.positives")).alias("negatives"))


#: Curves are cut into so many stretches of false-positive rate. Distinct rates lie 1 / negatives
#: apart at least, so a stretch has at most negatives / STRETCHES of each class.
STRETCHES = 4096


def _stretch() -> Column:
    return F.least(F.floor(F.col("fpr") * STRETCHES), F.lit(STRETCHES - 1))


def macro_roc(points: DataFrame, classes: int) -> DataFrame:
    """(model, fpr, tpr): the mean of the classes' curves, interpolated on the union of their fprs.

    Windows run within stretches of a curve. What they need from outside, the last known point
    before a stretch and the first one after it, comes from a table of a row for each
    stretch of each curve.
    """
    start = points.select("model", "cls", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).distinct()
    curve = points.select("model", "cls", "fpr", "tpr").union(start).groupBy("model", "cls", "fpr").agg(F.max("tpr").alias("top"), F.min("tpr").alias("bottom"))
    grid = curve.select("model", "fpr").distinct().join(curve.select("model", "cls").distinct(), "model")
    joined = grid.join(curve, ["model", "cls", "fpr"], "left").withColumns({"known": F.when(F.col("top").isNotNull(), F.col("fpr")), "stretch": _stretch()})
    joined = durable(joined)  # read twice
    keys = ["model", "cls", "stretch"]
    is_known = F.col("known").isNotNull()
    ends = joined.groupBy(*keys).agg(F.max(F.when(is_known, F.struct("known", "top"))).alias("last"), F.min(F.when(is_known, F.struct("known", "bottom"))).alias("first"))
    along = Window.partitionBy("model", "cls").orderBy("stretch")  # STRETCHES rows at most
    back = Window.partitionBy("model", "cls").orderBy(F.col("stretch").desc())
    outside = ends.select(
        *keys, F.last("last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.last("first", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("after")
    )
    joined = joined.join(outside, keys)
    # Both frames grow from their first row; one that shrinks would be summed anew for each row.
    up = Window.partitionBy(*keys).orderBy("fpr").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.col("fpr").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x0, y0 = F.coalesce(F.last("known", True).over(up), "before.known"), F.coalesce(F.last("top", True).over(up), "before.top")
    x1, y1 = F.coalesce(F.last("known", True).over(down), "after.known"), F.coalesce(F.last("bottom", True).over(down), "after.bottom")
    joined = joined.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1})
    value = F.coalesce("top", F.col("y0") + (F.col("y1") - F.col("y0")) * F.try_divide(F.col("fpr") - F.col("x0"), F.col("x1") - F.col("x0")), "y0")
    return joined.withColumn("at", value).groupBy("model", "fpr").agg((F.sum("at") / classes).alias("tpr"))


def trapezoid_area(points: DataFrame, *keys: str) -> DataFrame:
    """Area under each curve of (fpr, tpr) points, from (0, 0).

    Neighbours are found within stretches of a curve; the first point of a stretch follows the
    last one of the stretch before.
    """
    cut = durable(points.select(*keys, "fpr", "tpr").withColumn("stretch", _stretch()))  # read twice
    last = cut.groupBy(*keys, "stretch").agg(F.max(F.struct("fpr", "tpr")).alias("last"))
    along = Window.partitionBy(*keys).orderBy("stretch")  # STRETCHES rows at most
    outside = last.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("stretch").alias("__stretch"), F.lag("last").over(along).alias("before"))
    same = F.col("stretch") == F.col("__stretch")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    order = Window.partitionBy(*keys, "stretch").orderBy("fpr", "tpr")
    earlier = F.coalesce(F.lag(F.struct("fpr", "tpr")).over(order), "before")
    parts = cut.join(outside, same).withColumn("earlier", earlier)
    width = F.col("fpr") - F.coalesce("earlier.fpr", F.lit(0.0))
    height = (F.col("tpr") + F.coalesce("earlier.tpr", F.lit(0.0))) / 2
    return parts.withColumn("part", width * height).groupBy(*keys).agg(F.sum("part").alias("area"))


#: Buckets of scores of a curve whose areas are summed from counts.
BUCKETS = 4096


def _counts_in_buckets(preds: DataFrame, classes: list[str]) -> DataFrame:
    """(key, score, pos, neg): counts by score; key names model, class and a bucket, numbered from the highest scores."""
    bucket = -F.floor(F.col("score") * BUCKETS)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pos", "neg")]
    return _by_score(preds, classes).select(F.struct("model", "cls", bucket.alias("bucket")).alias("key"), "score", *counts)


def _within(column: str) -> Column:
    return F.sum(column).over(Window.partitionBy("key").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0))


def _before(value: Column) -> Column:
    """``value`` summed over a curve's buckets before a bucket."""
    along = Window.partitionBy("key.model", "key.cls").orderBy("key.bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows
    return F.coalesce(F.sum(value).over(along), F.lit(0))


def roc_areas(preds: DataFrame, classes: list[str]) -> DataFrame:
    """(model, cls, area) under the curves of ``roc_points``, as ``trapezoid_area`` gives.

    A trapezoid needs what is above its score only: each bucket sums its own, and what the buckets
    before it add is its negatives times their positives. So scores are neither joined nor read again.
    """
    own = F.sum(F.col("neg") * (F.col("upto") - F.col("pos") / 2))
    per = _counts_in_buckets(preds, classes).withColumn("upto", _within("pos")).groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), own.alias("own"))
    per = per.withColumn("part", F.col("own") + F.col("neg") * _before(F.col("pos")))
    area = F.try_divide(F.sum("part"), F.sum("pos").cast("double") * F.sum("neg"))
    return per.groupBy("key.model", "key.cls").agg(area.alias("area"))


def macro_roc_areas(preds: DataFrame, classes: list[str]) -> DataFrame:
    """(model, area) under the curves of ``macro_roc``, as ``trapezoid_area`` gives, without their points.

    Between neighbouring rates of all classes a class's curve is straight, so its trapezoids add up to its own
    area. Only where it jumps at a rate, the point of ``macro_roc`` is the top of the jump, and the
    stretch from the rate before it, of any class, gains half of the jump: a window over the rates finds that one.
    """
    counts = _counts_in_buckets(preds, classes)
    curve = Window.partitionBy("key.model", "key.cls")
    sums = counts.groupBy("key").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    sums = sums.select("key", _before(F.col("p")).alias("true"), _before(F.col("n")).alias("false"), F.sum("p").over(curve).alias("positives"), F.sum("n").over(curve).alias("negatives"))
    rows = counts.join(F.broadcast(sums), "key")  # BUCKETS rows a curve
    rows = rows.withColumns({"true": F.col("true") + _within("pos"), "false": F.col("false") + _within("neg")})
    fpr = ratio(F.col("false"), F.col("negatives"))
    area = F.try_divide(F.col("neg") * (F.col("true") - F.col("pos") / 2), F.col("positives").cast("double") * F.col("negatives"))
    jump = F.when(F.col("neg") == 0, ratio(F.col("pos"), F.col("positives")))
    rates = rows.withColumn("fpr", fpr).groupBy("key", "fpr").agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("area"), F.coalesce(F.sum(jump), F.lit(0.0)).alias("jump"))
    rates = rates.filter("fpr is not null").select(F.col("key.model").alias("model"), _stretch().alias("stretch"), "fpr", "area", "jump")
    along = Window.partitionBy("model", "stretch").orderBy("fpr")
    earlier = F.lag("fpr").over(along)
    rates = rates.withColumn("lower", F.when(earlier < F.col("fpr"), earlier))
    rates = rates.withColumn("lower", F.last("lower", True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    per = rates.groupBy("model", "stretch").agg(
        F.sum("area").alias("area"), F.sum(F.col("jump") * (F.col("fpr") - F.col("lower"))).alias("known"), F.sum(F.when(F.col("lower").isNull(), F.col("jump"))).alias("jump"),
        F.min("fpr").alias("first"), F.max("fpr").alias("last"),
    )
    gap = F.col("first") - F.coalesce(F.lag("last").over(Window.partitionBy("model").orderBy("stretch")), F.lit(0.0))  # STRETCHES rows
    gain = (F.coalesce("known", F.lit(0.0)) + F.col("jump") * gap) / 2
    return per.withColumn("part", F.col("area") + gain).groupBy("model").agg((F.sum("part") / len(classes)).alias("area"))


def class_weights(labels: DataFrame, classes: list[str], label: str) -> DataFrame:
    """Inverse frequencies scaled to sum to the number of classes; an absent class weighs 0."""
    counted = labels.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    table = labels.sparkSession.createDataFrame([(c,) for c in classes], "cls string").join(counted, "cls", "left")
    raw = F.coalesce(1 / (F.col("n") + 1e-6), F.lit(0.0))
    every = Window.partitionBy(F.lit(0))
    return table.select("cls", F.coalesce("n", F.lit(0)).alias("n"), (raw / F.sum(raw).over(every) * len(classes)).alias("weight"))
