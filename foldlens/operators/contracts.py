"""Data contracts as queries that return violations, and a way to fail on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..functions.statistics import ratio

ROLES = ("Train", "Val", "Test")


class ContractError(ValueError):
    """A contract has violations."""


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")


def require_none(violations: DataFrame, what: str) -> None:
    """Raises with one example if ``violations`` has a row; reads no more than that."""
    found = violations.take(1)
    if found:
        raise ContractError(f"{what}, for example {found[0].asDict()}")


def first_examples(violations: DataFrame, *keys: str, n: int = 10) -> DataFrame:
    """The first ``n`` violations by ``keys`` for a message; each task keeps ``n`` rows, nothing is sorted as a whole."""
    return violations.orderBy(*keys).limit(n)


def missing_columns(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(table, column) of each required column that its table lacks; reads schemas only."""
    return [(name, c) for name, columns in sorted(required.items()) for c in columns if c not in tables[name].columns]


def require_consent(given: bool, what: str) -> None:
    if not given:
        raise ContractError(f"{what} must be confirmed explicitly")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unreferenced(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side that the other lacks, with the side that has them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_a = a.join(b, key, "left_anti").withColumn("only_in", F.lit("left"))
    return only_a.unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))


def prediction_violations(preds: DataFrame, classes: list[str]) -> DataFrame:
    """One row of violation counts: one pass for the rows, one aggregation for each key."""
    known = lambda c: F.col(c).isin(*classes)
    required = [F.col(c).isNull() for c in ("sample_id", "model", "fold", "y_true", "y_pred")]
    bad_p = F.exists("p", lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)) | (F.size("p") != len(classes))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    label = F.try_element_at(F.array(*[F.lit(c) for c in classes]), (argmax(F.col("p")) + 1).cast("int"))
    rows = preds.agg(
        F.count_if(F.greatest(*[r.cast("int") for r in required]) == 1).alias("missing_fields"),
        F.count_if(~known("y_true") | ~known("y_pred")).alias("unknown_labels"),
        F.count_if(bad_p).alias("invalid_probabilities"),
        F.count_if(F.abs(total - 1) > 1e-5).alias("not_summing_to_one"),
        F.count_if(label != F.col("y_pred")).alias("argmax_mismatches"),
    )
    repeated = duplicate_keys(preds, "model", "sample_id").agg(F.count(F.lit(1)).alias("repeated_predictions"))
    truths = preds.groupBy("sample_id").agg(F.min("y_true").alias("a"), F.max("y_true").alias("b")).filter("a <> b")
    return rows.join(repeated).join(truths.agg(F.count(F.lit(1)).alias("disagreeing_truths")))


def not_test_violations(preds: DataFrame, manifest: DataFrame) -> DataFrame:
    """Predictions whose sample isn't Test in the stated fold."""
    roles = manifest.select(F.col("id").alias("sample_id"), "fold", "role")
    joined = preds.select("model", "sample_id", "fold").join(roles, ["sample_id", "fold"], "left")
    return joined.filter("role is null or role <> 'Test'").select("model", "sample_id", "fold", "role")


def manifest_violations(manifest: DataFrame) -> DataFrame:
    unknown = manifest.agg(F.count_if(F.col("role").isNull() | ~F.col("role").isin(*ROLES)).alias("unknown_roles"))
    return unknown.join(duplicate_keys(manifest, "id", "fold").agg(F.count(F.lit(1)).alias("repeated_rows")))


def accounting_violations(counts: DataFrame) -> DataFrame:
    """Folds whose attributes don't agree in totals, or whose accuracy isn't correct / total.

    ``counts``: model, fold, attribute, group, correct, n, accuracy (of the fold).
    """
    per = counts.groupBy("model", "fold", "attribute", "accuracy").agg(F.sum("correct").alias("correct"), F.sum("n").alias("n"))
    spread = per.groupBy("model", "fold", "accuracy").agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("correct").alias("k_min"), F.max("correct").alias("k_max")
    )
    wrong = F.abs(ratio(F.col("k_max"), F.col("n_max")) - F.col("accuracy")) > 1e-12
    return spread.filter((F.col("n_min") != F.col("n_max")) | (F.col("k_min") != F.col("k_max")) | wrong)


def pairing_violations(preds: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Samples that only one of two models has, or where fold or truth differ."""
    rows = preds.filter(F.col("model").isin(model_a, model_b)).groupBy("sample_id")
    per = rows.agg(F.count_distinct("model").alias("models"), F.count_distinct("fold").alias("folds"), F.count_distinct("y_true").alias("truths"))
    return per.filter("models <> 2 or folds <> 1 or truths <> 1")


def ambiguous_basenames(paths: DataFrame, basename: str) -> DataFrame:
    """Base names that several paths share: a lookup by them would be a guess."""
    return duplicate_keys(paths, basename)
