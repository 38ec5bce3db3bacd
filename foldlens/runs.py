"""Whole runs: the reports that belong together, as named DataFrames.

Each function checks its contracts first (eagerly: a report on broken input would be
wrong) and returns lazy frames; ``sinks.write_run`` stores them in a new folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cleaning
from .operators import comparison, contracts, duplicates, folds, joins, metrics, probe, profile, subgroups
from .shared_folder import durable
from .sources import tables
from .sources.images import read_images

AXES = ("age_proxy", "gender_proxy", "appearance_proxy", "composite_proxy", "annotation_route", "source_status")


def read_predictions(spark: SparkSession, paths: list[str], classes: list[str]) -> DataFrame:
    schema = "sample_id string, model string, fold int, y_true string, y_pred string" + "".join(f", p_{i} double" for i in range(len(classes)))
    rows = reduce(DataFrame.unionByName, [tables.read_csv(spark, p, schema) for p in paths])
    return rows.withColumn("p", F.array(*[f"p_{i}" for i in range(len(classes))])).drop(*[f"p_{i}" for i in range(len(classes))])


def audit_columns(meta: DataFrame) -> DataFrame:
    """``meta`` with canonical age, gender, appearance, route and composite columns."""
    gender = cleaning.first_present(meta, ["dominant_gender", "gender"], "missing")
    look = cleaning.first_present(meta, ["dominant_race", "skin_tone"], "missing")
    out = meta.withColumns(
        {
            "age_proxy": cleaning.age_proxy(cleaning.first_present(meta, ["age"], None)),
            "gender_raw": cleaning.normalized(gender),
            "gender_proxy": cleaning.gender_proxy(gender),
            "appearance_raw": cleaning.normalized(look),
            "appearance_proxy": cleaning.appearance_proxy(look),
            **{c: cleaning.normalized(F.col(c)) if c in meta.columns else F.lit("unknown") for c in ("annotation_route", "source_status", "body_site")},
        }
    )
    return out.withColumn("composite_proxy", cleaning.composite(F.col("age_proxy"), F.col("gender_proxy"), F.col("appearance_proxy")))


def audit_data(meta: DataFrame, images: DataFrame, manifest: DataFrame | None = None, distance: int = 6) -> dict[str, DataFrame]:
    """Metadata (sample_id, label, raw attributes) and an inventory (id, hashes, decode_ok)."""
    contracts.require_columns(meta, "sample_id", "label")
    contracts.require_none(contracts.duplicate_keys(meta, "sample_id"), "metadata repeats ids")
    inventory = images.withColumnRenamed("id", "sample_id")
    audited = joins.attach(audit_columns(meta), inventory, "sample_id", validate="one_to_one")
    contracts.require_none(audited.filter("decode_ok is null or not decode_ok"), "metadata names unreadable files")
    pairs = duplicates.candidate_pairs(images, distance)
    out = {
        "audit_metadata": audited,
        "duplicate_candidates": pairs,
        "crosstabs": profile.crosstabs(audited, [("label", "annotation_route"), ("label", "appearance_proxy"), ("label", "gender_proxy"), ("label", "age_proxy"), ("annotation_route", "appearance_proxy"), ("annotation_route", "gender_proxy"), ("annotation_route", "age_proxy"), ("source_status", "appearance_proxy"), ("source_status", "gender_proxy"), ("source_status", "age_proxy"), ("annotation_route", "source_status"), ("annotation_route", "body_site"), ("body_site", "appearance_proxy")]),
        "observed_mapping": profile.observed_mapping(audited, {"appearance_raw": "appearance_proxy", "gender_raw": "gender_proxy"}),
        "dataset_accounting": profile.accounting(audited, "sample_id", "decode_ok", [*AXES[:3], "annotation_route", "source_status", "body_site"]),
    }
    if manifest is not None:
        out["fold_counts"] = folds.fold_counts(manifest)
        out["duplicates_crossing_roles"] = duplicates.cross_role_pairs(pairs, manifest)
        for key in ("patient_id", "case_id", "parent_id", "acquisition_session"):
            if key in meta.columns:
                members = meta.select(F.col("sample_id").alias("id"), F.col(key).alias("entity"))
                out[f"{key}_crossing_roles"] = duplicates.entities_across_roles(members, manifest, key)
    return out


def audit_folder(
    spark: SparkSession, root: str, meta: DataFrame, strip_prefix: str = "", flat_images: bool = False, routes: DataFrame | None = None, manifest: DataFrame | None = None, distance: int = 6, reconstruct: bool = False
) -> dict[str, DataFrame]:
    """``audit_data`` from a folder of images and metadata that names them by ``filepath``.

    Paths lead below ``root`` once ``strip_prefix`` is gone (an error for a path without it), or, with
    ``flat_images``, are looked up by base name, which must be unique. ``routes`` (sample_id,
    annotation_route) joins once per image. Files are decoded once; pairs have the metadata's
    split and label of both sides. With ``reconstruct`` the folds are the seven stratified ones of seed 42.
    """
    images = durable(read_images(spark, root))
    if images.isEmpty():
        raise contracts.ContractError("no images below the given root")
    contracts.require_columns(meta, "filepath", "label")
    named = meta.drop("sample_id").withColumn("original_filepath", F.col("filepath"))
    if flat_images:
        named = joins.by_basename(named, images, "filepath", "sample_id").withColumnRenamed("resolved", "sample_id")
        contracts.require_none(named.filter("sample_id is null").select("original_filepath"), "metadata names files that aren't there")
    else:
        path = cleaning.without_prefix(F.col("filepath"), strip_prefix) if strip_prefix else cleaning.posix(F.col("filepath"))
        named = named.withColumn("sample_id", path)
    if routes is not None:
        if "annotation_route" in named.columns:
            raise contracts.ContractError("a route column is already present: reconcile the sources explicitly")
        contracts.require_none(routes.join(images, "sample_id", "left_anti").select("sample_id"), "routes of images outside of the inventory")
        named = joins.attach(named, routes.select("sample_id", "annotation_route"), "sample_id", validate="one_to_one")
    named = named.drop("filepath")
    if reconstruct:
        manifest = folds.manifest(folds.stratified_folds(named, "sample_id", "label", 7, 42), 7, 42)
    if manifest is not None:
        contracts.require_none(manifest.select(F.col("id").alias("sample_id")).join(images, "sample_id", "left_anti"), "fold ids outside of the inventory")
    out = audit_data(named, images.withColumnRenamed("sample_id", "id"), manifest, distance)
    pairs = out["duplicate_candidates"]
    for s in "ab":
        told = named.select(F.col("sample_id").alias(f"id_{s}"), *[(F.col(c) if c in named.columns else F.lit("unknown")).alias(f"metadata_{c}_{s}") for c in ("split", "label")])
        pairs = pairs.join(told, f"id_{s}", "left")
    counts = images.agg(F.count(F.lit(1)).alias("a"), F.count_if("decode_ok").alias("b"), F.count_if(~F.col("decode_ok")).alias("c"))
    stages = {"a": "original image files", "b": "decode success", "c": "decode failures (not automatically excluded)"}
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("stage"), F.col(c).alias("n")) for c, t in stages.items()]))
    return out | ({"reconstructed_fold_manifest": manifest} if reconstruct else {}) | {
        "image_inventory": images,
        "duplicate_candidates": pairs,
        "image_accounting": counts.select(rows.alias("r")).select("r.*"),
        "image_characteristics_by_route": profile.numeric_profile(out["audit_metadata"], "annotation_route", ["width", "height", "bytes", "grayscale_mean"]),
    }


def evaluate(preds: DataFrame, meta: DataFrame, classes: list[str], manifest: DataFrame | None = None, compare: tuple[str, str] | None = None, minimum_rate_n: int = 1) -> dict[str, DataFrame]:
    """All metrics, subgroup reports and comparisons of checked predictions."""
    found = contracts.prediction_violations(preds, classes).first().asDict()
    if any(found.values()):
        raise contracts.ContractError(f"prediction contract: {found}")
    axes = [a for a in AXES if a in meta.columns]
    if not axes:
        raise contracts.ContractError("metadata has no audit attribute")
    contracts.require_none(preds.join(meta, "sample_id", "left_anti").select("sample_id"), "predictions without metadata")
    if manifest is not None:
        contracts.require_none(contracts.not_test_violations(preds, manifest), "a prediction outside of its test fold")
    rows = subgroups.by_axes(joins.attach(preds, meta.select("sample_id", *axes), "sample_id"), axes, "annotation_route" if "annotation_route" in axes else None)
    groups, rates = subgroups.subgroup_accuracy(rows), subgroups.rate_table(rows, classes)
    eod = subgroups.eod_per_class(rates, minimum_rate_n=minimum_rate_n)
    out = {
        "confusion": metrics.confusion(preds, classes), "overall": metrics.overall(preds, classes), "calibration": metrics.log_loss_brier(preds, classes),
        "calibration_error": metrics.expected_calibration_error(preds, classes), "auc": metrics.ovr_auc(preds, classes), "disease_metrics": metrics.class_report(preds, classes),
        "reliability_bins": metrics.reliability(preds, classes), "subgroup_metrics": groups, "group_class_rates": rates, "eod_per_class": eod, "eod_summary": subgroups.eod_summary(eod),
        "support_sensitivity": subgroups.wga_sensitivity(groups), "wga_bounds": subgroups.wga_bounds(groups), "eod_bounds": subgroups.eod_bounds(rates, 1, minimum_rate_n),
    }
    if compare is not None:
        contracts.require_none(contracts.pairing_violations(preds, *compare), "models that can't be paired")
        pairs = comparison.paired(preds, *compare)
        out |= {"paired_fold_differences": comparison.fold_deltas(pairs), "paired_counts": comparison.discordant(pairs), "sign_flip": comparison.sign_flip(comparison.fold_deltas(pairs))}
        if manifest is not None:
            out["paired_comparison"] = comparison.corrected_paired_test(comparison.fold_deltas(pairs), comparison.test_train_ratio(manifest))
    return out


def grouped_splits(meta: DataFrame, pairs: DataFrame | None = None, k: int = 7, seed: int = 42, candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """Clusters of samples that share an identifier or a confirmed pair, and folds that keep them.

    With ``candidates`` (id_a, id_b) the reviewed ``pairs`` must be exactly these: a review of
    another or of a shortened list doesn't stand for the current one.
    """
    contracts.require_none(contracts.duplicate_keys(meta, "sample_id"), "repeated ids")
    edges = [duplicates.star_edges(meta.select(F.col("sample_id").alias("id"), F.col(c).alias("entity"))) for c in ("patient_id", "case_id", "parent_id", "acquisition_session") if c in meta.columns]
    if pairs is not None:
        if candidates is not None:
            contracts.require_none(duplicates.stale_reviews(pairs, candidates), "a review that differs from the current candidates")
        contracts.require_none(duplicates.review_violations(pairs), "pairs that nobody has reviewed")
        edges.append(pairs.filter(F.lower(F.trim("verified_related")) == "yes").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    if not edges:
        raise contracts.ContractError("nothing tells which samples belong together")
    clusters = duplicates.connected_components(meta.sparkSession, meta.select(F.col("sample_id").alias("id")), reduce(DataFrame.union, edges))
    rows = clusters.join(meta.select(F.col("sample_id").alias("id"), "label"), "id")
    if rows.select("cluster").distinct().limit(k).count() < k:
        raise contracts.ContractError(f"fewer than {k} clusters")
    own = folds.grouped_folds(rows, "id", "label", "cluster", k, seed)
    manifest = folds.grouped_manifest(own, k, seed=seed)
    contracts.require_none(folds.role_violations(manifest), "a cluster in several roles")
    contracts.require_none(folds.missing_training_classes(manifest), "a training fold lacks a class")
    return {"manifest": manifest, "fold_counts": folds.fold_counts(manifest)}


def rater_agreement(a: DataFrame, b: DataFrame, columns: list[str], confirmed: bool, replicates: int = 2000, seed: str = "boot") -> dict[str, DataFrame]:
    contracts.require_consent(confirmed, "that the raters were independent")
    for side in (a, b):
        contracts.require_none(contracts.duplicate_keys(side, "sample_id"), "repeated ids")
    contracts.require_none(contracts.unreferenced(a, b, "sample_id"), "raters with different samples")
    out = {}
    for column in columns:
        pair = a.select("sample_id", F.col(column).alias("rater_a")).join(b.select("sample_id", F.col(column).alias("rater_b")), "sample_id")
        out[f"{column}_agreement"] = comparison.agreement(pair, "rater_a", "rater_b")
        out[f"{column}_bootstrap"] = comparison.bootstrap_kappa_cells(pair, "rater_a", "rater_b", replicates, seed)
        out[f"{column}_table"] = pair.na.fill("MISSING").groupBy("rater_a", "rater_b").agg(F.count(F.lit(1)).alias("n"))
    return out


def probes(features: DataFrame, meta: DataFrame, manifest: DataFrame, columns: list[str], confirmed: bool, train_control_repeats: int = 0, seed: int = 42) -> dict[str, DataFrame]:
    """Out-of-fold logistic probes on images, metadata and both. Labels are numbers.

    Each repeat adds two controls whose training metadata is permuted, by whole tuples and by
    column; their test metadata stays authentic. Validation rows aren't used.
    """
    contracts.require_consent(confirmed, "that the features were frozen independently of these labels")
    contracts.require_none(contracts.duplicate_keys(features, "sample_id"), "repeated features")
    contracts.require_none(folds.held_out_once_violations(meta.select(F.col("sample_id").alias("id")), manifest), "rows not held out exactly once")
    rows = manifest.select("id", "fold", "role").join(meta.withColumnRenamed("sample_id", "id").select("id", "label", *columns), "id")
    rows = rows.join(features.withColumnRenamed("sample_id", "id").select("id", "features"), "id")
    blocks = probe.sparse_blocks(rows, "features", columns)
    predicted = probe.logistic_joint(blocks)
    log = probe.joint_fold_log(predicted, blocks)
    out = {}
    for name, _, _ in probe.BLOCKS:
        out |= {f"{name}_predictions": predicted.filter(F.col("block") == name).drop("block"), f"{name}_folds": log.filter(F.col("block") == name).drop("block")}
    for repeat in range(train_control_repeats):
        for mode, name in (("joint", "joint_tuple"), ("independent", "independent_columns")):
            moved = probe.sparse_blocks(probe.randomized_training(rows, columns, mode, f"{seed}|{repeat}"), "features", columns)
            control = probe.logistic_joint(moved, probe.BLOCKS[2:])
            title = f"{name}_train_randomized_r{repeat}"
            out |= {f"{title}_predictions": control.drop("block"), f"{title}_folds": probe.joint_fold_log(control, moved).drop("block")}
    return out


def audit_results(spark: SparkSession, pattern: str, compare: tuple[str, str] | None = None, metric: str = "accuracy") -> dict[str, DataFrame]:
    """Result files of several models: summaries, pooled subgroup counts and their curves.

    With ``compare`` also two models' folds in pairs, with the exact sign-flip test of ``metric``.
    """
    rows = tables.read_fold_metrics(spark, pattern)
    contracts.require_none(contracts.duplicate_keys(rows, "model", "fold"), "a fold twice")
    counts = profile.parse_counts(rows.select("model", "fold", "accuracy", "pooled_groups"), "pooled_groups").drop("pooled_groups")
    contracts.require_none(counts.filter("not valid"), "counts that can't be read")
    contracts.require_none(contracts.accounting_violations(counts), "counts that contradict each other")
    pooled = profile.merge_counts(counts, "model").withColumn("scope", F.lit("pooled"))
    per_fold = counts.withColumns({"scope": F.concat(F.lit("fold_"), F.col("fold")), "accuracy": F.col("correct") / F.col("n")})
    both = pooled.select("model", "scope", "attribute", "group", "n", "correct", "accuracy").unionByName(per_fold.select("model", "scope", "attribute", "group", "n", "correct", "accuracy"))
    paired = {}
    if compare is not None:
        folds_of = comparison.paired_folds(rows, *compare, ["accuracy", "roc_auc_macro", "kappa", "mcc", "wga_all", "wga_filtered"])
        paired = {"paired_folds": folds_of, "sign_flip": comparison.sign_flip(folds_of.filter(F.col("metric") == metric).select("fold", "delta"))}
    return paired | {
        "model_summary": profile.metric_summary(rows, ["accuracy", "roc_auc_macro", "kappa", "mcc", "wga_all", "wga_filtered"], "model"),
        "subgroup_counts": pooled,
        "support_sensitivity": subgroups.wga_sensitivity(both),
        "wga_bounds": subgroups.wga_bounds(both),
    }
