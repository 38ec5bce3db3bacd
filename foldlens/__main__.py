"""Command line: python -m foldlens RUN --out FOLDER ...; tables are Parquet or CSV files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from . import __version__, runs
from .operators import contracts, folds
from .sources import sinks, tables

#: Flags that name an input table, whose digest the provenance has.
INPUTS = ("metadata", "inventory", "manifest", "route_manifest", "reviewed_pairs", "candidates", "rater_a", "rater_b", "features")


def _table(spark: SparkSession, path: str | None, schema: str | None = None) -> DataFrame | None:
    if path is None:
        return None
    if path.endswith(".csv"):
        # every column is text unless a schema says otherwise: ids keep their leading zeros
        return tables.read_csv(spark, path, schema) if schema else spark.read.csv(path, header=True, multiLine=True, escape='"')
    return spark.read.parquet(path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foldlens", description=__doc__)
    sub = top.add_subparsers(dest="run", required=True)

    def add(name: str, *required: str, **optional) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flag in (*required, "out"):
            p.add_argument(f"--{flag}", required=True)
        for flag, default in optional.items():
            p.add_argument(f"--{flag.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return p

    add("audit-results", "results", compare=None)
    p = add("audit-data", "metadata", data_root=None, inventory=None, manifest=None, strip_prefix="", route_manifest=None, phash_distance=6)
    p.add_argument("--flat-images", action="store_true", help="look images up by their unique base name")
    p.add_argument("--reconstruct-legacy-splits", action="store_true")
    p.add_argument("--confirm-original-row-order", action="store_true")
    p = add("evaluate", "classes", "metadata", manifest=None, compare=None, minimum_rate_n=1)
    p.add_argument("--predictions", required=True, nargs="+")
    add("grouped-splits", "metadata", reviewed_pairs=None, candidates=None, folds=7, seed=42)
    p = add("agreement", "rater-a", "rater-b", columns="appearance_proxy,gender_proxy,age_proxy", bootstrap=2000, seed="boot")
    p.add_argument("--confirm-independent", action="store_true")
    p = add("probes", "features", "metadata", "manifest", columns="age_proxy,gender_proxy,appearance_proxy", train_control_repeats=0, seed=42)
    p.add_argument("--confirm-independent-frozen-features", action="store_true")
    p = add("splits", "metadata", folds=7, seed=42)
    p.add_argument("--confirm-hash-order", action="store_true", help="folds follow hashed ids, not the rows' order")
    return top


def audit_data(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    if (a.data_root is None) == (a.inventory is None):
        raise ValueError("give either --data-root or --inventory")
    if a.manifest and a.reconstruct_legacy_splits:
        raise ValueError("use either --manifest or --reconstruct-legacy-splits")
    meta, manifest = _table(spark, a.metadata), _table(spark, a.manifest)
    if a.reconstruct_legacy_splits:
        contracts.require_consent(a.confirm_original_row_order, "that the metadata's rows are the original ones; folds follow hashed ids")
    if a.data_root:
        return runs.audit_folder(spark, a.data_root, meta, a.strip_prefix, a.flat_images, _table(spark, a.route_manifest), manifest, a.phash_distance, a.reconstruct_legacy_splits)
    if a.reconstruct_legacy_splits:
        manifest = folds.manifest(folds.stratified_folds(meta, "sample_id", "label", 7, 42), 7, 42)
    return runs.audit_data(meta, _table(spark, a.inventory), manifest, a.phash_distance)


def frames(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    if a.run == "audit-results":
        return runs.audit_results(spark, a.results, tuple(a.compare.split(",")) if a.compare else None)
    if a.run == "audit-data":
        return audit_data(spark, a)
    if a.run == "evaluate":
        classes = tables.read_json_list(spark, a.classes)
        compare = tuple(a.compare.split(",")) if a.compare else None
        manifest = _table(spark, a.manifest, "id string, label string, fold int, role string")
        return runs.evaluate(runs.read_predictions(spark, a.predictions, classes), _table(spark, a.metadata), classes, manifest, compare, a.minimum_rate_n)
    if a.run == "grouped-splits":
        return runs.grouped_splits(_table(spark, a.metadata), _table(spark, a.reviewed_pairs), a.folds, a.seed, _table(spark, a.candidates))
    if a.run == "agreement":
        return runs.rater_agreement(_table(spark, a.rater_a), _table(spark, a.rater_b), a.columns.split(","), a.confirm_independent, a.bootstrap, a.seed)
    if a.run == "probes":
        return runs.probes(_table(spark, a.features), _table(spark, a.metadata), _table(spark, a.manifest), a.columns.split(","), a.confirm_independent_frozen_features, a.train_control_repeats, a.seed)
    contracts.require_consent(a.confirm_hash_order, "that folds follow hashed ids")
    own = folds.stratified_folds(_table(spark, a.metadata), "sample_id", "label", a.folds, a.seed)
    manifest = folds.manifest(own, a.folds, a.seed)
    return {"manifest": manifest, "fold_counts": folds.fold_counts(manifest)}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("foldlens").getOrCreate()
    inputs = {n: _table(spark, p) for n, p in vars(args).items() if n in INPUTS and p}
    sinks.write_run(frames(spark, args), args.out, {"run": args.run, "version": __version__, "parameters": vars(args)}, inputs)


if __name__ == "__main__":
    main()
