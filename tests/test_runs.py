import pytest
from pyspark.sql import functions as F

from foldlens import __main__ as cli
from foldlens import runs
from foldlens.functions import schedules
from foldlens.operators import contracts, joins


def table(spark, n=140):
    meta = spark.range(n).select(
        F.lpad(F.col("id").cast("string"), 4, "0").alias("sample_id"), (F.col("id") % 2).cast("string").alias("label"), (F.col("id") % 70).cast("string").alias("age"),
        F.when(F.col("id") % 2 == 0, "Man").otherwise("woman").alias("dominant_gender"), F.lit("White").alias("dominant_race"), F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("patient_id"),
    )
    return meta


def test_command_line_run(spark, tmp_path):
    meta = runs.audit_columns(table(spark))
    meta.write.parquet(str(tmp_path / "meta"))
    rows = meta.select("sample_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), (F.col("sample_id").cast("int") % 7 + 1).alias("fold"), F.when(F.col("label") == "0", "x").otherwise("y").alias("y_true"))
    right = F.col("sample_id").cast("int") % F.when(F.col("model") == "a", 9).otherwise(5) != 0
    rows = rows.withColumn("y_pred", F.when(right, F.col("y_true")).otherwise(F.when(F.col("y_true") == "x", "y").otherwise("x")))
    rows = rows.withColumns({"p_0": F.when(F.col("y_pred") == "x", 0.8).otherwise(0.3), "p_1": F.when(F.col("y_pred") == "x", 0.2).otherwise(0.7)})
    rows.coalesce(1).write.csv(str(tmp_path / "preds"), header=True)
    (tmp_path / "classes.json").write_text('["x", "y"]')
    args = ["evaluate", "--classes", str(tmp_path / "classes.json"), "--metadata", str(tmp_path / "meta"), "--predictions", str(tmp_path / "preds"), "--compare", "a,b", "--out", str(tmp_path / "out")]
    cli.main(args)
    overall = {r.model: r for r in spark.read.parquet(str(tmp_path / "out" / "overall")).collect()}
    assert overall["a"].n == 140 and overall["a"].accuracy > overall["b"].accuracy
    assert spark.read.parquet(str(tmp_path / "out" / "sign_flip")).first().patterns == 128
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        cli.main(args)


def test_grouped_splits(spark):
    got = runs.grouped_splits(table(spark))
    rows = got["manifest"].collect()
    assert len(rows) == 7 * 140 and {r.role for r in rows} == {"Train", "Val", "Test"}
    with pytest.raises(contracts.ContractError):
        runs.grouped_splits(table(spark).drop("patient_id"))


def test_consent_is_needed(spark):
    with pytest.raises(contracts.ContractError):
        runs.rater_agreement(table(spark), table(spark), ["label"], confirmed=False)
    got = runs.rater_agreement(table(spark), table(spark), ["label"], confirmed=True, replicates=20)
    assert got["label_agreement"].first().kappa == pytest.approx(1)


def test_joins_state_their_multiplicity(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([("a", "x")], "k string, w string")
    assert sorted((r.v, r.w) for r in joins.attach(left, right, "k").collect()) == [(1, "x"), (2, "x"), (3, None)]
    with pytest.raises(Exception, match="repeat the key"):
        joins.attach(left, right, "k", validate="one_to_one").collect()
    with pytest.raises(contracts.ContractError):
        joins.attach(left, left, "k")
    files = spark.createDataFrame([("x/One.png",), ("y/two.png",)], "f string")
    assert joins.by_basename(spark.createDataFrame([("q/ONE.PNG",)], "p string"), files, "p", "f").first().resolved == "x/One.png"
    with pytest.raises(Exception, match="repeat the key"):
        joins.by_basename(spark.createDataFrame([("q/a.png",)], "p string"), spark.createDataFrame([("x/a.png",), ("y/A.png",)], "f string"), "p", "f").collect()


def test_learning_rate(spark):
    rates = [r[0] for r in spark.range(0, 101, 50).select(schedules.learning_rate(F.col("id"), 50, 100, 1.0)).collect()]
    assert rates == pytest.approx([0, 1, 0])


def test_audit_results(spark, tmp_path):
    (tmp_path / "m").mkdir()
    lines = ["fold,accuracy,roc_auc_macro,kappa,mcc,wga_all,eod_all,wga_filtered,eod_filtered,pooled_groups"]
    for fold in (1, 2):
        lines.append(f"""{fold},0.75,0.9,0.5,0.5,0.5,0,0.5,0,"{{'g': {{'x': (np.int64(1), np.int64(2)), 'y': (np.int64(2), np.int64(2))}}}}\"""")
    (tmp_path / "m" / "kfold.csv").write_text("\n".join(lines) + "\n")
    got = runs.audit_results(spark, str(tmp_path / "*" / "kfold.csv"))
    assert {(r.group, r.correct, r.n) for r in got["subgroup_counts"].collect()} == {("x", 2, 4), ("y", 4, 4)}
    assert {r.metric: r["mean"] for r in got["model_summary"].collect()}["accuracy"] == 0.75
