"""Paired comparison of models and agreement of raters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import corrected_t, ratio, wilson


def paired(preds: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """(sample_id, fold, correct_a, correct_b): one aggregation instead of a self-join."""
    hit = lambda m: F.max(F.when(F.col("model") == m, (F.col("y_true") == F.col("y_pred")).cast("int")))
    rows = preds.filter(F.col("model").isin(model_a, model_b)).groupBy("sample_id", "fold")
    return rows.agg(hit(model_a).alias("correct_a"), hit(model_b).alias("correct_b")).filter("correct_a is not null and correct_b is not null")


def fold_deltas(pairs: DataFrame) -> DataFrame:
    per = pairs.groupBy("fold").agg(F.avg("correct_a").alias("accuracy_a"), F.avg("correct_b").alias("accuracy_b"))
    return per.withColumn("delta", F.col("accuracy_a") - F.col("accuracy_b"))


def discordant(pairs: DataFrame) -> DataFrame:
    """n and the two discordant cells of the paired table."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.expr("correct_a = 1 and correct_b = 0")).alias("correct_a_wrong_b"),
        F.count_if(F.expr("correct_a = 0 and correct_b = 1")).alias("wrong_a_correct_b"),
    )


def sign_flip(deltas: DataFrame) -> DataFrame:
    """Exact two-sided p over all 2^k signs of the fold differences (k folds, few)."""
    folds = deltas.select(F.col("delta"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("fold")) - 1).alias("place"))
    mean = folds.agg(F.avg("delta").alias("observed"), F.count(F.lit(1)).alias("k"))
    signs = mean.select("observed", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, int(k)) - 1"))).alias("mask"))
    flipped = signs.join(folds).groupBy("mask", "observed").agg(
        F.avg(F.when(F.expr("getbit(mask, place)") == 1, -F.col("delta")).otherwise(F.col("delta"))).alias("mean")
    )
    extreme = F.abs("mean") >= F.abs("observed") - 1e-12
    return flipped.agg(F.first("observed").alias("mean_delta"), F.count(F.lit(1)).alias("patterns"), F.avg(extreme.cast("double")).alias("p"))


def test_train_ratio(manifest: DataFrame) -> DataFrame:
    per = manifest.groupBy("fold").agg(F.count_if(F.col("role") == "Test").alias("test"), F.count_if(F.col("role") == "Train").alias("train"))
    return per.withColumn("ratio", ratio(F.col("test"), F.col("train")))


def corrected_paired_test(deltas: DataFrame, ratios: DataFrame) -> DataFrame:
    """Mean difference with a standard error corrected for overlapping training sets.

    se = sd * sqrt(1 / k + test / train); without variance there is no interval and no p.
    """
    mean_ratio = ratios.agg(F.avg("ratio").alias("test_train_ratio"))
    stats = deltas.agg(F.avg("delta").alias("mean_difference"), F.stddev_samp("delta").alias("sample_sd"), F.count("delta").alias("k")).join(mean_ratio)
    stats = stats.withColumn("corrected_se", F.col("sample_sd") * F.sqrt(1 / F.col("k") + F.col("test_train_ratio")))
    tested = stats.withColumn("t", corrected_t("mean_difference", "corrected_se", "k"))
    return tested.select("mean_difference", "sample_sd", "corrected_se", "test_train_ratio", "k", "t.ci_low", "t.ci_high", F.col("t.p").alias("two_sided_p"))


def paired_folds(rows: DataFrame, a: str, b: str, metrics: list[str]) -> DataFrame:
    """(fold, metric, value_a, value_b, delta) of two models' result rows (model, fold, metrics); a fold that either lacks is an error."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = rows.filter(F.col("model").isin(a, b)).select("model", "fold", values.alias("v")).select("model", "fold", "v.*")
    sides = long.groupBy("fold", "metric").agg(
        F.count_if(F.col("model") == a).alias("n_a"), F.count_if(F.col("model") == b).alias("n_b"),
        F.max(F.when(F.col("model") == a, F.col("value"))).alias("value_a"), F.max(F.when(F.col("model") == b, F.col("value"))).alias("value_b"),
    )
    wrong = F.raise_error(F.concat(F.lit("the models don't both have exactly one row of fold "), F.col("fold").cast("string")))
    checked = sides.withColumn("delta", F.when((F.col("n_a") == 1) & (F.col("n_b") == 1), F.col("value_a") - F.col("value_b")).otherwise(wrong.cast("double")))
    return checked.select("fold", "metric", "value_a", "value_b", "delta")


def complete_pairs(raters: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where both raters said something; 'unclear' is something."""
    x, y = F.trim(F.col(a).cast("string")), F.trim(F.col(b).cast("string"))
    return raters.select("sample_id", x.alias("y_true"), y.alias("y_pred")).filter("y_true <> '' and y_pred <> ''")


def agreement(raters: DataFrame, a: str, b: str) -> DataFrame:
    """n, missing pairs, raw agreement with bounds and Cohen's kappa, over all categories that occur.

    Everything comes from the cells (pairs of categories): none is collected or cut off. kappa
    is NULL where chance alone would agree always.
    """
    cells = complete_pairs(raters, a, b).groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    true, pred = (cells.groupBy(F.col(c).alias("c")).agg(F.sum("n").alias(f"m_{c}")) for c in ("y_true", "y_pred"))
    cross = true.join(pred, "c").agg(F.coalesce(F.sum(F.col("m_y_true").cast("double") * F.col("m_y_pred")), F.lit(0.0)).alias("cross"))
    hits = F.coalesce(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))), F.lit(0))
    both = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), hits.alias("hits")).join(cross).join(raters.agg(F.count(F.lit(1)).alias("all_pairs")))
    low, high = wilson(F.col("hits"), F.col("n"))
    both = both.withColumns({"agreement": ratio(F.col("hits"), F.col("n")), "pe": ratio(F.col("cross"), F.col("n").cast("double") * F.col("n"))})
    return both.select(
        "n", (F.col("all_pairs") - F.col("n")).alias("missing_pairs"), "agreement", low.alias("agreement95_low"), high.alias("agreement95_high"),
        F.try_divide(F.col("agreement") - F.col("pe"), 1 - F.col("pe")).alias("kappa"),
    )


def draw(seed: str, replicate: Column, place: Column, n: Column) -> Column:
    """A place 0 ... n - 1, the same in every run: the hash of seed, replicate and place."""
    word = F.md5(F.concat_ws("|", F.lit(seed), replicate.cast("string"), place.cast("string")))
    return F.pmod(F.conv(F.substring(word, 1, 8), 16, 10).cast("long"), n)


#: Draws of a piece, tasks that pieces are spread over, and slices of the places that cells are cut at.
PIECE, PIECE_TASKS, SLICES = 1 << 16, 200, 4096


def bootstrap_kappa(raters: DataFrame, a: str, b: str, replicates: int = 200, seed: str = "boot") -> DataFrame:
    """Percentile bounds of kappa over hash-drawn resamples.

    A resample of n rows is drawn as counts of the rated pairs (cells): places are numbered
    by cell, so a draw needs no row of the table, and only cells (a few) are joined. Draws are
    made in pieces, spread over tasks, and counted by cell where they are made.
    Degenerate resamples have no kappa; bounds need 90 % of valid ones.
    """
    cells = complete_pairs(raters, a, b).groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    upto = every.orderBy("y_true", "y_pred").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"end": F.sum("n").over(upto), "all": F.sum("n").over(every)})
    cells = cells.select("y_true", "y_pred", (F.col("end") - F.col("n")).alias("begin"), "end", "all")
    total = cells.agg(F.max("all").alias("all"))
    runs = total.select("all", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    # one row for each piece of a replicate, spread over tasks before there is a row for each draw
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, F.lit(PIECE).cast("long")))
    pieces = runs.select("all", "replicate", starts.alias("start")).repartition(PIECE_TASKS, "replicate", "start")
    upto_piece = F.least(F.col("start") + PIECE, F.col("all")) - 1
    draws = pieces.select("all", "replicate", F.explode(F.sequence(F.col("start"), upto_piece)).alias("place"))
    at = draws.select("replicate", draw(seed, F.col("replicate"), F.col("place"), F.col("all")).alias("at"), F.ceil(F.col("all") / SLICES).cast("long").alias("wide"))
    # cells are cut at slices of the places, so that a draw meets few cells by an equi-join, however many there are
    wide = F.ceil(F.col("all") / SLICES).cast("long")
    slices = F.explode(F.sequence(F.expr("begin div wide"), F.expr("(end - 1) div wide")))
    cut = cells.withColumn("wide", wide).select("begin", "end", slices.alias("slice"))
    drawn = at.select("replicate", "at", F.expr("at div wide").alias("slice")).join(F.broadcast(cut), "slice").filter("at >= begin and at < end")
    drawn = drawn.groupBy("replicate", "begin").agg(F.count(F.lit(1)).alias("n"))
    drawn = drawn.join(F.broadcast(cells.select("begin", "y_true", "y_pred")), "begin").select("replicate", "y_true", "y_pred", "n")
    total_n = F.sum("n").over(Window.partitionBy("replicate"))
    marks = drawn.select("replicate", "n", total_n.alias("all"), "y_true", "y_pred")
    true, pred = (marks.groupBy("replicate", F.col(c).alias("c")).agg(F.sum("n").alias(f"m_{c}")) for c in ("y_true", "y_pred"))
    chance = true.join(pred, ["replicate", "c"]).groupBy("replicate").agg(F.sum(F.col("m_y_true") * F.col("m_y_pred")).alias("cross"))
    hit = marks.groupBy("replicate").agg(F.max("all").alias("all"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hits"))
    both = hit.join(chance, "replicate", "left").withColumns({"po": ratio(F.col("hits"), F.col("all")), "pe": F.coalesce(ratio(F.col("cross"), F.col("all") * F.col("all")), F.lit(0.0))})
    kappas = both.withColumn("kappa", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))
    valid = F.count("kappa") >= 0.9 * replicates
    return kappas.agg(
        F.count("kappa").alias("valid"),
        F.when(valid, F.percentile("kappa", F.lit(0.025))).alias("kappa95_low"),
        F.when(valid, F.percentile("kappa", F.lit(0.975))).alias("kappa95_high"),
    )


#: Cells (pairs of categories that occur) that each task of the bootstrap holds at most.
MOST_CELLS = 1 << 20


def bootstrap_kappa_cells(raters: DataFrame, a: str, b: str, replicates: int = 2000, seed: str = "boot") -> DataFrame:
    """``bootstrap_kappa`` at the cost of replicates x cells: a resample is drawn as the counts of its cells.

    A resample of n rows is multinomial over the cells, drawn as conditional binomials, one for each
    cell, by a generator that seed and replicate start, so reruns agree. Replicates are spread over
    tasks; the cells, whose number is checked, go to each. Rows are only counted.
    """
    cells = complete_pairs(raters, a, b).groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")).orderBy("y_true", "y_pred").limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of categories occur")
    names = sorted({r["y_true"] for r in cells} | {r["y_pred"] for r in cells})
    place = {c: i for i, c in enumerate(names)}
    true, pred = (np.array([place[r[side]] for r in cells], np.int64) for side in ("y_true", "y_pred"))
    counts = np.array([r["n"] for r in cells], np.int64)

    def draw_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = int(counts.sum())
        for batch in batches:
            kappas = []
            for replicate in batch.column("id").to_pylist():
                word = hashlib.sha256(f"{seed}|{replicate}".encode()).digest()
                drawn = np.random.Generator(np.random.PCG64(int.from_bytes(word[:16], "big"))).multinomial(n, counts / n) if n else counts
                t, p = (np.bincount(side, drawn, len(names)) for side in (true, pred))
                agreed, chance = drawn[true == pred].sum() / max(n, 1), (t * p).sum() / max(n, 1) ** 2
                kappas.append((agreed - chance) / (1 - chance) if n and chance < 1 else None)
            yield pa.RecordBatch.from_arrays([pa.array(kappas, pa.float64())], ["kappa"])

    kappas = raters.sparkSession.range(1, replicates + 1).mapInArrow(draw_some, "kappa double")
    valid = F.count("kappa") >= 0.9 * replicates
    return kappas.agg(
        F.count("kappa").alias("valid"), F.when(valid, F.percentile("kappa", F.lit(0.025))).alias("kappa95_low"), F.when(valid, F.percentile("kappa", F.lit(0.975))).alias("kappa95_high")
    )


def perturbation_effect(original: DataFrame, changed: DataFrame) -> DataFrame:
    """Per fold: share of rows with other inputs, and the change of accuracy and log-loss.

    Both have sample_id, fold, y_true, y_pred, own_p (probability of the truth), inputs.
    """
    a = original.select("sample_id", "fold", "y_true", F.col("y_pred").alias("y0"), F.col("own_p").alias("p0"), F.col("inputs").alias("i0"))
    b = changed.select("sample_id", "fold", F.col("y_pred").alias("y1"), F.col("own_p").alias("p1"), F.col("inputs").alias("i1"))
    rows = a.join(b, ["sample_id", "fold"])
    hit = lambda c: F.avg((F.col("y_true") == F.col(c)).cast("double"))
    return rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), hit("y0").alias("original_accuracy"), (hit("y1") - hit("y0")).alias("delta_accuracy"),
        (F.avg(-F.ln("p1")) - F.avg(-F.ln("p0"))).alias("delta_log_loss"), F.avg((F.col("i0") != F.col("i1")).cast("double")).alias("changed"),
    )
