"""Counts and summaries of metadata: crosstabs, accounting, profiles, nested counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import wilson
from ..shared_folder import durable


def crosstabs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(left, right, a, b, n) for each pair of columns in one pass; absent cells count 0."""
    values = F.explode(F.array(*[F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b")) for x, y in pairs]))
    counted = df.select(values.alias("v")).select("v.*").groupBy("left", "right", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    rows, columns = counted.select("left", "right", "a").distinct(), counted.select("left", "right", "b").distinct()
    grid = rows.join(columns, ["left", "right"]).withColumnsRenamed({"left": "gl", "right": "gr", "a": "ga", "b": "gb"})
    on = [F.col(x).eqNullSafe(F.col(y)) for x, y in (("left", "gl"), ("right", "gr"), ("a", "ga"), ("b", "gb"))]
    joined = grid.join(counted, on[0] & on[1] & on[2] & on[3], "left")
    return joined.select(F.col("gl").alias("left"), F.col("gr").alias("right"), F.col("ga").alias("a"), F.col("gb").alias("b"), F.coalesce("n", F.lit(0)).alias("n"))


#: Parts that a pass of ``exact_medians`` cuts a range into, and values that are sorted at the end.
PARTS, SORTED = 4096, 10_000


def exact_medians(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, count, median, min, max) of the finite values ``x`` of each group.

    No aggregator holds a group's values. A pass counts the values of the range that has the
    wanted rank in ``PARTS`` parts of it and goes on with the part that has the rank, until that
    part is one value or has ``SORTED`` values at most, which are sorted. Ranges are joined to the
    rows by group. Two or three passes do for smooth data; each pass divides a range by ``PARTS``.
    """
    rows = long.filter(F.col("x").isNotNull() & (F.abs("x") < float("inf"))).select(*keys, "x")
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("x").alias("min"), F.max("x").alias("max"))
    totals = durable(totals)
    middle = F.explode(F.array(F.expr("(count - 1) div 2"), F.expr("count div 2")))  # the same for an odd count
    wanted = totals.select(*keys, F.col("min").alias("lo"), F.col("max").alias("hi"), F.col("count").alias("n"), middle.alias("rank")).distinct()
    wanted = wanted.withColumn("place", F.col("rank"))
    while True:
        wanted = durable(wanted)
        if wanted.filter((F.col("n") > SORTED) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        open_ = wanted.filter((F.col("n") > SORTED) & (F.col("lo") < F.col("hi")))
        inside = _within(rows, open_, keys)
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves can't overflow
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1))
        counted = inside.groupBy(*keys, "place", "rank", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = Window.partitionBy(*keys, "place").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # PARTS rows at most
        ranked = counted.withColumn("end", F.sum("n").over(upto)).withColumn("begin", F.col("end") - F.col("n"))
        narrowed = ranked.filter((F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("end"))).withColumn("rank", F.col("rank") - F.col("begin"))
        closed = wanted.filter((F.col("n") <= SORTED) | (F.col("lo") >= F.col("hi")))
        wanted = closed.unionByName(narrowed.select(*wanted.columns))
    found = wanted.filter("lo >= hi").select(*keys, "place", F.col("lo").alias("value"))
    rest = _within(rows, wanted.filter("lo < hi"), keys).groupBy(*keys, "place", "rank").agg(F.array_sort(F.collect_list("x")).alias("values"))  # SORTED values at most
    found = found.unionByName(rest.select(*keys, "place", F.element_at("values", (F.col("rank") + 1).cast("int")).alias("value")))
    medians = found.groupBy(*keys).agg(F.avg("value").alias("median")).toDF(*[f"__{k}" for k in keys], "median")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return totals.join(medians, same).select(*keys, "count", "median", "min", "max")


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The rows inside of each group's ranges (place, rank, lo, hi)."""
    named = ranges.select(*[F.col(k).alias(f"__{k}") for k in keys], "place", "rank", "lo", "hi")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(named, same).filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).drop(*[f"__{k}" for k in keys])


def numeric_profile(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """count, exact median, min and max of each column by group, long form; NaN and infinities are missing, and all-missing columns have no row."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = df.select(group, values.alias("v")).select(group, "v.*")
    return exact_medians(long, [group, "column"])


def accounting(df: DataFrame, id_col: str, ok: str, axes: list[str]) -> DataFrame:
    """(stage, n): rows, readable and unreadable ones, unique ids and the values of each axis."""
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ok)).alias("good"), F.count_if(~F.col(ok)).alias("bad"), F.count_distinct(id_col).alias("unique")
    )
    stages = F.explode(F.array(*[F.struct(F.lit(t).alias("stage"), F.col(c).alias("n")) for t, c in (("rows", "rows"), ("decode success", "good"), ("decode failures", "bad"), ("unique ids", "unique"))]))
    values = F.explode(F.array(*[F.concat(F.lit(f"{a}: "), F.coalesce(F.col(a).cast("string"), F.lit("missing"))) for a in axes]))
    return totals.select(stages.alias("s")).select("s.*").unionByName(df.select(values.alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n")))


def observed_mapping(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """(attribute, raw_label, final_label, n): what each raw value became."""
    values = F.explode(F.array(*[F.struct(F.lit(final).alias("attribute"), F.col(raw).alias("raw_label"), F.col(final).alias("final_label")) for raw, final in pairs.items()]))
    return df.select(values.alias("v")).groupBy("v.attribute", "v.raw_label", "v.final_label").agg(F.count(F.lit(1)).alias("n"))


def metric_summary(folds: DataFrame, metrics: list[str], *keys: str) -> DataFrame:
    """Mean with sample and population deviation of each metric; both are in use, so both are given."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))
    long = folds.select(*keys, values.alias("v")).select(*keys, "v.*")
    return long.groupBy(*keys, "metric").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("sample_sd"), F.stddev_pop("x").alias("population_sd"), F.count("x").alias("n_folds")
    )


COUNTS_TYPE = "map<string,map<string,array<bigint>>>"


def parse_counts(df: DataFrame, column: str) -> DataFrame:
    """(... , attribute, group, correct, n, valid) of serialized nested counts.

    The cell is text like {'axis': {'group': (np.int64(2), np.int64(3))}}. It is never
    evaluated: number wrappers are stripped, only then quotes and brackets become JSON, and
    what doesn't parse gives one row with valid false and no attribute.
    """
    text = F.regexp_replace(F.col(column), r"np\.int(?:32|64)\((-?\d+)\)", "$1")
    shaped = F.rlike(text, F.lit(r"^\s*\{(?:[^'\"(){}]|'[^'\"\\]*'|\((?:\s*-?\d+\s*,\s*-?\d+\s*)\)|[{}])*\}\s*$"))
    json = F.translate(text, "'()", '"[]')
    parsed = df.withColumn("__counts", F.when(shaped, F.from_json(json, COUNTS_TYPE)))
    outer = parsed.select(*df.columns, F.explode_outer("__counts").alias("attribute", "__groups"))
    inner = outer.select(*df.columns, "attribute", F.explode_outer("__groups").alias("group", "__pair"))
    k, n = F.try_element_at("__pair", F.lit(1)), F.try_element_at("__pair", F.lit(2))
    valid = F.coalesce((F.size("__pair") == 2) & (k >= 0) & (k <= n) & (n >= 1), F.lit(False))
    return inner.select(*df.columns, "attribute", "group", k.alias("correct"), n.alias("n"), valid.alias("valid"))


def merge_counts(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts summed over folds, with accuracy and Wilson bounds."""
    pooled = counts.filter("valid").groupBy(*keys, "attribute", "group").agg(F.sum("correct").alias("correct"), F.sum("n").alias("n"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return pooled.withColumns({"accuracy": F.col("correct") / F.col("n"), "wilson95_low": low, "wilson95_high": high})


#: Distinct rows that a leaf of the digest tree has on average at most; its array is no longer than a few times that.
LEAF = 64


def tree_depth(distinct: int) -> int:
    """Hexadecimal digits of a row's hash that name its leaf: as many as ``LEAF`` rows a leaf need."""
    depth = 1
    while distinct > LEAF * 16**depth:
        depth += 1
    return depth


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): the root of a tree of SHA-256 digests, independent of the rows' order.

    A row's hash and the times it occurs are an entry of the leaf that its first digits name.
    A node's digest is that of its entries or of its children's digests in order, 16 at
    most, so no array is longer than a leaf; the tree is as deep as the table needs.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    entries = durable(df.select(row.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    depth = tree_depth(entries.count())
    part = F.concat("h", F.lit(":"), F.col("n").cast("string"))
    nodes = entries.select(F.substring("h", 1, depth).alias("prefix"), part.alias("part"), "n")
    for level in range(depth, -1, -1):
        joined = F.array_join(F.array_sort(F.collect_list("part")), ",")
        nodes = nodes.groupBy("prefix").agg(F.sha2(joined, 256).alias("digest"), F.sum("n").alias("n"))
        if level:
            nodes = nodes.select(F.substring("prefix", 1, level - 1).alias("prefix"), F.concat("prefix", F.lit(":"), "digest").alias("part"), "n")
    return nodes.select(F.col("n").alias("rows"), "digest")


def early_stopping(history: DataFrame, patience: int = 20) -> DataFrame:
    """(run, best_epoch, best_loss, stop_epoch): where training that waits ``patience`` epochs ends.

    Epochs count in their order, whatever their numbers. An epoch with less loss than all
    before it is the best so far; one without a loss (NULL, NaN) is none. The run stops at
    the first epoch that has ``patience`` epochs without a new best up to it, later ones don't
    count; a run that never waits so long stops at its last epoch. A run's epochs are sorted
    by one task (they are steps of one training, in sequence), and spill if need be.
    """
    order = Window.partitionBy("run").orderBy("epoch")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    loss = F.when(~F.isnan("loss"), F.col("loss"))
    rows = history.select("run", "epoch", loss.alias("loss"), F.row_number().over(order).alias("place"))
    least = F.min("loss").over(order.rowsBetween(Window.unboundedPreceding, -1))
    better = F.col("loss").isNotNull() & (F.col("least").isNull() | (F.col("loss") < F.col("least")))
    rows = rows.withColumn("least", least).withColumn("best", F.when(better, F.struct("place", "epoch", "loss")))
    rows = rows.withColumn("best", F.last("best", True).over(upto))
    waited = F.col("place") - F.coalesce(F.col("best.place"), F.lit(0)) >= patience
    stop = rows.groupBy("run").agg(F.min(F.when(waited, F.struct("place", "epoch", "best"))).alias("early"), F.max(F.struct("place", "epoch", "best")).alias("late"))
    ended = stop.select("run", F.coalesce("early", "late").alias("end"))
    return ended.select("run", F.col("end.best.epoch").alias("best_epoch"), F.col("end.best.loss").alias("best_loss"), F.col("end.epoch").alias("stop_epoch"))
