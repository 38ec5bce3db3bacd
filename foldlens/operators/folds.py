"""Stratified and grouped folds, their manifests and invariants.

Order comes from md5 of seed and id, so folds don't depend on partitions or on any random
generator. ``id_col`` is unique. Ranks within strata are taken in buckets of the digest, and
the global cyclic order needed for even folds adds the strata's offsets, so that no window
spans the table or a large stratum.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import hashed_rank, numbered, tasks_of
from ..shared_folder import durable


def seeded(seed: int | str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def stratified_folds(rows: DataFrame, id_col: str, label_col: str, k: int = 7, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, label, fold) and ``keep``: every id in one of k folds; labels and totals are spread within 1.

    One cyclic sequence runs through all labels: restarting it in each label would always
    favour the first folds.
    """
    slim = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), *keep)
    ranked = hashed_rank(slim, ["label"], seeded(seed, F.col("id")), "id", "place")
    sizes = slim.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    offsets = F.broadcast(offsets)  # one row a label
    placed = ranked.join(offsets, ranked["label"].eqNullSafe(offsets["label"])).drop(offsets["label"])
    return placed.select("id", "label", ((F.col("offset") + F.col("place") - 1) % k + 1).cast("int").alias("fold"), *keep)


def _largest_remainder(counts: DataFrame, keys: list[str], label: str, wanted: Column) -> DataFrame:
    """``counts`` (keys, label, size) with ``take``: shares of ``wanted`` per label, summing to it."""
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    share = counts.withColumns({"wanted": wanted, "total": F.sum("size").over(every)})
    share = share.withColumn("exact", F.col("wanted") * F.col("size") / F.col("total"))
    share = share.withColumns({"base": F.floor("exact").cast("long"), "rest": F.round(F.col("exact") - F.floor("exact"), 9)})
    left = F.col("wanted") - F.sum("base").over(every)
    rank = F.row_number().over(every.orderBy(F.col("rest").desc(), label))
    return share.withColumns({"left": left, "rank": rank}).withColumn("take", F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).select(*keys, label, "take")


#: The roles of a manifest.
ROLES = ("Test", "Train", "Val")
#: Hexadecimal digits that narrow down where validation ends: 4,096 buckets for each fold and label.
END_DIGITS = 3


def _ends(folds: DataFrame, takes: DataFrame, digest: Column, k: int) -> DataFrame:
    """(fold, label, last_digest, last_id): the last validation row of each fold and label, where there is one.

    Counts of buckets of the digest tell which bucket it is in, and only that bucket's rows are ranked.
    """
    runs = folds.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    rest = runs.filter("own <> fold").select("fold", "label", "id", digest.alias("last_digest")).withColumn("bucket", F.substring("last_digest", 1, END_DIGITS))
    counts = rest.groupBy("fold", "label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("fold", "label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    at = upto.join(F.broadcast(takes), ["fold", "label"]).filter("upto >= take and upto - n < take").select("fold", "label", "bucket", (F.col("take") - F.col("upto") + F.col("n")).alias("left"))
    place = F.row_number().over(Window.partitionBy("fold", "label").orderBy("last_digest", "id"))
    near = rest.join(F.broadcast(at), ["fold", "label", "bucket"]).withColumn("place", place)
    return near.filter(F.col("place") == F.col("left")).select("fold", "label", "last_digest", F.col("id").alias("last_id"))


def manifest(folds: DataFrame, k: int = 7, seed: int = 42, validation: float = 0.175, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, label, fold, role) and ``keep``: each id is Test in its fold and Val or Train in the others.

    Validation takes ceil(validation * remainder) rows, dealt over the labels by largest
    remainder: those with the least digests. A row's role follows from its own digest and the last
    one that is taken, so that rows are neither sorted nor moved. With ``keep`` rows are dealt by these
    columns before there are k of each, which serves a count by them.
    """
    folds = durable(folds)  # read four times
    own = folds.groupBy(F.col("fold").alias("own"), "label").agg(F.count(F.lit(1)).alias("n"))
    counts = own.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).filter("own <> fold").groupBy("fold", "label").agg(F.sum("n").alias("size"))
    wanted = F.ceil(F.round(F.sum("size").over(Window.partitionBy("fold")) * validation, 9)).cast("long")
    takes = _largest_remainder(counts, ["fold"], "label", wanted)
    ends = _ends(folds, takes, seeded_by_fold(seed), k)
    dealt = folds.repartition(*keep) if keep else folds
    runs = dealt.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    known = runs.filter("own = fold or label is not null").join(F.broadcast(ends), ["fold", "label"], "left")
    known = known.withColumn("digest", F.when(F.col("own") != F.col("fold"), seeded_by_fold(seed)))
    taken = F.expr("digest < last_digest or (digest = last_digest and id <= last_id)")
    role = F.when(F.col("own") == F.col("fold"), "Test").when(taken, "Val").otherwise("Train")
    return known.select("id", "label", "fold", role.alias("role"), *keep)


def seeded_by_fold(seed: int) -> Column:
    return F.md5(F.concat_ws("|", (F.lit(seed) + F.col("fold")).cast("string"), F.col("id").cast("string")))


def fold_counts(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.groupBy("fold", "role", "label").agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(rows: DataFrame, id_col: str, label_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (id, label), shares by label, chosen in seeded order."""
    slim = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    counts = slim.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    takes = _largest_remainder(counts, [], "label", F.lit(n))
    ranked = hashed_rank(slim, ["label"], seeded(seed, F.col("id")), "id", "place")
    return ranked.join(F.broadcast(takes), "label").filter("place <= take").select("id", "label")


def _shapes(rows: DataFrame, tasks: int, *sets: str) -> DataFrame:
    """(cluster, shape) and ``sets``: the counts of every label of each cluster of ``rows`` (label, cluster), and its distinct values of ``sets``.

    Rows are dealt by cluster once, for both counts.
    """
    held = rows.filter("cluster is not null").repartition(tasks, "cluster")
    per = held.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), *[F.collect_set(c).alias(c) for c in sets])
    every = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in sets]
    return per.groupBy("cluster").agg(F.to_json(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("shape"), *every)


#: Distinct vectors of counts that the greedy pass of a part gets at most.
GREEDY = 20_000
#: Hexadecimal digits of the buckets in which equal clusters are ranked: 4,096 for each vector.
RANK_DIGITS = 3


def _rounds(sizes: DataFrame, parts: list[str], k: int) -> tuple[DataFrame, DataFrame, dict]:
    """(the smallest ``GREEDY`` vectors of each part, the deal of the others, what that gives each fold by label).

    Clusters that equal ones don't even out are sorted by their commonest label and size, and
    each k neighbours in that order go to k folds, forwards and backwards by turns, so that a
    fold's sums differ by about one cluster for each label. Sorting and dealing are spread over tasks.
    """
    vector = F.from_json("shape", "array<struct<label:string,n:bigint>>")
    told = sizes.withColumn("vector", vector).withColumn("total", F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    told = told.withColumn("main", F.array_max(F.transform("vector", lambda x: F.struct(x["n"], x["label"])))["label"])
    in_part = [F.col(p) for p in parts]
    first = lambda df: df.groupBy(*parts).agg(F.min("place").alias("first")).toDF(*[f"__{p}" for p in parts], "first")

    def placed(df: DataFrame, order: list[Column]) -> DataFrame:
        """``df`` with place 0, 1, ... within each part."""
        rows = numbered(df, [*in_part, *order], "place")
        if not parts:
            return rows.withColumn("place", F.col("place") - 1)
        same = reduce(Column.__and__, [F.col(p).eqNullSafe(F.col(f"__{p}")) for p in parts])
        return rows.join(first(rows), same).withColumn("place", F.col("place") - F.col("first")).drop("first", *[f"__{p}" for p in parts])

    by_size = durable(placed(told, [F.col("total"), F.col("shape")]))
    small, large = by_size.filter(F.col("place") < GREEDY).select(*sizes.columns), by_size.filter(F.col("place") >= GREEDY).drop("place")
    left = (F.col("clusters") % k).cast("int")
    units = large.filter(left > 0).select(*parts, "shape", "vector", "main", "total", F.explode(F.sequence(F.lit(1), left)).alias("unit"))
    turn, at = F.expr(f"place div {k}"), (F.col("place") % k).cast("int")
    units = placed(units, [F.col("main"), F.col("total").desc(), F.col("shape"), F.col("unit")]).withColumn("__to", F.when(turn % 2 == 0, at + 1).otherwise(k - at))
    units = durable(units)
    given = units.select(*parts, "__to", F.explode("vector").alias("v")).groupBy(*parts, "__to", "v.label").agg(F.sum("v.n").alias("n"))
    begun: dict = {}
    for r in given.collect():  # parts x folds x labels
        begun.setdefault(tuple(r[p] for p in parts), {})[r["__to"], r["label"]] = r["n"]
    rest = units.groupBy(*parts, "shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "__to"))), lambda x: x["__to"]).alias("rest"))  # k at most
    dealt = large.select(*parts, "shape", (F.col("clusters") - left).alias("even")).join(rest, [*parts, "shape"], "left")
    return small, dealt.withColumn("many", F.lit(k)), begun


def _deal(shapes: DataFrame, parts: list[str], k: int, digest: Column, tasks: int) -> DataFrame:
    """(parts, cluster, dealt): each part's clusters dealt to 1 ... k, or to as many as it has clusters, by ``tasks`` tasks.

    Clusters with equal counts of every label are interchangeable. Of m such clusters, in
    seeded order, m - m % k are dealt in turn, as many to each fold. The other m % k go
    through a greedy pass, the least even counts first, each to the fold that keeps the
    labels' spread smallest. That pass is sequential and one task for each part, which gets a
    row for each distinct vector of counts, whatever the number of clusters, and ``GREEDY`` rows
    at most: where there are more distinct vectors, only the smallest clusters go through it,
    and it evens out what the larger ones, dealt by ``_rounds``, have left uneven.
    """
    sizes = shapes.groupBy(*parts, "shape").agg(F.count(F.lit(1)).alias("clusters"))
    dealt_large, begun = None, {}
    most = sizes.groupBy(*parts).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > GREEDY:
        sizes, dealt_large, begun = _rounds(sizes, parts, k)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        start = begun.get(tuple(pdf[p].iloc[0] for p in parts), {})
        pdf = pdf.sort_values("shape", ignore_index=True)
        many = min(k, int(pdf["clusters"].sum()))
        vectors = [{c.get("label"): c["n"] for c in json.loads(shape)} for shape in pdf["shape"]]
        labels = sorted({label for vector in vectors for label in vector} | {label for _, label in start}, key=lambda x: (x is None, x or ""))
        counts = np.array([[vector.get(label, 0) for label in labels] for vector in vectors], float)
        held = np.array([[start.get((f + 1, label), 0) for label in labels] for f in range(many)], float)
        weights = counts / ((counts * pdf["clusters"].to_numpy(float)[:, None]).sum(axis=0) + held.sum(axis=0)) ** 2
        spread, out = counts.std(axis=1), [[] for _ in vectors]
        for i in sorted(range(len(vectors)), key=lambda i: (-spread[i], -counts[i].sum(), i)):
            for _ in range(int(pdf["clusters"][i]) % many):
                # the sum of squares over all folds grows least where this product is least
                added, full = held @ weights[i], held.sum(axis=1)
                best = min(range(many), key=lambda f: (added[f], full[f], f))
                held[best] += counts[i]
                out[i].append(best + 1)
        return pdf[[*parts, "shape"]].assign(even=pdf["clusters"] // many * many, rest=out, many=many, kind=np.arange(len(pdf)))

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in shapes.schema.fields if f.name in parts)
    dealt = sizes.withColumn("one", F.lit(1)).groupBy("one", *parts).applyInPandas(greedy, f"{kinds}shape string, even long, rest array<int>, many int, kind long")
    if dealt_large is None:  # GREEDY rows a part: clusters are ranked by the number of their vector, and none moves to meet it
        dealt = durable(dealt)  # read twice
        marked = shapes.join(F.broadcast(dealt.select(*parts, "shape", "kind")), [*parts, "shape"]).select(*parts, "kind", "cluster")
        dealt = F.broadcast(dealt.drop("shape"))
    else:
        dealt = dealt.drop("kind").unionByName(dealt_large).withColumnRenamed("shape", "kind")
        marked = shapes.select(*parts, F.col("shape").alias("kind"), "cluster")
    ranked = hashed_rank(marked, [*parts, "kind"], digest, "cluster", "place", RANK_DIGITS, tasks).join(dealt, [*parts, "kind"])
    in_turn = ((F.col("place") - 1) % F.col("many") + 1).cast("int")
    fold = F.when(F.col("place") <= F.col("even"), in_turn).otherwise(F.get("rest", (F.col("place") - F.col("even") - 1).cast("int")))
    return ranked.select(*parts, "cluster", fold.alias("dealt"))


def grouped_folds(rows: DataFrame, id_col: str, label_col: str, cluster_col: str, k: int = 7, seed: int = 42) -> DataFrame:
    """(id, label, cluster, fold): clusters stay together, labels are spread evenly.

    A null label is a label; rows without cluster are in no fold.
    """
    slim = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(cluster_col).alias("cluster"))
    tasks = tasks_of(slim.count())
    shapes = durable(_shapes(slim, tasks))  # read three times
    dealt = durable(_deal(shapes, [], k, seeded(seed, F.col("cluster")), tasks_of(shapes.count())))  # read with every use of the folds
    whole = slim.repartition(tasks, "cluster").join(dealt.withColumnRenamed("dealt", "fold").repartition(tasks, "cluster"), "cluster")
    return whole.select("id", "label", "cluster", "fold")


def grouped_manifest(own: DataFrame, k: int = 7, inner: int = 6, seed: int = 42) -> DataFrame:
    """(id, label, cluster, fold, role) of grouped folds ``own``.

    What is not a fold's test is split anew for each fold, by seed + fold, into ``inner``
    parts that keep clusters together; the first of them is the fold's validation.
    """
    tasks = tasks_of(own.count())
    shapes = durable(_shapes(own.select("label", "cluster", F.col("fold").alias("owns")), tasks, "owns"))  # read three times
    runs = shapes.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).filter(F.exists("owns", lambda f: f != F.col("fold")))
    digest = F.md5(F.concat_ws("|", (F.lit(seed) + F.col("fold")).cast("string"), F.col("cluster").cast("string")))
    dealt = _deal(runs.select("fold", "cluster", "shape"), ["fold"], inner, digest, tasks_of(k * shapes.count()))
    # a row for each cluster, and all folds of a line made where it is
    chosen = dealt.repartition(tasks, "cluster").groupBy("cluster").agg(*[F.max(F.when(F.col("fold") == f, F.col("dealt") == 1)).alias(f"v{f}") for f in range(1, k + 1)])
    role = lambda f: F.when(F.col("own") == f, "Test").when(F.col(f"v{f}"), "Val").when(~F.col(f"v{f}"), "Train")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), role(f).alias("role")) for f in range(1, k + 1)]))
    rows = own.withColumnRenamed("fold", "own").repartition(tasks, "cluster").join(chosen, "cluster", "left").select("id", "label", "cluster", each.alias("__run"))
    return rows.select("id", "label", "cluster", "__run.fold", "__run.role").filter("role is not null")


def role_violations(manifest_rows: DataFrame, roles: tuple[str, ...] | None = None) -> DataFrame:
    """(cluster, fold, roles, n) of clusters that stand in more than one role of a fold.

    Where the ``roles`` that occur are known, such as ``ROLES``, a flag for each is all that is held of a
    cluster, and another role is an error; otherwise sets of them are gathered.
    """
    if roles is None:
        found, n = F.array_join(F.array_sort(F.collect_set("role")), "|"), F.count(F.lit(1))
        return manifest_rows.groupBy("cluster", "fold").agg(found.alias("roles"), n.alias("n")).filter(F.instr("roles", "|") > 0)
    place = F.coalesce(*[F.when(F.col("role") == r, F.lit(1 << i)) for i, r in enumerate(sorted(roles))], F.when(F.col("role").isNotNull(), F.raise_error(F.concat(F.lit("unknown role "), "role")).cast("int")))
    held = manifest_rows.select("cluster", "fold", place.alias("place")).groupBy("cluster", "fold").agg(F.bit_or("place").alias("held"), F.count(F.lit(1)).alias("n"))
    names = F.concat_ws("|", *[F.when(F.col("held").bitwiseAND(1 << i) > 0, r) for i, r in enumerate(sorted(roles))])
    return held.filter(F.bit_count("held") > 1).select("cluster", "fold", names.alias("roles"), "n")


def missing_training_classes(manifest_rows: DataFrame) -> DataFrame:
    """(fold, label) of labels that a fold's training rows lack."""
    every = manifest_rows.select("fold").distinct().join(F.broadcast(manifest_rows.select("label").distinct()))
    return every.join(manifest_rows.filter("role = 'Train'").select("fold", "label").distinct(), ["fold", "label"], "left_anti")


def held_out_once_violations(ids: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """(id, tests) of ids that are Test in no fold or in several."""
    tests = manifest_rows.filter("role = 'Test'").groupBy("id").agg(F.count(F.lit(1)).alias("tests"))
    return ids.join(tests, "id", "left").select("id", F.coalesce("tests", F.lit(0)).alias("tests")).filter("tests <> 1")


def count_fingerprint(left: DataFrame, right: DataFrame, axes: list[str]) -> DataFrame:
    """(fold, attribute, group, n_left, n_right) wherever group counts per fold differ."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in axes]))
        return df.select("fold", pairs.alias("p")).groupBy("fold", "p.attribute", "p.group").agg(F.count(F.lit(1)).alias(name))

    both = counts(left, "n_left").join(counts(right, "n_right"), ["fold", "attribute", "group"], "full")
    return both.na.fill(0, ["n_left", "n_right"]).filter("n_left <> n_right")
