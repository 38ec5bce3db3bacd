"""Probes on frozen features: train-only encodings, centroids, logistic regression, controls."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import one_hot
from ..functions.ordering import hashed_rank
from ..shared_folder import durable
from .comparison import perturbation_effect

UNKNOWN = "<UNK>"


def train_values(rows: DataFrame, value: str) -> DataFrame:
    """(fold, value, code): the sorted distinct values of the training rows, coded 1, 2, ..., in table form.

    The unknown token is 0. A value that many rows hold is one row here, and codes come from a
    window over distinct values only.
    """
    seen = rows.filter("role = 'Train'").select("fold", F.col(value).cast("string").alias("value")).filter("value is not null").distinct()
    return seen.withColumn("code", F.row_number().over(Window.partitionBy("fold").orderBy("value")))


def train_vocabulary(rows: DataFrame, value: str) -> DataFrame:
    """(fold, vocabulary): the values of ``train_values`` as one array for each fold, the unknown token first.

    For one-hot vectors, which are as wide as the vocabulary anyway.
    """
    held = train_values(rows, value).groupBy("fold").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return held.select("fold", F.concat(F.array(F.lit(UNKNOWN)), "v").alias("vocabulary"))


def encode(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``code``: the place in the fold's vocabulary, 0 for values unseen in training.

    Rows meet their code by fold and value, so a vocabulary of any size will do; values that
    hold many rows are split by adaptive execution or broadcast where the table is small.
    """
    table = train_values(rows, value).select(F.col("fold").alias("__fold"), F.col("value").alias("__value"), F.col("code").alias("__code"))
    met = rows.join(table, (F.col("fold") == F.col("__fold")) & (F.col(value).cast("string") == F.col("__value")), "left")
    return met.withColumn("code", F.coalesce("__code", F.lit(0)).cast("int")).drop("__fold", "__value", "__code")


def standardized(rows: DataFrame, values: str, name: str = "z") -> DataFrame:
    """``rows`` with the array ``name``: ``values`` by the train mean and population deviation of their fold.

    A deviation of 0 counts as 1. Sums are combined before the shuffle, and what is broadcast is
    two arrays for each fold; vectors never leave their rows.
    """
    long = rows.filter("role = 'Train'").select("fold", F.posexplode(values).alias("dim", "x"))
    x = F.col("x").cast("double")
    stats = long.groupBy("fold", "dim").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    scale = F.when(F.round("sd", 12) == 0, 1.0).otherwise(F.col("sd"))
    per = F.array_sort(F.collect_list(F.struct("dim", "mean", scale.alias("scale"))))
    table = stats.groupBy("fold").agg(per.alias("__stats"))
    z = F.zip_with(values, "__stats", lambda v, s: (v.cast("double") - s["mean"]) / s["scale"])
    return rows.join(F.broadcast(table), "fold").withColumn(name, z).drop("__stats")


def standardize(rows: DataFrame, values: str) -> DataFrame:
    """(id, fold, role, dim, z): ``standardized`` in long form."""
    return standardized(rows, values).select("id", "fold", "role", F.posexplode("z").alias("dim", "z"))


def nearest_centroid(rows: DataFrame, values: str) -> DataFrame:
    """(id, fold, label, predicted): per fold the class of the nearest train-only centroid.

    Distances are rounded to 9 decimals and ties go to the smaller label, so that the order
    of summation doesn't matter. Centroids (folds x classes x dimensions) are broadcast.
    """
    long = rows.filter("role = 'Train'").select("fold", "label", F.posexplode(values).alias("dim", "x"))
    mean = long.groupBy("fold", "label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"])
    centres = mean.groupBy("fold", "label").agg(ordered.alias("centre")).groupBy("fold").agg(F.collect_list(F.struct(F.col("label").alias("c"), "centre")).alias("centres"))
    test = rows.filter("role = 'Test'").join(F.broadcast(centres), "fold")
    own = F.col(values)

    def far(centre):
        parts = F.zip_with(own, centre, lambda x, m: (x.cast("double") - m) * (x.cast("double") - m))
        return F.round(F.aggregate(parts, F.lit(0.0), lambda a, p: a + p), 9)

    best = F.array_min(F.transform("centres", lambda s: F.struct(far(s["centre"]).alias("d"), s["c"].alias("c"))))
    return test.select("id", "fold", "label", best["c"].alias("predicted"))


def logistic_oof(rows: DataFrame, values: str, c: float = 1.0, max_iter: int = 3000, parallel: int = 7) -> DataFrame:
    """(id, fold, label, predicted, p, iterations): out-of-fold multinomial logistic regression, L2 with strength c.

    Folds are few, so one distributed model is fitted for each, ``parallel`` of them at a time as
    an iteration is a short job, on ``values`` as they are. A fit
    that has not converged after ``max_iter`` iterations is an error, and so is a fold whose
    training rows lack a class.
    """
    data = rows.select("id", "fold", "role", array_to_vector(values).alias("features"), F.col("label").cast("double").alias("label")).cache()
    sizes = {r["fold"]: r for r in data.groupBy("fold").agg(F.count_if(F.col("role") == "Train").alias("n"), F.count_distinct(F.when(F.col("role") == "Train", F.col("label"))).alias("seen"), F.count_distinct("label").alias("all")).collect()}

    def fitted(fold: int) -> DataFrame:
        if sizes[fold]["seen"] < sizes[fold]["all"]:
            raise ValueError(f"fold {fold}: the training rows lack a class")
        own = data.filter(F.col("fold") == fold)
        # the penalty is on the mean loss, c on the sum
        model = LogisticRegression(family="multinomial", regParam=1.0 / (c * max(1, sizes[fold]["n"])), standardization=False, maxIter=max_iter).fit(own.filter("role = 'Train'"))
        if model.summary.totalIterations >= max_iter:
            raise ValueError(f"fold {fold}: the probe has not converged after {max_iter} iterations")
        scored = model.transform(own.filter("role = 'Test'"))
        return scored.select("id", "fold", F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("predicted"), vector_to_array("probability").alias("p"), F.lit(model.summary.totalIterations).alias("iterations"))

    with ThreadPoolExecutor(parallel) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(fitted), sorted(sizes)))


#: The three inputs of a probe: (name, with images, with metadata).
BLOCKS = (("image_only", True, False), ("metadata_only", False, True), ("concat", True, True))


def sparse_blocks(rows: DataFrame, image: str, metadata: list[str]) -> DataFrame:
    """(id, fold, role, label, image, ones, width): ``feature_blocks`` without dense one-hot vectors.

    ``ones`` has the places of the ones among ``width`` metadata features of the fold; a value unseen
    in training has none. Codes meet the rows by a join, so a vocabulary of any size will do.
    """
    out = standardized(rows, image, "image").select("id", "fold", "role", "label", "image", *metadata)
    before, ones = F.lit(0), []
    for i, name in enumerate(metadata):
        sizes = train_values(rows, name).groupBy("fold").agg((F.count(F.lit(1)) + 1).cast("int").alias(f"__n{i}"))  # a row a fold
        out = encode(out, name).withColumnRenamed("code", f"__c{i}").join(sizes, "fold", "left").withColumn(f"__n{i}", F.coalesce(f"__n{i}", F.lit(1)))
        ones.append(F.when(F.col(f"__c{i}") > 0, before + F.col(f"__c{i}")))
        before = before + F.col(f"__n{i}")
    places = F.array_compact(F.array(*ones)) if ones else F.array().cast("array<int>")
    return out.select("id", "fold", "role", "label", "image", places.alias("ones"), before.alias("width"))


class _Descent:
    """L-BFGS of one model, which is told loss and gradient at ``point`` from outside, one pass at a time."""

    def __init__(self, size: int, tolerance: float, memory: int = 10):
        self.point, self.tolerance, self.memory = np.zeros(size), tolerance, memory
        self.steps, self.best, self.iterations, self.done = [], None, 0, False

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        """Accept the point if the loss has fallen enough, else try a shorter step; then propose the next point."""
        if self.best is not None:
            at, was, old = self.best
            if loss > was + 1e-4 * self.rate * (old @ self.way) and self.rate > 1e-12:
                self.rate /= 2
                self.point = at + self.rate * self.way
                return
            s, y = self.point - at, gradient - old
            if s @ y > 1e-12 * (y @ y):
                self.steps = [*self.steps, (s, y)][-self.memory :]
            self.iterations += 1
        self.best = (self.point, loss, gradient)
        self.done = np.abs(gradient).max() <= self.tolerance
        if self.done:
            return
        way, kept = -gradient, []
        for s, y in reversed(self.steps):
            share = (s @ way) / (s @ y)
            way = way - share * y
            kept.append(share)
        if self.steps:
            s, y = self.steps[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), share in zip(self.steps, reversed(kept), strict=True):
            way = way + (share - (y @ way) / (s @ y)) * s
        self.way, self.rate = way, 1.0 if self.steps else min(1.0, 1 / np.abs(gradient).max())
        self.point = self.point + self.rate * way


def _design(batch: pa.RecordBatch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Images of the rows ``at``, and the places of their ones with the rows that have them."""
    image = batch.column("image").take(pa.array(at))
    ones = batch.column("ones").take(pa.array(at))
    dense = image.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
    return dense, ones.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(at)), np.diff(ones.offsets.to_numpy()))


def _scores(weights: np.ndarray, dense: np.ndarray, place: np.ndarray, row: np.ndarray, with_image: bool, with_ones: bool) -> np.ndarray:
    """Logits of ``weights`` (classes, intercept + features)."""
    out = np.repeat(weights[:, :1].T, len(dense), axis=0)
    if with_image:
        out += dense @ weights[:, 1 : 1 + dense.shape[1]].T
    if with_ones:
        np.add.at(out, row, weights[:, 1 + (dense.shape[1] if with_image else 0) + place].T)
    return out


def logistic_joint(rows: DataFrame, blocks: tuple = BLOCKS, c: float = 1.0, tolerance: float = 1e-6, max_passes: int = 3000) -> DataFrame:
    """(block, id, fold, label, predicted, p, iterations, n_features): out-of-fold multinomial logistic regressions of all folds and blocks at once.

    ``rows`` are ``sparse_blocks``. The models (folds x blocks) descend side by side: one pass over
    the training rows gives loss and gradient of every model that isn't done, summed in tasks
    and then by a shuffle, so that the passes are as many as the slowest model needs and not
    the sum over models. What the driver holds is the models. A model is done when no part of
    the gradient of its mean loss exceeds ``tolerance``; one that isn't after ``max_passes``
    is an error, and so is a fold whose training rows lack a class.
    """
    rows = durable(rows.withColumns({"fold": F.col("fold").cast("int"), "label": F.col("label").cast("long")}))
    known = rows.groupBy("fold", "label").agg(F.count_if(F.col("role") == "Train").alias("n"), F.max("width").alias("width"), F.max(F.size("image")).alias("dims")).collect()
    classes = sorted({r["label"] for r in known})
    folds = {f: [r for r in known if r["fold"] == f] for f in sorted({r["fold"] for r in known})}
    for fold, parts in folds.items():
        if len([r for r in parts if r["n"]]) < len(classes):
            raise ValueError(f"fold {fold}: the training rows lack a class")
    sizes = {f: sum(r["n"] for r in parts) for f, parts in folds.items()}
    shape = {(f, b): (len(classes), 1 + with_image * parts[0]["dims"] + with_ones * parts[0]["width"]) for f, parts in folds.items() for b, (_, with_image, with_ones) in enumerate(blocks)}
    models = {m: _Descent(k * d, tolerance) for m, (k, d) in shape.items()}
    train = rows.filter("role = 'Train'").select("fold", "label", "image", "ones")

    def one_pass(points: dict) -> dict:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {}
            for batch in batches:
                fold, label = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("fold", "label"))
                for f in np.unique(fold).tolist():
                    at = np.flatnonzero(fold == f)
                    dense, place, row = _design(batch, at)
                    truth = np.searchsorted(classes, label[at])
                    for b, (_, with_image, with_ones) in enumerate(blocks):
                        if (f, b) not in points:
                            continue
                        logits = _scores(points[f, b], dense, place, row, with_image, with_ones)
                        logits -= logits.max(1, keepdims=True)
                        norm = np.log(np.exp(logits).sum(1))
                        loss = float((norm - logits[np.arange(len(at)), truth]).sum())
                        off = np.exp(logits - norm[:, None])
                        off[np.arange(len(at)), truth] -= 1
                        g = np.zeros(shape[f, b])
                        g[:, 0] = off.sum(0)
                        if with_image:
                            g[:, 1 : 1 + dense.shape[1]] = off.T @ dense
                        if with_ones:
                            np.add.at(g.T, 1 + (dense.shape[1] if with_image else 0) + place, off[row])
                        was = total.get((f, b), (0.0, 0.0))
                        total[f, b] = (was[0] + loss, was[1] + g)
            for (f, b), (loss, g) in total.items():
                n = g.size + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * n, pa.int32()), pa.array([b] * n, pa.int32()), pa.array(range(-1, n - 1), pa.int32()), pa.array(np.concatenate([[loss], g.ravel()]))], ["fold", "block", "place", "value"]
                )

        found = train.mapInArrow(sums, "fold int, block int, place int, value double").groupBy("fold", "block", "place").agg(F.sum("value").alias("value")).toArrow()
        fold, block, place, value = (found[n].to_numpy() for n in ("fold", "block", "place", "value"))
        out = {}
        for f, b in points:
            mine = (fold == f) & (block == b)
            held = np.zeros(shape[f, b][0] * shape[f, b][1] + 1)
            held[place[mine] + 1] = value[mine]
            out[f, b] = held
        return out

    for _ in range(max_passes):
        going = [m for m, d in models.items() if not d.done]
        if not going:
            break
        points = {m: models[m].point.reshape(shape[m]) for m in going}
        for m, held in one_pass(points).items():
            n = sizes[m[0]]
            free = points[m].copy()
            free[:, 0] = 0  # the intercept has no penalty
            models[m].tell(held[0] / n + (free**2).sum() / (2 * c * n), held[1:] / n + free.ravel() / (c * n))
    if late := [m for m, d in models.items() if not d.done]:
        raise ValueError(f"fold {late[0][0]}: the probe has not converged after {max_passes} passes")
    fitted = {m: (d.best[0].reshape(shape[m]), d.iterations) for m, d in models.items()}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(fold).tolist():
                at = np.flatnonzero(fold == f)
                dense, place, row = _design(batch, at)
                kept = [batch.column(n).take(pa.array(at)) for n in ("id", "fold", "label")]
                for b, (name, with_image, with_ones) in enumerate(blocks):
                    weights, iterations = fitted[f, b]
                    logits = _scores(weights, dense, place, row, with_image, with_ones)
                    p = np.exp(logits - logits.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    guess = np.array(classes)[p.argmax(1)]
                    more = [pa.array(guess.astype(np.int64)), pa.array(list(p), pa.list_(pa.float64())), *(pa.array([v] * len(at), pa.int32()) for v in (iterations, weights.shape[1] - 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), *kept, *more], ["block", "id", "fold", "label", "predicted", "p", "iterations", "n_features"])

    test = rows.filter("role = 'Test'").select("id", "fold", "label", "image", "ones")
    kind = dict(test.dtypes)["id"]
    return test.mapInArrow(predict, f"block string, id {kind}, fold int, label long, predicted long, p array<double>, iterations int, n_features int")


def joint_fold_log(predicted: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, fold, n_train, n_test, n_features, accuracy, iterations) of ``logistic_joint``."""
    hit = F.avg((F.col("label") == F.col("predicted")).cast("double"))
    tested = predicted.groupBy("block", "fold").agg(F.count(F.lit(1)).alias("n_test"), F.max("n_features").alias("n_features"), hit.alias("accuracy"), F.max("iterations").alias("iterations"))
    trained = blocks.groupBy("fold").agg(F.count_if(F.col("role") == "Train").alias("n_train"))
    return tested.join(trained, "fold").select("block", "fold", "n_train", "n_test", "n_features", "accuracy", "iterations")


def permuted(rows: DataFrame, columns: list[str], mode: str, seed: str = "perm") -> DataFrame:
    """``rows`` (id, fold, columns) with columns shuffled within each fold.

    'joint' moves whole tuples, 'independent' each column by its own order. A permutation is
    a join of ranks in one hashed order with ranks in another.
    """
    if mode not in ("joint", "independent"):
        raise ValueError("mode is 'joint' or 'independent'")
    rank = lambda df, name: hashed_rank(df, ["fold"], F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), F.col("id").cast("string"))), "id", "place")
    base = rank(rows.select("id", "fold"), "base")
    for name, part in [("tuple", columns)] if mode == "joint" else [(c, [c]) for c in columns]:
        base = base.join(rank(rows.select("id", "fold", *part), name).drop("id"), ["fold", "place"])
    return base.select("id", "fold", *columns)


def permutation_effects(rows: DataFrame, columns: list[str], predict: Callable[[DataFrame], DataFrame], repeats: int = 20, seed: str = "perm") -> DataFrame:
    """(condition, repeat, fold, n, original_accuracy, permuted_accuracy, delta_accuracy, delta_log_loss, changed).

    ``predict`` turns ``rows`` (id, fold, columns and what else it needs) into predictions
    (sample_id, fold, y_true, y_pred, own_p, inputs). Each repeat permutes ``columns`` within folds, by whole tuples and
    column by column, with hashed orders of its own; what isn't permuted stays with its id.
    """
    rest = rows.select("id", "fold", *[c for c in rows.columns if c not in ("id", "fold", *columns)])
    original, out = predict(rows), []
    for repeat in range(repeats):
        for mode, condition in (("joint", "joint_tuple"), ("independent", "independent_columns")):
            moved = permuted(rows.select("id", "fold", *columns), columns, mode, f"{seed}|{repeat}").join(rest, ["id", "fold"])
            effect = perturbation_effect(original, predict(moved))
            out.append(effect.select(F.lit(condition).alias("condition"), F.lit(repeat).alias("repeat"), "*", (F.col("original_accuracy") + F.col("delta_accuracy")).alias("permuted_accuracy")))
    return reduce(DataFrame.unionByName, out)


def feature_blocks(rows: DataFrame, image: str, metadata: list[str]) -> DataFrame:
    """``rows`` with the three inputs of a probe: image_only, metadata_only and concat.

    Images are standardized by each fold's training rows. Metadata is one-hot by each fold's
    training vocabulary and isn't scaled; values unseen there are all zero.
    """
    out = standardized(rows, image, "image_only")
    for name in metadata:
        table = train_vocabulary(rows, name).withColumnRenamed("vocabulary", f"__{name}")
        out = out.join(table, "fold")
    hot = F.concat(*[one_hot(F.col(name).cast("string"), F.col(f"__{name}")) for name in metadata])
    return out.withColumn("metadata_only", hot).withColumn("concat", F.concat("image_only", "metadata_only")).drop(*[f"__{name}" for name in metadata])


def randomized_training(rows: DataFrame, metadata: list[str], mode: str, seed: str) -> DataFrame:
    """``rows`` (id, fold, role, metadata) with the training rows' metadata permuted within each fold; test rows stay."""
    train = permuted(rows.filter("role = 'Train'").select("id", "fold", *metadata), metadata, mode, seed)
    rest = [c for c in rows.columns if c not in metadata]
    moved = rows.filter("role = 'Train'").select(*rest).join(train, ["id", "fold"])
    return rows.filter("role <> 'Train'").unionByName(moved.select(*rows.columns))


def fold_log(predicted: DataFrame, blocks: DataFrame, values: str) -> DataFrame:
    """(fold, n_train, n_test, n_features, accuracy, iterations) of out-of-fold predictions on ``blocks``."""
    hit = F.avg((F.col("label") == F.col("predicted")).cast("double"))
    tested = predicted.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), hit.alias("accuracy"), F.max("iterations").alias("iterations"))
    trained = blocks.filter("role = 'Train'").groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"), F.max(F.size(values)).alias("n_features"))
    return trained.join(tested, "fold").select("fold", "n_train", "n_test", "n_features", "accuracy", "iterations")
