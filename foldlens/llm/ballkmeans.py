"""Centroid clustering: Ball k-means over integer vectors, exact.

A cluster is a ball: its centroid and a radius that no member exceeds. Centroid j is a
neighbour of i if it is at most two radii of i away; no member of i can be as near to any
other. A member at distance s of centroid i needs only the neighbours at most 2s away: members
within half the distance of the nearest neighbour are the stable core and are compared with
nothing, the others lie in annuli, of which the n-th is compared with the n nearest neighbours.
A ball whose centroid and neighbours have not moved is not looked at at all.

All distances are squared and whole numbers, so the comparisons are exact (2s is tested as
4 s^2 >= d^2, radii are roots rounded up) and equal distances keep the smaller number.

A round is one pass over a table in the shared folder, which adds each vector's cluster and
distance, and one aggregate of k rows, from which the driver makes the centroids. The driver
holds k centroids; k times dimensions is bounded by ``MAX_NUMBERS``. A lost executor costs the
tasks of one pass. The table of the round before goes when the next one is written.

Defined results: rows whose vector is null, has another number of components or one that is
null, NaN or infinite are left out; repeated rows are vectors of their own; rows without id
never start a centroid while others can; of equal ids the smaller vector comes first; fewer
vectors than centroids give as many centroids as vectors; an empty table gives no rows; other
columns are not returned. Scaled components so large that squared distances may not fit a long
are an error (beyond +-1.8 x 10^8 in 64 dimensions).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, need

#: Centroids times dimensions that the driver and every task hold at most.
MAX_NUMBERS = 1 << 24


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v) of usable vectors: v has the floor of ``scale`` times each component."""
    need(rows, id_col, vector_col)
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = rows.select(F.col(id_col).alias("vec_id"), x.alias("x")).filter((F.size("x") == dimensions) & finite)
    most = isqrt((1 << 63) // dimensions - 1) // 2
    return good.select("vec_id", F.transform("x", lambda e: _checked(e * scale, most)).alias("v"))


def _checked(x: Column, most: int) -> Column:
    error = F.raise_error(F.lit(f"a component is beyond +-{most} after scaling")).cast("long")
    return F.when(F.abs(x) < most, F.floor(x)).otherwise(error).cast("long")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def root_up(square: int) -> int:
    """The smallest whole number whose square is at least ``square``."""
    r = isqrt(square)
    return r if r * r == square else r + 1


class Balls:
    """The centroids of a round, each ball's neighbours by distance, and which balls rest."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None, farthest: dict[int, int] | None = None):
        self.centroids = centroids
        k = len(centroids)
        self.first = before is None
        if self.first:
            return
        moved = ((centroids - before) ** 2).sum(1)
        self.neighbours, self.resting = [], np.zeros(k, bool)
        for i in range(k):
            gaps = ((centroids - centroids[i]) ** 2).sum(1)
            radius = root_up(farthest.get(i, 0)) + root_up(int(moved[i]))
            near = np.flatnonzero((gaps <= 4 * radius * radius) & (np.arange(k) != i))
            near = near[np.argsort(gaps[near], kind="stable")]
            self.neighbours.append((near, gaps[near]))
            self.resting[i] = moved[i] == 0 and not moved[near].any()

    def assign(self, v: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each row of ``v``, given those of the round before."""
        best, least = cluster.copy(), distance.copy()
        if self.first:
            best[:], least[:] = 0, ((v - self.centroids[0]) ** 2).sum(1)
            for j in range(1, len(self.centroids)):
                _challenge(v, np.arange(len(v)), j, self.centroids[j], best, least)
            return best, least
        for i in np.unique(cluster):
            if self.resting[i]:
                continue
            at = np.flatnonzero(cluster == i)
            own = ((v[at] - self.centroids[i]) ** 2).sum(1)
            least[at] = own
            near, gaps = self.neighbours[i]
            for j, gap in zip(near.tolist(), gaps.tolist(), strict=True):
                outside = own >= (gap + 3) // 4  # that is 4 * own >= gap; neither in the core nor in an annulus before this neighbour's
                if not outside.any():
                    break
                _challenge(v, at[outside], j, self.centroids[j], best, least)
        return best, least


def _challenge(v: np.ndarray, at: np.ndarray, j: int, centroid: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
    """Rows ``at`` go to ``j`` if it is nearer, or as near with a smaller number."""
    d = ((v[at] - centroid) ** 2).sum(1)
    wins = (d < least[at]) | ((d == least[at]) & (j < best[at]))
    best[at[wins]], least[at[wins]] = j, d[wins]


def _pass(balls: Balls, dimensions: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            v = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            cluster, distance = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cluster", "distance"))
            cluster, distance = balls.assign(v, cluster, distance)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cluster", "distance"])

    return assign


def _totals(table: DataFrame, dimensions: int) -> list:
    sums = [F.sum(F.col("v")[d]).alias(f"s{d}") for d in range(dimensions)]
    return table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *sums).collect()


def _means(centroids: np.ndarray, totals: list) -> np.ndarray:
    out = centroids.copy()
    for row in totals:
        out[row["cluster"]] = [row[f"s{d}"] // row["n"] for d in range(out.shape[1])]
    return out


def ball_kmeans(
    rows: DataFrame, k: int, rounds: int, seed: int, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64, scale: int = 1024
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector after ``rounds`` rounds, and the centroids."""
    if k < 1 or rounds < 0 or dimensions < 1:
        raise ValueError("k and dimensions are at least 1, rounds at least 0")
    if k * dimensions > MAX_NUMBERS:
        raise ValueError(f"k * dimensions is at most {MAX_NUMBERS}")
    scratch = Scratch(rows.sparkSession, "kmeans")
    start = whole_vectors(rows, id_col, vector_col, dimensions, scale)
    table = scratch.write(start.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), "round-0")
    centroids = first_centroids(table, k, seed)
    if not len(centroids):
        return table.select("vec_id", "cluster", "distance"), centroids
    balls = Balls(centroids)
    for t in range(1, rounds + 2):
        table = scratch.write(table.mapInArrow(_pass(balls, dimensions), table.schema), f"round-{t}")
        scratch.remove(f"round-{t - 1}")
        if t <= rounds:
            totals = _totals(table, dimensions)
            moved = _means(centroids, totals)
            balls = Balls(moved, centroids, {r["cluster"]: r["far"] for r in totals})
            centroids = moved
    return table.select("vec_id", "cluster", "distance"), centroids


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable ``embeddings`` in 8 clusters after 10 rounds, with inertia and centroid digests."""
    rows, centroids = ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8, 10, 3)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    known = [(i, sums.get(i, 0), sum(sums.values()), digest(c)) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _sql(k: int, rounds: int, seed: int, dimensions: int, scale: int) -> str:
    """The same by definition: every round compares every vector with every centroid."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {scale}) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS c, v AS w
    FROM kept QUALIFY c < {k})""",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"""a{t} AS MATERIALIZED (SELECT r, vec_id, v, m.c AS c, m.d AS d FROM (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS m
    FROM (SELECT r, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{t}) GROUP BY r))"""
        )
        if t < rounds:
            parts.append(
                f"""s{t + 1} AS (SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS w
    FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY c, i) GROUP BY c)"""
            )
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c{t}.c AS c, coalesce(s{t + 1}.w, c{t}.w) AS w FROM c{t} LEFT JOIN s{t + 1} USING (c))")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, {last}.c AS cluster, d AS distance, sum(d) OVER (PARTITION BY {last}.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
    sha256(list_aggregate(list_transform(w, lambda x: x::VARCHAR), 'string_agg', ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON {last}.c = c{rounds}.c"""


OP11_SQL = _sql(8, 10, 3, 64, 1024)
