"""Duplicate pairs, leakage across roles, review states and entity clusters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import fingerprint, hamming
from ..functions.cleaning import identifies
from ..functions.ordering import numbered
from ..shared_folder import durable


def exact_pairs(rows: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(id_a, id_b) of equal content, id_a < id_b, met by hash: only copies are joined."""
    hashed = rows.filter(content.isNotNull()).select(F.col(id_col).alias("id"), F.sha2(content.cast("binary"), 256).alias("h"))
    a, b = hashed.withColumnRenamed("id", "id_a"), hashed.withColumnRenamed("id", "id_b")
    return a.join(b, "h").filter("id_a < id_b").select("id_a", "id_b")


def exact_groups(rows: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(id, first_id, copies): each copy with its group's smallest id; linear in the copies."""
    hashed = rows.filter(content.isNotNull()).select(F.col(id_col).alias("id"), F.sha2(content.cast("binary"), 256).alias("h"))
    groups = hashed.groupBy("h").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return hashed.join(groups, "h").select("id", "first_id", "copies")


def copy_edges(rows: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(a, b) edges that connect copies to their group's smallest id: k copies give k - 1 edges, not all pairs."""
    return exact_groups(rows, id_col, content).filter("id <> first_id").select(F.col("id").alias("a"), F.col("first_id").alias("b"))


def copies_across_roles(rows: DataFrame, id_col: str, content: Column, manifest: DataFrame) -> DataFrame:
    """(first_id, fold, roles, n): groups of copies that stand in several roles of a fold, linear in the copies."""
    groups = exact_groups(rows, id_col, content).select("id", "first_id")
    per = manifest.join(groups, "id").groupBy("fold", "first_id").agg(F.array_join(F.array_sort(F.collect_set("role")), "|").alias("roles"), F.count(F.lit(1)).alias("n"))
    return per.filter(F.instr("roles", "|") > 0).select("first_id", "fold", "roles", "n")


def fingerprints(vectors: DataFrame, id_col: str, values: Column) -> DataFrame:
    """(id, low, high): the 64-bit hash of 64 values in two halves."""
    low, high = fingerprint(F.transform(values, lambda v: v.cast("double")))
    return vectors.select(F.col(id_col).alias("id"), low.alias("low"), high.alias("high"))


def _band(low: Column, high: Column, begin: int, end: int) -> Column:
    """Bits begin ... end - 1 of the 64, as a number."""
    value = F.lit(0).cast("long")
    if begin < 32:
        value = F.shiftright(low, begin).bitwiseAND((1 << (min(end, 32) - begin)) - 1)
    if end > 32:
        start = max(begin, 32)
        part = F.shiftright(high, start - 32).bitwiseAND((1 << (end - start)) - 1)
        value = value + F.shiftleft(part, start - begin)
    return value


#: Values that a band is looked up with at most, and rows of a block of the grid while there are few blocks.
MOST_PROBES, BLOCK = 5000, 1024
#: Blocks of the grid, tasks that their pairs are spread over, and hashes that are compared in a grid
#: where bands are possible, at most.
MOST_BLOCKS, GRID_TASKS, MOST_IN_GRID = 48, 400, 4_000_000


def _ball(width: int, radius: int) -> int:
    """Values of ``width`` bits within ``radius`` bits of one."""
    return sum(comb(width, r) for r in range(radius + 1))


def _edges(bands: int) -> list[int]:
    return [64 * i // bands for i in range(bands + 1)]


def plan_bands(rows: int, distance: int) -> int:
    """How many bands cost least for so many hashes; 0 if comparing all pairs costs less.

    Hashes at most ``distance`` bits apart are at most distance // bands bits apart in one
    band. A band is looked up with every value so near; rows then meet by chance at a rate of
    those values among all values of the band.
    """
    costs = {0: rows * rows / 2}
    for bands in range(1, 65):
        radius, widths = distance // bands, [e - b for b, e in zip(_edges(bands), _edges(bands)[1:], strict=False)]
        probes = [_ball(w, radius) for w in widths]
        if max(probes) <= MOST_PROBES:
            costs[bands] = rows * sum(probes) + rows * rows / 2 * sum(p / 2**w for p, w in zip(probes, widths, strict=True))
    return min(costs, key=costs.get)


def hamming_pairs(hashes: DataFrame, distance: int, bands: int | None = None) -> DataFrame:
    """(id_a, id_b, distance) of hashes that differ in at most ``distance`` bits.

    Where it moves fewer rows than comparing all pairs in blocks (``_grid``), the 64 bits are cut into
    ``bands`` (as many as ``plan_bands`` finds cheapest for the number of hashes): pairs meet by
    equi-joins on (band, value), where one side has all values near its own, and count in the
    first band that brings them together. Rows that this moves grow with the values near one, which are
    thousands for long distances, while the grid moves each row ``MOST_BLOCKS`` times at most.
    """
    if not 0 <= distance <= 64:
        raise ValueError("distance is 0 to 64")
    hashes = durable(hashes).filter("id is not null and low is not null and high is not null")
    count = hashes.count()
    bands = plan_bands(count, distance) if bands is None else bands
    blocks = min(MOST_BLOCKS, max(1, -(-count // BLOCK)))
    looked_up = bands * (1 + _ball(-(-64 // bands), distance // bands)) if bands else 0
    if not bands or looked_up > blocks and count <= MOST_IN_GRID:
        return _grid(hashes, distance, blocks)
    apart = hamming(F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b"))
    met = _probed(hashes, distance, bands)
    return met.withColumn("distance", apart).filter(F.col("distance") <= distance).select("id_a", "id_b", "distance")


def _grid(hashes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """All pairs, block by block: a row for each pair of blocks, whose hashes meet in arrays of numbers.

    Blocks are lists of ids and hashes; no task holds more than two, and answers leave it in pieces.
    """
    code = F.shiftleft("high", 32).bitwiseOR(F.col("low"))
    dealt = hashes.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("x"), F.struct("id", code.alias("code")).alias("row"))
    packed = durable(dealt.groupBy("x").agg(F.collect_list("row").alias("rows"))).select("x", F.col("rows.id").alias("ids"), F.col("rows.code").alias("codes"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ones = packed.select("x", F.col("ids").alias("ids_x"), F.col("codes").alias("codes_x"), every.alias("y")).filter("x <= y")
    others = packed.select(F.col("x").alias("y"), F.col("ids").alias("ids_y"), F.col("codes").alias("codes_y"), every.alias("x")).filter("x <= y")
    tasks = min(blocks * (blocks + 1) // 2, GRID_TASKS)
    ones, others = ones.repartition(tasks, "x", "y"), others.repartition(tasks, "x", "y")
    kind = hashes.schema["id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
            for r in range(batch.num_rows):
                (ids_a, a), (ids_b, b) = ((batch.column(f"ids_{s}")[r].values, batch.column(f"codes_{s}")[r].values.to_numpy().view(np.uint64)) for s in "xy")
                held: list[tuple] = []
                for begin in range(0, len(a), 64):
                    for at in range(0, len(b), 8192):
                        apart = np.bitwise_count(a[begin : begin + 64, None] ^ b[None, at : at + 8192])
                        i, j = np.nonzero(apart <= distance)
                        if len(i):
                            held.append((i + begin, j + at, apart[i, j]))
                    if begin + 64 >= len(a) or sum(len(h[0]) for h in held) >= 8192:
                        if held:
                            i, j, far = (np.concatenate(h) for h in zip(*held, strict=True))
                            once = i < j if x[r] == y[r] else slice(None)  # each pair of one block once
                            yield pa.RecordBatch.from_arrays([ids_a.take(pa.array(i[once])), ids_b.take(pa.array(j[once])), pa.array(far[once].astype(np.int32))], ["a", "b", "distance"])
                        held = []

    met = ones.join(others.hint("merge"), ["x", "y"]).mapInArrow(compare, f"a {kind}, b {kind}, distance int")
    return met.filter("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "distance")


def _side(hashes: DataFrame, s: str) -> DataFrame:
    return hashes.withColumnsRenamed({"id": f"id_{s}", "low": f"low_{s}", "high": f"high_{s}"})


def _probed(hashes: DataFrame, distance: int, bands: int) -> DataFrame:
    edges, radius = _edges(bands), distance // bands
    spans = list(zip(edges, edges[1:], strict=False))
    value = lambda s, k: _band(F.col(f"low_{s}"), F.col(f"high_{s}"), *spans[k])
    near = []
    for k, (begin, end) in enumerate(spans):
        masks = [sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(end - begin), r)]
        flips = F.expr(f"array({', '.join(f'{m}L' for m in masks)})")
        near.append(_side(hashes, "a").select("*", F.lit(k).alias("band"), F.explode(flips).alias("flip")).withColumn("value", value("a", k).bitwiseXOR(F.col("flip"))).drop("flip"))
    left = near[0]
    for more in near[1:]:
        left = left.unionByName(more)
    own = F.posexplode(F.array(*[value("b", k) for k in range(bands)]))
    right = _side(hashes, "b").select("*", own.alias("band", "value"))
    # A pair is brought together once in each band where it is near: the first of them counts.
    first = F.lit(bands)
    for k in reversed(range(bands)):
        first = F.when(F.bit_count(value("a", k).bitwiseXOR(value("b", k))) <= radius, k).otherwise(first)
    return left.join(right, ["band", "value"]).filter("id_a < id_b").filter(first == F.col("band"))


#: Why a pair is listed.
EXACT_REASON, CANDIDATE_REASON = "exact decoded pixels", "CANDIDATE ONLY; visual/source review required"


def candidate_pairs(images: DataFrame, distance: int = 6) -> DataFrame:
    """Candidates of duplicate review: equal bytes, equal pixels, or near fingerprints.

    ``images``: id, sha256, pixel_sha256, low, high and decode_ok; rows that couldn't be
    decoded don't take part. Where it has archive_split and archive_label, pairs have them of both sides.
    """
    good = images.filter("decode_ok").drop("decode_ok")
    pairs = exact_pairs(good, "id", F.col("sha256")).union(exact_pairs(good, "id", F.col("pixel_sha256")))
    pairs = pairs.union(hamming_pairs(good.select("id", "low", "high"), distance).select("id_a", "id_b")).distinct()
    side = lambda s: good.select(*[F.col(c).alias(f"{c}_{s}") for c in good.columns])
    both = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    pixels = F.col("pixel_sha256_a") == F.col("pixel_sha256_b")
    return both.select(
        "id_a", "id_b", (F.col("sha256_a") == F.col("sha256_b")).alias("byte_identical"), pixels.alias("pixel_identical"),
        hamming(F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b")).alias("distance"),
        F.when(pixels, "yes").otherwise("").alias("verified_related"),
        F.when(pixels, EXACT_REASON).otherwise(CANDIDATE_REASON).alias("review_reason"),
        *[F.col(f"{old}_{s}").alias(f"{new}_{s}") for old, new in (("archive_split", "split"), ("archive_label", "label")) if old in good.columns for s in "ab"],
    )


def numbered_pairs(pairs: DataFrame, exact: str, distance: str) -> DataFrame:
    """``pairs`` with pair_id 1 ... n: exact ones first, then by distance and ids."""
    return numbered(pairs, [F.when(F.col(exact), 0).otherwise(1), F.col(distance), F.col("id_a"), F.col("id_b")], "pair_id")


def within_cohort(pairs: DataFrame, cohort: DataFrame) -> DataFrame:
    """Pairs whose ends are both in ``cohort`` (id)."""
    a, b = cohort.select(F.col("id").alias("id_a")), cohort.select(F.col("id").alias("id_b"))
    return pairs.join(a, "id_a", "left_semi").join(b, "id_b", "left_semi")


def cross_role_pairs(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id_a, id_b, fold, role_a, role_b) of pairs whose ends play different roles in a fold."""
    a = manifest.select(F.col("id").alias("id_a"), "fold", F.col("role").alias("role_a"))
    b = manifest.select(F.col("id").alias("id_b"), "fold", F.col("role").alias("role_b"))
    return pairs.select("id_a", "id_b").join(a, "id_a").join(b, ["id_b", "fold"]).filter("role_a <> role_b").select("id_a", "id_b", "fold", "role_a", "role_b")


def entities_across_roles(members: DataFrame, manifest: DataFrame, identifier: str) -> DataFrame:
    """(identifier, value, fold, roles, n): known entities that stand in several roles of a fold."""
    known = members.filter(identifies(F.col("entity"))).select("id", F.col("entity").cast("string").alias("value"))
    roles = F.array_join(F.array_sort(F.collect_set("role")), "|")
    found = manifest.join(known, "id").groupBy("fold", "value").agg(roles.alias("roles"), F.count(F.lit(1)).alias("n"))
    return found.filter(F.instr("roles", "|") > 0).select(F.lit(identifier).alias("identifier"), "value", "fold", "roles", "n")


def review_summary(pairs: DataFrame, cohort: DataFrame) -> DataFrame:
    """One row of counts over reviewed pairs (verified_related yes, no or blank)."""
    status = F.lower(F.trim(F.coalesce("verified_related", F.lit(""))))
    inside = within_cohort(pairs, cohort).select("id_a", "id_b", F.lit(True).alias("inside"))
    rows = pairs.join(inside, ["id_a", "id_b"], "left").withColumns({"inside": F.coalesce("inside", F.lit(False)), "status": status})
    crossing = F.col("split_a") != F.col("split_b")
    return rows.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("pixel_identical").alias("exact_pairs"),
        F.count_if(F.col("pixel_identical") & crossing).alias("cross_split_exact_pairs"), F.count_if("inside").alias("cohort_candidates"),
        F.count_if(F.col("inside") & F.col("pixel_identical")).alias("cohort_exact_pairs"),
        F.count_if(F.col("inside") & (F.col("status") == "yes")).alias("reviewed_yes"),
        F.count_if(F.col("inside") & (F.col("status") == "no")).alias("reviewed_no"),
        F.count_if(F.col("inside") & (F.col("status") == "")).alias("unresolved"),
    )


def review_violations(pairs: DataFrame) -> DataFrame:
    """Pairs whose review is neither yes nor no; grouping waits for them."""
    status = F.lower(F.trim(F.coalesce("verified_related", F.lit(""))))
    return pairs.filter(~status.isin("yes", "no")).select("id_a", "id_b", status.alias("status"))


def stale_reviews(reviewed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id_a, id_b, problem): pairs that were reviewed but are no candidates, are candidates but not reviewed, or were reviewed twice."""
    side = lambda d, name: d.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias(name))
    both = side(reviewed, "reviews").join(side(candidates, "current"), ["id_a", "id_b"], "full")
    problem = F.when(F.col("current").isNull(), "not a candidate").when(F.col("reviews").isNull(), "not reviewed").when(F.col("reviews") > 1, "reviewed twice")
    return both.withColumn("problem", problem).filter("problem is not null").select("id_a", "id_b", "problem")


def star_edges(members: DataFrame) -> DataFrame:
    """(a, b) edges that connect the members (id, entity) of each known entity to its smallest id."""
    known = members.filter(identifies(F.col("entity"))).select("id", "entity")
    least = known.groupBy("entity").agg(F.min("id").alias("b"))
    return known.join(least, "entity").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()


def connected_components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id that each of ``nodes`` (id) is connected to by ``edges`` (a, b).

    Each round a node takes the smallest label among its own and its neighbours', and then
    its label's label, which halves long chains, until no label changes: labels only fall, so
    that comes. Rounds are cut by checkpoints.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = durable(nodes.select("id", F.col("id").alias("cluster")).distinct())
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("cluster").alias("near"))
        nearer = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("cluster", "near").alias("next"), F.col("cluster").alias("was"))
        jump = labels.select(F.col("id").alias("at"), F.col("cluster").alias("far"))
        moved = nearer.join(jump, F.col("next") == F.col("at"), "left").select("id", F.least("next", "far").alias("cluster"), "was")
        moved = durable(moved)
        labels = moved.select("id", "cluster")
        if moved.filter("cluster <> was").isEmpty():
            return labels
