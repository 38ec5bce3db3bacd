"""Ranks and running sums within large groups.

A window over a group sorts the whole group in one task, and a label or a class may hold a
third of all rows. Here the group's order is cut into buckets: sums per bucket (combined
before the shuffle) give each bucket's offset, and windows run within buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared_folder import durable

#: Hexadecimal digits of a digest that name its bucket: 65,536 buckets for each group.
DIGITS = 4
#: Rows that a task gets where their number is known. Adaptive execution sizes tasks by compressed
#: bytes, and ids and counts of few values take tens of times as much in memory.
TASK_ROWS = 250_000


def tasks_of(rows: int) -> int:
    """Partitions for ``rows``: a number given to ``repartition`` isn't coalesced, so the rows of a task stay bounded."""
    return max(1, -(-rows // TASK_ROWS))


def running_sums(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, Column], own: bool = True, tasks: int | None = None) -> DataFrame:
    """``df`` with running sums of ``sums`` (name: value) within ``keys`` along ``order``.

    ``bucket`` must not fall along ``order``. With ``own`` a row's own value is included. ``tasks`` is
    the number of partitions that rows are dealt to, where it is known.
    """
    # Fields of a struct are equal where both are NULL, and join and window ask for the same deal: rows move once.
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("bucket"))
    bucketed = df.withColumn("__key", key).withColumns({f"__v_{n}": v for n, v in sums.items()})
    totals = bucketed.groupBy("__key").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*[f"__key.k{i}" for i in range(len(keys))]).orderBy("__key.bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__key", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    if tasks:
        bucketed = bucketed.repartition(tasks, "__key")
    within = Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    joined = bucketed.join(offsets, "__key")
    out = {n: F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(within), F.lit(0)) for n in sums}
    return joined.select(*[c for c in df.columns if c not in sums], *[v.alias(n) for n, v in out.items()])


def hashed_rank(df: DataFrame, keys: list[str], digest: Column, tie: str, name: str, digits: int = DIGITS, tasks: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within ``keys`` by a hexadecimal ``digest``, then ``tie``."""
    marked = df.withColumn("__digest", F.unhex(digest))  # half as long, in the same order
    bucket = F.substring(F.hex(F.substring("__digest", 1, (digits + 1) // 2)), 1, digits)
    ranked = running_sums(marked, keys, bucket, [F.col("__digest"), F.col(tie)], {name: F.lit(1).cast("long")}, tasks=tasks)
    return ranked.drop("__digest")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... along ``order``, which should tell all rows apart.

    Rows are dealt by range, so that partitions follow the order and have about the same size
    whatever the values are; each is numbered by itself and shifted by the rows before it.
    The deal is written once, as its bounds come from a sample.
    """
    dealt = durable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    shifts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(shifts, "__part").withColumn(name, F.col("__shift") + place).drop("__part", "__shift")
