"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets: sources in code-point order (null last) weigh ``weights`` in turn and share
   ``share`` times all words. A target stops at ``cap`` times its source's words, the
   excess goes to the others by weight until none is above (water filling in closed form:
   sources sorted by cap / weight, running sums).
2. Blocks of ``block_words`` words go to the sources by the highest quotients
   target / (2k + 1): the Sainte-Laguë seats. Each source's blocks go to its shards in the
   same way, by the shards' words. Only quotients that can decide are listed: with n
   parties a party's seats differ from its quota by n/2 of its share plus 1/2 at most, so
   about 5n rows are ranked, however many blocks there are.
3. In each shard the documents stand in seeded order on a circle of words; the shard's
   blocks are a run of it that begins at a seeded word. A run of more than one turn takes
   words again, never more than ``cap`` times.

A shard holds about ``shard_words`` words (a source has at most 65,536 shards, which then
hold more), so a hot source is dealt over many tasks. The source table is broadcast only
up to ``BROADCAST_SOURCES`` rows. Only DataFrame functions run here; nothing but the words
per source and hash bucket is aggregated, and sums are combined before the shuffle.

Defined results: a null text has 0 words; a null source is one source, the last; documents
of 0 words take 0; words are counted in whole texts of any length; repeated rows are documents
of their own; an empty table gives an empty one; columns named source_size, target or taken
are replaced, other columns stay; without any words every target is 0. Reruns agree whatever the partitions, as order and offsets
come from md5 of seed, id and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import durable, need

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 65_536
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hex(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def apportion(parties: DataFrame, group: list[str], order: str, weight: str, seats: str) -> DataFrame:
    """Sainte-Laguë seats: ``parties`` with the column ``won``.

    ``seats`` is the number of seats of the party's group. Ties go to the smaller ``order``.
    Parties of weight 0 win none. Nothing is looped over: the seats that each party surely
    has are counted, and only the quotients that can still win are ranked.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    voted = parties.filter(F.col(weight) > 0)
    voted = voted.withColumns({"__all": F.sum(weight).over(whole), "__n": F.count(F.lit(1)).over(whole)})
    part = F.col(weight) / F.col("__all")
    base = F.floor(F.col(seats) * part - F.col("__n") / 2 * part - 0.5)
    voted = voted.withColumn("__base", F.greatest(base, F.lit(0)).cast("long"))
    voted = voted.withColumn("__left", F.col(seats) - F.sum("__base").over(whole))
    top = F.col("__base") + F.ceil(F.col("__n") * part).cast("long") + 3
    listed = voted.withColumn("__k", F.explode(F.sequence("__base", top)))
    quotient = F.col(weight) / (2 * F.col("__k") + 1).cast("double")
    rank = F.row_number().over(whole.orderBy(quotient.desc(), F.col(order)))
    won = listed.withColumn("__won", (rank <= F.col("__left")).cast("long"))
    won = won.groupBy(*group, order).agg((F.first("__base") + F.sum("__won")).alias("won"))
    keys = list(dict.fromkeys([*group, order]))
    return parties.join(won, keys, "left").withColumn("won", F.coalesce("won", F.lit(0)))


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(source, source_size) with ``sid`` (1, 2, ... by code point, null last) and ``target``."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("sid", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("w", F.element_at(turn, (F.col("sid") - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumns(
        {
            "cap": F.col("source_size") * cap,
            "budget": F.sum("source_size").over(everything) * F.lit(share),
            "wall": F.sum("w").over(everything),
        }
    ).withColumn("ratio", F.col("cap") / F.col("w"))
    upto = everything.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    full = F.sum("cap").over(upto) + F.col("ratio") * (F.col("wall") - F.sum("w").over(upto)) <= F.col("budget")
    ranked = ranked.withColumn("full", full)
    spent, weighed = (F.sum(F.when(F.col("full"), F.col(c)).otherwise(0)).over(everything) for c in ("cap", "w"))
    level = F.try_divide(F.col("budget") - spent, (F.col("wall") - weighed).cast("double"))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * level)
    return ranked.select("source", "source_size", "sid", target.alias("target"), "budget")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    block_words: int = 64,
    shard_words: int = 250_000,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` (with a column ``size``) plus ``source_size``, ``target`` and ``taken``."""
    need(docs, id_col, source_col, "size")
    docs = docs.drop("source_size", "target", "taken")
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("size")))
    marked = docs.withColumns({"__mark": mark, "__source": F.col(source_col)})
    marked = marked.withColumn("__bucket", _hex(F.col("__mark"), 4))

    buckets = marked.groupBy(F.col("__source").alias("source"), F.col("__bucket").alias("bucket"))
    buckets = durable(buckets.agg(F.sum("size").alias("words")))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    sources = sources.withColumn("seats", F.round(F.col("budget") / block_words).cast("long"))
    sources = apportion(sources, [], "sid", "target", "seats").withColumn(
        "n_shards",
        F.greatest(F.lit(1), F.least(F.lit(BUCKETS), F.ceil(F.col("source_size") / shard_words))).cast("long"),
    )
    sources = durable(sources.select("source", "sid", "source_size", "target", "n_shards", F.col("won").alias("blocks")))
    small = F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda df: df)

    def shard(bucket: str, shards: str) -> Column:
        return F.floor(F.col(bucket) * F.col(shards) / BUCKETS).cast("long")

    shards = buckets.join(small(sources), buckets["source"].eqNullSafe(sources["source"]))
    shards = shards.groupBy("sid", shard("bucket", "n_shards").alias("shard")).agg(
        F.sum("words").alias("length"), F.first("blocks").alias("blocks")
    )
    shards = apportion(shards, ["sid"], "shard", "length", "blocks")
    run = F.least(F.col("won") * block_words, F.col("length") * cap)
    begin = F.md5(F.concat_ws("|", F.lit(seed), F.lit("shard"), "sid", "shard"))
    begin = F.when(F.col("length") > 0, F.pmod(_hex(begin, 8), F.col("length"))).otherwise(0)
    shards = shards.select(
        F.col("sid").alias("__sid"), F.col("shard").alias("__shard"), F.col("length").alias("__length"), run.alias("__run"), begin.alias("__begin")
    )

    known = sources.select(
        F.col("source").alias("__of"), F.col("sid").alias("__sid"), "source_size", "target", F.col("n_shards").alias("__shards")
    )
    placed = marked.join(small(known), F.col("__source").eqNullSafe(F.col("__of")))
    placed = placed.withColumn("__shard", shard("__bucket", "__shards"))
    order = Window.partitionBy("__sid", "__shard").orderBy("__mark", "size")
    placed = placed.withColumn("__end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(shards, ["__sid", "__shard"])
    turns = [
        F.greatest(
            F.lit(0),
            F.least(F.col("__end") + k * F.col("__length"), F.col("__begin") + F.col("__run"))
            - F.greatest(F.col("__end") - F.col("size") + k * F.col("__length"), F.col("__begin")),
        )
        for k in range(cap + 1)
    ]
    taken = sum(turns[1:], turns[0]).cast("long")
    return placed.select(*docs.columns, "source_size", "target", taken.alias("taken"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(slim).select("doc_id", "size", "source_size", "target", "taken")


def _ranked_sql(parties: str, group: str, order: str, weight: str, seats: str) -> str:
    """Seats won, by the highest quotients, listed from 1 up (only for small fixtures)."""
    over = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, {order}" if group else order
    return f"""
      SELECT {keys}, count(*)::BIGINT AS won FROM (
        SELECT {keys}, {seats} AS seats, row_number() OVER ({over} ORDER BY {weight} / (2 * k + 1)::DOUBLE DESC, {order}) AS place
        FROM (SELECT *, unnest(range(0, {seats} + 1)) AS k FROM {parties} WHERE {weight} > 0))
      WHERE place <= seats GROUP BY {keys}"""


OP2_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), marked AS (
  SELECT *, md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || size) AS mark FROM sized
), bucketed AS (SELECT *, ('0x' || substr(mark, 1, 4))::BIGINT AS bucket FROM marked
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([3, 1, 2])[((sid - 1) % 3 + 1)::INT] AS w, source_size * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM totals
), ratios AS (SELECT *, cap::DOUBLE / w AS ratio, (sum(w) OVER ())::BIGINT AS wall FROM weighed
), fulls AS (
  SELECT *, (sum(cap) OVER (ORDER BY ratio))::DOUBLE + ratio * (wall - sum(w) OVER (ORDER BY ratio))::DOUBLE <= budget AS is_full FROM ratios
), levels AS (
  SELECT *, (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE AS spent, (sum(CASE WHEN is_full THEN w ELSE 0 END) OVER ())::BIGINT AS used FROM fulls
), targets AS (
  SELECT source, source_size, sid, CASE WHEN is_full THEN cap::DOUBLE ELSE w * ((budget - spent) / (wall - used)::DOUBLE) END AS target,
         round(budget / 64)::BIGINT AS seats, greatest(1, least(65536, ceil(source_size / 250000.0)))::BIGINT AS n_shards
  FROM levels
), source_won AS ({_ranked_sql("targets", "", "sid", "target", "seats")}
), sources AS (SELECT t.*, coalesce(won, 0) AS blocks FROM targets t LEFT JOIN source_won USING (sid)
), placed AS (
  SELECT b.doc_id, b.size, b.mark, s.sid, s.source_size, s.target, s.blocks, (b.bucket * s.n_shards) // 65536 AS shard
  FROM bucketed b JOIN sources s ON b.source IS NOT DISTINCT FROM s.source
), shards AS (SELECT sid, shard, sum(size)::BIGINT AS length, any_value(blocks) AS blocks FROM placed GROUP BY sid, shard
), shard_won AS ({_ranked_sql("shards", "sid", "shard", "length", "blocks")}
), runs AS (
  SELECT sid, shard, length, least(coalesce(won, 0) * 64, length * 2) AS run,
         CASE WHEN length > 0 THEN ('0x' || substr(md5('mix|shard|' || sid || '|' || shard), 1, 8))::BIGINT % length ELSE 0 END AS begin_
  FROM shards LEFT JOIN shard_won USING (sid, shard)
), ends AS (
  SELECT *, (sum(size) OVER (PARTITION BY sid, shard ORDER BY mark, size ROWS UNBOUNDED PRECEDING))::BIGINT AS end_ FROM placed
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(end_, begin_ + run) - greatest(end_ - size, begin_))
        + greatest(0, least(end_ + length, begin_ + run) - greatest(end_ - size + length, begin_))
        + greatest(0, least(end_ + 2 * length, begin_ + run) - greatest(end_ - size + 2 * length, begin_)))::BIGINT AS taken
FROM ends JOIN runs USING (sid, shard)
"""
