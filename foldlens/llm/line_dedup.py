"""Line dedup over levelled sorted runs of line hashes.

Every batch of documents becomes one run: the 128-bit hash of each line key with the number
of the batch's documents that hold it. Runs are tables bucketed and sorted by hash, all by
the same buckets, so that joining two of them merges them bucket by bucket without any
shuffle. Runs wait in levels: as soon as a level has ``fanout`` of them, they are merged into
one run of the next level, so n batches leave O(fanout * log n) runs and each hash is
rewritten O(log n) times.

Each new batch is merge-anti-joined with the runs and adds its own run. A line counts over all
documents, so what a run settles is a key that it knows to be in ``min_docs`` documents:
such keys leave the batch (they will be dropped whatever comes), all others go on being
counted. After the last batch the runs left are merged once more, and every key that reaches
``min_docs`` is frequent.

Then each line meets the frequent keys. Up to ``BROADCAST_KEYS`` of them (16 bytes each) are
broadcast. Beyond that only hot ones are, those that hold more than a ``HOT_SHARE`` of all
lines, of which there can't be more than ``HOT_SHARE`` times the batches; the others meet
their lines by a shuffle in which no key is hot. Text is never shuffled line by line: per
document only the places of its frequent lines travel, and the documents are joined with
those short lists once; what stays are the stretches between the places, so that a document
costs its lines, not its lines times its frequent ones. Rows without an id are spread over
``NULL_SALTS`` keys there.

Only DataFrame functions run here.

Defined results: a null or empty text is one empty line; keys shorter than
``min_key_chars`` are always kept; rows that repeat a document count as documents of their
own; rows with a null id work like others; an empty table gives an empty one; texts of any
length are split whole, one row's lines at a time; columns named n_lines or n_dropped are
replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANKS, Scratch, durable, lower_ascii, need

KEY = ["k1", "k2"]
BROADCAST_KEYS = 200_000
HOT_SHARE = 5_000
NULL_SALTS = 64


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits, so that even 10^13 different keys don't collide."""
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("line"), key).alias("k2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled sorted runs of (k1, k2, n): in how many documents a line key was seen."""

    def __init__(self, spark: SparkSession, scratch: Scratch | None = None, fanout: int = 2, min_docs: int = 10):
        if fanout < 2:
            raise ValueError("fanout is at least 2")
        self.spark, self.scratch = spark, scratch or Scratch(spark, "line-runs")
        self.fanout, self.min_docs = fanout, min_docs
        # as many buckets as a shuffle has partitions: a batch's aggregate is dealt like the runs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        out = counts.select(*KEY, "n").write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        out.option("path", self.scratch.path(name)).saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """The sum of runs, by joins of sorted buckets."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            return a.join(b.withColumnRenamed("n", "m").hint("merge"), KEY, "full").select(*KEY, n.alias("n"))

        return reduce(two, [self.spark.table(n) for n in names])

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.remove(name)

    def add(self, keys: DataFrame) -> None:
        """Add a batch: one row (k1, k2) for each key of each of its documents."""
        counts = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        for name in self.runs():
            settled = self.spark.table(name).filter(F.col("n") >= self.min_docs).select(*KEY)
            counts = counts.join(settled.hint("merge"), KEY, "left_anti")
        run, level = self._write(counts), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            run = self._write(self._merged(old))
            for name in old:
                self._drop(name)
            level += 1

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def frequent(self) -> DataFrame:
        """(k1, k2, n) of keys in at least ``min_docs`` documents; n counts until they were settled."""
        return self._merged(self.runs()).filter(F.col("n") >= self.min_docs)

    def close(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels = []


def document_keys(docs: DataFrame, id_col: str, text_col: str, min_key_chars: int, batches: int) -> DataFrame:
    """(batch, id, th, k1, k2, pos, first): the lines of each document with a key.

    ``pos`` is the line's place in its text, from 0; ``first`` marks one line of each key in a
    document. Sorting the document's lines by key finds it, so that a document costs its lines
    times their logarithm.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = F.transform(lines_of(text), lambda line, at: F.struct(line_key(line).alias("key"), at.alias("pos")))
    hashed = F.transform(
        F.filter(keyed, lambda x: F.length(x["key"]) >= min_key_chars),
        lambda x: F.struct(*[key_hash(x["key"])[k].alias(k) for k in KEY], x["pos"].alias("pos")),
    )

    def marked(ordered: Column) -> Column:
        before = lambda at: F.get(ordered, at - 1)
        return F.transform(
            ordered,
            lambda x, at: F.struct(
                x["k1"].alias("k1"), x["k2"].alias("k2"), x["pos"].alias("pos"),
                (~(before(at)["k1"].eqNullSafe(x["k1"]) & before(at)["k2"].eqNullSafe(x["k2"]))).alias("first"),
            ),
        )

    # the array around it binds the sorted lines to a name, so that they are sorted once
    keys = F.transform(F.array(F.sort_array(hashed)), marked)[0]
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.explode(keys).alias("key"))
    return slim.select(F.pmod(F.xxhash64("id", "th"), F.lit(batches)).cast("int").alias("batch"), "id", "th", "key.*")


def without_lines(lines: Column, drops: Column) -> Column:
    """``lines`` without those at the places ``drops`` (ascending, from 0): the stretches between them."""

    def stretches(b: Column) -> Column:
        ends = b["ends"]
        gap = lambda i: F.slice(b["lines"], F.get(ends, i) + 2, F.get(ends, i + 1) - F.get(ends, i) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends) - 2), gap))

    ends = F.concat(F.array(F.lit(-1)), drops, F.array(F.size(lines)))
    return F.transform(F.array(F.struct(lines.alias("lines"), ends.alias("ends"))), stretches)[0]


def hits_of(keys: DataFrame, frequent: DataFrame, batches: int, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``keys`` whose key is in ``frequent`` (k1, k2, n), a table."""
    if frequent.count() <= broadcast_keys:
        return keys.join(F.broadcast(frequent.select(*KEY)), KEY, "left_semi")
    # A settled key was counted in the batch that settled it, about its share of all lines.
    lines = F.lit(keys.count())
    hot = F.col("n") * batches * HOT_SHARE >= lines
    is_hot = frequent.filter(hot).select(*KEY, F.lit(True).alias("__hot"))
    marked = keys.join(F.broadcast(is_hot), KEY, "left")
    cold = marked.filter("__hot is null").drop("__hot").join(frequent.filter(~hot).select(*KEY), KEY, "left_semi")
    return marked.filter("__hot").drop("__hot").unionByName(cold)


def drop_frequent_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_key_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 4,
    fanout: int = 2,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``docs`` with lines removed whose key at least ``min_docs`` documents hold.

    Adds ``n_lines`` and ``n_dropped`` and replaces the text. The batches are dealt by
    hash, and the lines go once every batch has been added, so that the result doesn't
    depend on their order or number.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    scratch = Scratch(spark, "line-dedup")
    keys = scratch.write(document_keys(docs, id_col, text_col, min_key_chars, batches), "keys", "batch")
    runs = LineRuns(spark, scratch, fanout, min_docs)
    try:
        for batch in range(batches):
            runs.add(keys.filter((F.col("batch") == batch) & F.col("first")).select(*KEY))
        frequent = scratch.write(runs.frequent(), "frequent")
        hits = hits_of(keys, frequent, batches, broadcast_keys)
        # rows that repeat a document give each place as often
        places = F.sort_array(F.array_distinct(F.collect_list("pos")))
        drops = durable(hits.groupBy("id", "th").agg(places.alias("drops")))
    finally:
        runs.close()
        scratch.remove()

    salts = F.when(F.col("id").isNull(), F.sequence(F.lit(0), F.lit(NULL_SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = drops.select("id", "th", F.explode(salts).alias("salt"), "drops")
    # Rows travel as one column, so that no name of theirs can clash. The salt only spreads rows
    # without id over equal lists: it needn't be the same in a rerun.
    row, text = F.col("row"), F.coalesce(F.col("row")[text_col], F.lit(""))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    salt = F.when(row[id_col].isNull(), F.monotonically_increasing_id() % NULL_SALTS).otherwise(0).cast("int")
    left = left.select("row", F.xxhash64(text).alias("own"), salt.alias("own_salt"))
    same = row[id_col].eqNullSafe(F.col("id")) & (F.col("own") == F.col("th")) & (F.col("own_salt") == F.col("salt"))
    kept = F.when(F.col("drops").isNotNull(), without_lines(lines_of(text), F.col("drops")))
    joined = left.join(right, same, "left").select(
        "row", F.size(lines_of(text)).cast("long").alias("lines"), F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("gone"), kept.alias("kept")
    )
    own = {text_col: F.when(F.col("kept").isNull(), text).otherwise(F.array_join("kept", "\n"))}
    return joined.select(
        *[own.get(c, row[c]).alias(c) for c in docs.columns], F.col("lines").alias("n_lines"), F.col("gone").alias("n_dropped")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_frequent_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


OP3_SQL = r"""
WITH lines AS (
  SELECT rowid_ AS r, doc_id, line, pos,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rowid_, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), frequent AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (f.key IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key)
GROUP BY r, doc_id
"""
