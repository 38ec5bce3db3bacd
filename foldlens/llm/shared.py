"""What the operators share: the shared folder, durable cuts of lineage, columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session on one machine (master local) that has none, as in tests, gets a temporary one;
    on a cluster that would be a folder the executors can't see, and is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="foldlens-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's own bounds of an Arrow batch, and the ones that operators with Python workers take instead.
_BATCH = {"maxRecordsPerBatch": ("10000", "2000"), "maxBytesPerBatch": ("67108864b", "4194304b")}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to 4 MB, as a task holds one several times over outside of the heap.

    A session that has set bounds of its own keeps them.
    """
    for name, (usual, lower) in _BATCH.items():
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", lower)


class Scratch:
    """A folder of tables inside the shared folder.

    ``remove()`` deletes it or one of its tables; what is left, such as tables that a lazy
    result still reads, goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        at, files = self._at("")
        files.mkdirs(at)
        files.deleteOnExit(at)

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, *partition_by: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back with its own schema."""
        out = df.write.mode("overwrite")
        if compression:
            out = out.option("compression", compression)
        (out.partitionBy(*partition_by) if partition_by else out).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def remove(self, *names: str) -> None:
        for name in names or ("",):
            at, files = self._at(name)
            files.delete(at, True)


#: A key is hot if it holds more than one of so many equal parts of all rows.
HOT_SHARE = 1000


def join_by_weight(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once and how many rows of ``left`` hold it.

    Keys that hold more than a ``HOT_SHARE``-th of the ``total`` rows, of which there can't be
    more than ``HOT_SHARE``, are broadcast, and their rows stay where they are; the others
    meet by a shuffle in which no key is hot.
    """
    heavy = F.col(weight) * HOT_SHARE > F.lit(max(total, HOT_SHARE))
    rest = [c for c in right.columns if c not in (*keys, weight)]
    hot = right.filter(heavy).select(*keys, F.struct(*rest).alias("__hot"))
    marked = left.join(F.broadcast(hot), keys, "left")
    cold = marked.filter("__hot is null").drop("__hot").join(right.filter(~heavy).drop(weight), keys)
    warm = marked.filter("__hot is not null").select(*left.columns, *[F.col("__hot")[c].alias(c) for c in rest])
    return warm.unionByName(cold)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "\t\n\x0b\x0c\r "


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept (``lower`` would change é, İ, ...)."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")


def plainly_named(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., so that names that an operator adds can't clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named_as(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns c0, c1, ... of ``df`` under the names of ``like``, the rest left out."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(like.columns)])


def place_of(df: DataFrame, column: str) -> str:
    """The name of ``column`` in ``plainly_named(df)``."""
    return f"c{df.columns.index(column)}"
