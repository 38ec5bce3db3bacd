"""Labelled documents for the classifiers: a bounded, repeatable sample."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import need

#: At most so many labelled documents are taken to the driver to fit a classifier.
SAMPLE = 6000
#: And at most so many bytes of text, of which no document has more than a sixteenth.
SAMPLE_BYTES = 64 << 20


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def in_fold(doc_id: Column, parts: int, which: int) -> Column:
    """Whether the id is in fold ``which``; false for no id, which is in none."""
    return F.coalesce(fold(doc_id, parts) == which, F.lit(False))


def fold_of(doc_id, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int = SAMPLE) -> tuple[list, np.ndarray]:
    """Texts and labels (0 or 1) of at most ``most`` documents outside of fold ``held``.

    Rows without id or label don't count; an id that is labelled twice has the larger label.
    The sample is the same in every run: the first by a hash of the id, up to ``most``
    documents and ``SAMPLE_BYTES`` bytes; longer texts than a sixteenth of that aren't learned
    from (all texts are scored, whatever their length).
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", label)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), parts) != held))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__y"))
    known = known.withColumn("__o", F.xxhash64("doc_id")).orderBy("__o", "doc_id").limit(most)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select("doc_id", "text").filter(size <= SAMPLE_BYTES // 16).join(F.broadcast(known), "doc_id")
    rows = rows.orderBy("__o", "doc_id", "text").limit(most)
    upto = Window.orderBy("__o", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # of at most ``most`` rows
    got = rows.withColumn("__b", F.sum(size).over(upto)).filter(F.col("__b") <= SAMPLE_BYTES).select("text", "__y").toPandas()
    return got["text"].tolist(), got["__y"].to_numpy(dtype=float)
