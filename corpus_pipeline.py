"""The corpus pipeline: from raw documents to a mixture for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Stages are written to the shared folder and read again, so
that none is computed twice and a lost executor costs one stage's tasks at most. Stage folders
are removed when the next stage is written, the last one when the driver's JVM ends.

Defined results: null and empty texts pass each stage by its operator's rules (the
classifier decides on them, they have no shingles, windows or words, and take 0 words of the
mixture, so the last stage leaves them out); texts of any length pass whole; rows without id
are never near duplicates; of rows with one id the near-duplicate stage keeps one; an empty
table stays empty through all stages; extra columns pass all stages but the last unchanged,
whatever their names; the last one replaces columns named size, source_size, target or taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlens.llm import decontam, jaccard, line_dedup, mixing, quality
from foldlens.llm.shared import Scratch, named_as, place_of, plainly_named


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents or more hold go; a document stays even if none is left."""
    ident, text = place_of(docs, "doc_id"), place_of(docs, "text")
    done = line_dedup.drop_frequent_lines(plainly_named(docs), id_col=ident, text_col=text)
    if "n_chars" in docs.columns:
        done = done.withColumn(place_of(docs, "n_chars"), F.length(text).cast("long"))
    return named_as(done, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles one stays."""
    return jaccard.keep_one_each(docs, n=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes words from, with the words taken of each."""
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    return mixing.mix(sized).filter("taken > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage-{k + 1}")
            if k:
                scratch.remove(f"stage-{k}")
    return docs


#: No SQL: the first stage is a neural network's decision. tests/llm compares the stages with brute force.
ORACLE_SQL = None
