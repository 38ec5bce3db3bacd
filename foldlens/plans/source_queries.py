"""Queries that write tables through the sinks and read them back through the sources.

Each call writes into a new folder below the shared one and leaves it there, as its result is
read later; who names ``spark.checkpoint.dir`` clears it.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared_folder import shared_dir
from ..sources import sinks, tables
from . import views as v
from .data_queries import FOLD_METRICS, fold_metrics
from .evaluation_queries import R


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/foldlens-{uuid4().hex}"


def csv_back(spark, d) -> DataFrame:
    """All documents through CSV: quotes, line breaks, blanks; empty and absent texts both come back as NULL."""
    docs = v.table(spark, d, "documents")
    marked = docs.select("doc_id", "text", F.concat(F.lit(' "'), "lang", F.lit('"\\ ')).alias("quoted"), F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "x, y").alias("gap"), "n_chars")
    path = new_folder(spark)
    sinks.write_new_csv(marked, path)
    return tables.read_csv(spark, path, "doc_id bigint, text string, quoted string, gap string, n_chars bigint")


def many_csv(spark, d) -> DataFrame:
    """Customers from one CSV for each half of the keys, read together."""
    customer, path = v.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), new_folder(spark)
    parts = [f"{path}/{half}" for half in (0, 1)]
    for half, part in enumerate(parts):
        sinks.write_new_csv(customer.filter(F.col("c_custkey") % 2 == half), part)
    return tables.read_csv(spark, parts, "c_custkey bigint, c_name string, c_acctbal double")


def result_files(spark, d) -> DataFrame:
    """Fold metrics as a file for each model, found by a glob; the model is the folder's name."""
    rows, path = fold_metrics(spark, d).select("model", "fold", "accuracy", "share_f"), new_folder(spark)
    for model in ("a", "b"):
        sinks.write_new_csv(rows.filter(F.col("model") == model).drop("model"), f"{path}/{model}")
    return tables.read_fold_metrics(spark, f"{path}/*/*.csv", "fold int, accuracy double, share_f double")


def json_back(spark, d) -> DataFrame:
    """Vectors through JSON; what isn't finite, alone or inside of an array, comes back as NULL."""
    x = F.element_at("embedding", 1).cast("double")
    bad = F.when(F.col("vec_id") % 7 == 0, float("nan")).when(F.col("vec_id") % 11 == 0, float("inf")).otherwise(x)
    rows = v.table(spark, d, "embeddings").select("vec_id", bad.alias("x"), F.array(bad, x, F.when(F.col("vec_id") % 5 == 0, float("-inf")).otherwise(x)).alias("parts"))
    path = new_folder(spark)
    sinks.write_new_json(rows, path)
    back = spark.read.schema("vec_id bigint, x double, parts array<double>").json(path)
    return back.select("vec_id", "x", F.size("parts").alias("n_parts"), F.size(F.filter("parts", lambda p: p.isNull())).alias("n_null"))


def features_back(spark, d) -> DataFrame:
    """Feature arrays through a table of features."""
    path = new_folder(spark)
    sinks.write_new_table(v.vectors(spark, d).select(F.col("id").alias("sample_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features")), path)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).select("sample_id", F.size("features").alias("width"), F.round(total, 6).alias("total"))


#: Texts in a file of the inventory at most.
FILE_ROWS = 10_000


def file_inventory(spark, d) -> DataFrame:
    """Bytes by folder of the documents' texts as files, found by a recursive scan for their ending in any case."""
    rows, path = v.table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), new_folder(spark)
    # each task writes files of its own for each language, so that no file and no task has all of a language's texts
    rows.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("lang").text(path)
    return tables.read_inventory(spark, path, ("txt",)).groupBy("archive_label").agg(F.sum("bytes").alias("bytes"))


QUERIES = {
    "csv_round_trip": (
        csv_back,
        """SELECT doc_id, nullif(text, '') AS text, ' "' || lang || '"\\ ' AS quoted, CASE WHEN doc_id % 3 = 1 THEN 'x, y' END AS gap, n_chars FROM documents""",
    ),
    "csv_many_files": (many_csv, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "result_files": (result_files, FOLD_METRICS + f" SELECT model, fold, {R('accuracy', 'accuracy')}, {R('share_f', 'share_f')} FROM f"),
    "json_round_trip": (
        json_back,
        f"SELECT vec_id, {R('CASE WHEN vec_id % 7 <> 0 AND vec_id % 11 <> 0 THEN embedding[1]::DOUBLE END', 'x')}, 3::INT AS n_parts, ((vec_id % 7 = 0 OR vec_id % 11 = 0)::INT + (vec_id % 5 = 0)::INT)::INT AS n_null FROM embeddings",
    ),
    "feature_round_trip": (features_back, "SELECT vec_id AS sample_id, len(embedding)::INT AS width, round(list_sum([x::DOUBLE FOR x IN embedding]), 6) + 0.0::DOUBLE AS total FROM embeddings"),
    "file_inventory": (file_inventory, "SELECT 'lang=' || coalesce(lang, 'none') AS archive_label, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes FROM documents GROUP BY 1"),
}
