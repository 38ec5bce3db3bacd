"""Sources: CSV, glob of result files, binary inventories, JSON; ids are never inferred."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import path_parts

#: File name endings of images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
#: The columns of the files that are read.
METADATA = "filepath string, split string, label string, age string, dominant_gender string, dominant_race string"
FOLD_METRICS = "fold int, accuracy double, roc_auc_macro double, kappa double, mcc double, wga_all double, eod_all double, wga_filtered double, eod_filtered double, pooled_groups string"


def read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One or many CSV files with a header and a stated schema; columns are matched by name."""
    return spark.read.csv(paths, header=True, schema=schema, enforceSchema=False, multiLine=True, escape='"')


def read_fold_metrics(spark: SparkSession, pattern: str, schema: str = FOLD_METRICS) -> DataFrame:
    """Result files below a glob, with ``model``: the name of each file's folder."""
    rows = spark.read.csv(pattern, header=True, schema=schema, enforceSchema=True, multiLine=True, escape='"')
    return rows.withColumn("model", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """A recursive scan by ending: sample_id (the path below ``root``), bytes, sha256, content and path parts.

    Spark's file sources leave empty files out; they are added from the listing, which the
    driver holds anyway.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = lambda path: F.regexp_replace(path, r"^file:/+", "/")
    found = files.select(plain(F.col("path")).alias("path"), "length", "content")
    listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").select(plain(F.col("path")).alias("path"))
    empty = listed.join(found.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    every = found.unionByName(empty).filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions))
    inside = F.regexp_replace("path", "^" + re.escape(re.sub(r"^file:/+", "/", root.rstrip("/"))) + "/", "")
    return every.select(inside.alias("sample_id"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content").withColumns(path_parts(F.col("sample_id")))


def read_inventory(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """Files by ending without their content: path parts, size and SHA-256."""
    return scan_files(spark, root, extensions).drop("content")


def class_folders(inventory: DataFrame) -> DataFrame:
    """``inventory`` with ``class_id``: the place of its folder among the sorted folder names.

    Names are counted first and numbered as a table of their own, one row a class.
    """
    names = inventory.select("archive_label").distinct()
    order = Window.orderBy("archive_label")  # of the distinct classes
    numbered = names.select("archive_label", (F.row_number().over(order) - 1).alias("class_id"))
    return inventory.join(numbered, "archive_label").select(*inventory.columns, "class_id")


def read_json_list(spark: SparkSession, path: str) -> list[str]:
    """A JSON array of strings, such as the class list; its order is the order of p_i."""
    text = spark.read.text(path, wholetext=True)
    values = text.select(F.from_json("value", "array<string>").alias("v")).first()["v"]
    if not values or len(set(values)) != len(values) or len(values) < 2:
        raise ValueError("a class list has two or more different names")
    return values


def notebook_outputs(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, cell, text): the text of all outputs of each cell of notebooks stored as JSON."""
    schema = "cells array<struct<outputs:array<struct<text:array<string>,data:map<string,array<string>>>>>>"
    rows = spark.read.schema(schema).json(pattern, multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode("cells").alias("cell", "c"))
    texts = F.transform("c.outputs", lambda o: F.array_join(F.coalesce(o["text"], F.element_at(o["data"], "text/plain"), F.array().cast("array<string>")), ""))
    return rows.select("path", "cell", F.array_join(texts, "\n").alias("text"))


#: The summary that evaluation cells print, and the span of a printed report.
SCALARS = r"--- Overall Scalar Metrics ---\s*Accuracy\s*:\s*([\d.]+)\s*Macro ROC AUC\s*:\s*([\d.]+)\s*Cohen's Kappa\s*:\s*([\d.]+)\s*Matthews CorrCoef\s*:\s*([\d.]+)"


def scalar_metrics(outputs: DataFrame) -> DataFrame:
    """(path, cell, accuracy, auc, kappa, mcc) of each printed summary."""
    found = outputs.select("path", "cell", F.explode(F.regexp_extract_all("text", F.lit(f"({SCALARS})"), F.lit(1))).alias("m"))
    part = lambda i: F.regexp_extract("m", SCALARS, i).cast("double")
    return found.select("path", "cell", part(1).alias("accuracy"), part(2).alias("auc"), part(3).alias("kappa"), part(4).alias("mcc"))


REPORT = r"precision\s+recall\s+f1-score\s+support[\s\S]*?weighted avg[^\n]*"


def notebook_reports(outputs: DataFrame) -> DataFrame:
    """(path, cell, report, text) of each printed classification report; reports of a cell are numbered from 0."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(f"({REPORT})"), F.lit(1)))
    return outputs.select("path", "cell", found.alias("report", "text"))


def report_rows(reports: DataFrame) -> DataFrame:
    """(path, cell, report, cls, precision, recall, f1, support): the lines of printed reports as numbers; accuracy has only f1 and support."""
    line = F.explode(F.split("text", "\n"))
    pattern = r"^\s*(.+?)\s+(?:([\d.]+)\s+([\d.]+)\s+)?([\d.]+)\s+(\d+)\s*$"
    lines = reports.select("path", "cell", "report", line.alias("line")).filter(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    number = lambda i, kind: F.expr(f"try_cast(nullif(p{i}, '') as {kind})")
    cut = lines.select("path", "cell", "report", *[part(i).alias(f"p{i}") for i in range(1, 6)])
    return cut.select("path", "cell", "report", F.col("p1").alias("cls"), number(2, "double").alias("precision"), number(3, "double").alias("recall"), number(4, "double").alias("f1"), number(5, "long").alias("support"))
