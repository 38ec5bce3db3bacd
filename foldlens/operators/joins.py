"""Joins that state their multiplicity, and look-ups that refuse to guess."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import path_parts
from .contracts import ContractError


def _once(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """``df`` with one row for each key; a key with several fails when it is read."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__r")) if rest else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    text = F.concat(F.lit(f"{side} rows repeat the key "), F.to_json(F.struct(*keys)))
    checked = packed.filter(F.when(F.col("__n") > 1, F.raise_error(text).cast("boolean")).otherwise(True))
    return checked.select(*keys, *([F.col("__r")[c].alias(c) for c in rest] if rest else []))


def attach(left: DataFrame, right: DataFrame, *keys: str, validate: str = "many_to_one", how: str = "left") -> DataFrame:
    """``left`` with ``right``'s columns.

    'many_to_one' wants each key once on the right, 'one_to_one' on both sides. The check
    is part of the join's own aggregation; nothing is read twice.
    """
    if validate not in ("many_to_one", "one_to_one"):
        raise ValueError("validate is 'many_to_one' or 'one_to_one'")
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    if shared:
        raise ContractError(f"columns on both sides: {sorted(shared)}")
    names = list(keys)
    if validate == "one_to_one":
        left = _once(left, names, "left")
    return left.join(_once(right, names, "right"), names, how)


def by_basename(rows: DataFrame, files: DataFrame, path: str, file_path: str) -> DataFrame:
    """``rows`` with ``resolved``: the file whose lower-cased base name is theirs.

    Two files with one base name make the look-up ambiguous, which is an error; a row
    without a file has NULL.
    """
    table = files.select(path_parts(F.col(file_path))["basename"].alias("__base"), F.col(file_path).alias("resolved"))
    found = rows.withColumn("__base", path_parts(F.col(path))["basename"])
    return found.join(_once(table, ["__base"], "file"), "__base", "left").drop("__base")


def align(ids: DataFrame, table: DataFrame, key: str, place: str) -> DataFrame:
    """``table``'s rows in the order of ``ids`` (key, place): a join that carries the order."""
    return ids.select(key, place).join(_once(table, [key], "table"), key, "left").orderBy(place)
