"""Sinks that never overwrite and never write NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import table_fingerprint


def _clean(value: Column, kind: T.DataType) -> Column:
    """``value`` with NaN and infinities as NULL at any depth."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.ArrayType) and _fractional(kind):
        return F.transform(value, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType) and _fractional(kind.valueType):
        return F.transform_values(value, lambda _, x: _clean(x, kind.valueType))
    if isinstance(kind, T.StructType) and _fractional(kind):
        parts = F.struct(*[_clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), parts)
    return value


def _fractional(kind: T.DataType) -> bool:
    """Whether a value of this type may hold a NaN outside of a map's keys."""
    if isinstance(kind, T.StructType):
        return any(_fractional(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _fractional(kind.elementType)
    if isinstance(kind, T.MapType):
        return _fractional(kind.valueType)
    return isinstance(kind, T.DoubleType | T.FloatType)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL, in columns and inside of arrays, maps and structs."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_new_csv(df: DataFrame, path: str) -> None:
    """A CSV that ``read_csv`` gives back as it was: quotes are doubled, blanks at the ends stay. CSV has no NULL: '' comes back as one."""
    df.write.mode("errorifexists").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_new_json(df: DataFrame, path: str) -> None:
    """One clean JSON object per row."""
    finite(df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_new_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_run(frames: dict[str, DataFrame], path: str, provenance: dict | None = None, inputs: dict[str, DataFrame] | None = None) -> None:
    """All results of a run below one folder, which must not hold any of them yet.

    With ``provenance`` (run, version, parameters) its JSON row is written last: with the rows and
    an order-free digest of each report, observed in the pass that writes it, and the digest of
    each input table. A report whose write fails leaves no provenance.
    """
    reports = []
    for name, df in frames.items():
        if provenance is None:
            write_new_table(df, f"{path}/{name}")
            continue
        seen = Observation(name)
        row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))
        write_new_table(watched, f"{path}/{name}")
        reports.append((name, seen.get["rows"], seen.get["digest"]))
    if provenance is not None:
        spark = next(iter(frames.values())).sparkSession
        read = [(name, *table_fingerprint(df, df.columns).select("rows", "digest").first()) for name, df in (inputs or {}).items()]
        told = [(provenance["run"], provenance["version"], {k: str(v) for k, v in provenance["parameters"].items() if v is not None}, read, reports)]
        tables = "array<struct<name:string,rows:bigint,digest:string>>"
        write_new_json(spark.createDataFrame(told, f"run string, version string, parameters map<string,string>, inputs {tables}, reports {tables}").coalesce(1), f"{path}/provenance")
