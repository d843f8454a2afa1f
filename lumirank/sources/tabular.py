"""Scans and sinks of split tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lumirank.functions.text import join_tokens, tokens
from lumirank.schema import FeatureSpec, require_columns, resolve_dtype


def csv_schema(specs: Sequence[FeatureSpec], extra: dict[str, str] | None = None) -> T.StructType:
    fields = [T.StructField(n, resolve_dtype(t, n)) for n, t in (extra or {}).items()]
    return T.StructType(fields + [T.StructField(s.name, resolve_dtype(s.dtype, s.name)) for s in specs])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",",
             n_rows: int | None = None) -> DataFrame:
    """A file, a folder or several paths, typed by the schema. `n_rows` limits the whole read.

    Columns are matched to the schema by header name, so a schema may name fewer columns
    than the file has and give them in any order.
    """
    names = spark.read.csv(path, sep=sep, header=True, inferSchema=False).columns
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    by_name = {f.name: f for f in want.fields}
    missing = [n for n in by_name if n not in names]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    full = T.StructType([by_name.get(n, T.StructField(n, T.StringType())) for n in names])
    df = spark.read.schema(full).csv(path, sep=sep, header=True).select(*by_name)
    return df.limit(n_rows) if n_rows else df


def read_parquet(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None,
                 splits: dict[str, str] | None = None, n_rows: int | None = None) -> DataFrame:
    """Pruned scan with a column check. Text columns named in `splits` become arrays."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    if columns is not None:
        df = require_columns(df, list(columns))
    for c, sep in (splits or {}).items():
        if isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, tokens(F.col(c), sep))
    return df.limit(n_rows) if n_rows else df


def export_text_lists(df: DataFrame, sep: str = "^") -> DataFrame:
    """Array columns as joined text, for formats without arrays."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: join_tokens(F.col(c), sep) for c in lists}) if lists else df


def read_split(spark: SparkSession, root: str, split: str, fmt: str = "parquet",
               columns: Sequence[str] | None = None, schema=None) -> DataFrame:
    """One split table by naming convention."""
    path = f"{root}/{split}.{fmt}"
    if fmt == "parquet":
        return read_parquet(spark, path, columns)
    if fmt == "csv":
        return read_csv(spark, path, schema)
    if fmt == "tfrecord":
        from lumirank.sources.tfrecord import read_tfrecord
        return read_tfrecord(spark, path, schema)
    raise ValueError(f"data format {fmt!r} is not supported")


def read_model_inputs(spark: SparkSession, path: str, features: Sequence[str], labels: Sequence[str],
                      request: str, item: str) -> DataFrame:
    """Strict scan for training or scoring: features, labels and the request id must all exist."""
    return read_parquet(spark, path, list(dict.fromkeys([*labels, request, item, *features])))


def write_split(df: DataFrame, path: str, mode: str = "overwrite", expected: int | None = None) -> int:
    """Write one encoded split and return the rows its files hold (counted from their footers).

    The job commits all files or none: a folder without its success mark, or with another
    count than expected, is refused.
    """
    from lumirank.sources.files import exists
    df.write.mode(mode).parquet(path)
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        raise RuntimeError(f"{path} was not written completely")
    return checked_rows(df.sparkSession.read.parquet(path), expected, path)


def checked_rows(df: DataFrame, expected: int | None, path: str) -> int:
    stored = df.count()
    if expected is not None and stored != expected:
        raise RuntimeError(f"{path} holds {stored} rows, {expected} were expected")
    return stored


def write_sample(df: DataFrame, path: str, n_rows: int) -> None:
    df.limit(n_rows).write.mode("overwrite").parquet(path)
