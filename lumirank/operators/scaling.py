"""Numeric normalisers, bucket boundaries and column narrowing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumirank.operators.ordering import exact_quantiles


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str) -> dict[str, tuple[float, float]]:
    """(shift, scale) per column in one pass; nulls are left out. Zero spread scales by 1."""
    if kind == "StandardScaler":
        stats = df.agg(*[F.avg(c).alias(f"{c}__a") for c in columns], *[F.stddev_pop(c).alias(f"{c}__b") for c in columns])
    elif kind == "MinMaxScaler":
        stats = df.agg(*[F.min(c).cast("double").alias(f"{c}__a") for c in columns],
                       *[(F.max(c) - F.min(c)).cast("double").alias(f"{c}__b") for c in columns])
    else:
        raise NotImplementedError(f"normalizer={kind}")
    row = stats.first()
    return {c: (row[f"{c}__a"] or 0.0, row[f"{c}__b"] or 1.0) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(a)) / F.lit(b) for c, (a, b) in fitted.items()})


def normalize(df: DataFrame, columns: Sequence[str], normalizer: str | Callable[[Column], Column]) -> DataFrame:
    if callable(normalizer):
        return df.withColumns({c: normalizer(F.col(c)) for c in columns})
    return scale(df, fit_scaler(df, columns, normalizer))


def quantile_boundaries(df: DataFrame, column: str, buckets: int) -> list[float]:
    qs = [i / buckets for i in range(1, buckets)]
    got = exact_quantiles(df, column, qs)
    return [got[q] for q in qs]


def narrow_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest integer type that holds each column; doubles become floats when in range."""
    ints = [c for c in columns if isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    floats = [c for c in columns if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    row = df.agg(*[F.min(c).alias(f"{c}__lo") for c in ints + floats], *[F.max(c).alias(f"{c}__hi") for c in ints + floats]).first()
    casts = {}
    for c in ints:
        lo, hi = row[f"{c}__lo"], row[f"{c}__hi"]
        if lo is None:
            continue
        for bits, name in ((7, "tinyint"), (15, "smallint"), (31, "int")):
            if -(1 << bits) <= lo and hi < (1 << bits):
                casts[c] = F.col(c).cast(name)
                break
    for c in floats:
        lo, hi = row[f"{c}__lo"], row[f"{c}__hi"]
        if lo is not None and max(abs(lo), abs(hi)) < 3.4e38:
            casts[c] = F.col(c).cast("float")
    return df.withColumns(casts) if casts else df
