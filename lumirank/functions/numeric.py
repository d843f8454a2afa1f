"""Numeric expressions: logits, ratios, buckets, calendar parts, popularity priors."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# fixed values
PROB_EPS = 1e-7
SIGMOID_LIMIT = 50.0
STD_EPS = 1e-12


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def clip_prob(p: Column) -> Column:
    return clip(p, PROB_EPS, 1.0 - PROB_EPS)


def safe_logit(p: Column) -> Column:
    c = clip_prob(p)
    return F.log(c / (1.0 - c))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -SIGMOID_LIMIT, SIGMOID_LIMIT)))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def is_close(x: Column, target: float, tol: float = 1e-12) -> Column:
    return F.abs(x - target) <= tol


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | x.isin(float("inf"), float("-inf")))


def log_square_bucket(x: Column) -> Column:
    """Values above 2 go to floor(ln(x)^2); smaller ones keep their integer part."""
    return F.when(x > 2, F.floor(F.pow(F.log(x.cast("double")), 2.0))).otherwise(x.cast("long")).cast("long")


def _coded_date(col: Column) -> Column:
    return F.to_date(F.concat(F.lit("20"), F.substring(col, 1, 6)), "yyyyMMdd")


def coded_weekday(col: Column) -> Column:
    """0 = Sunday, from YYMMDDHH text."""
    return (F.dayofweek(_coded_date(col)) - 1).cast("int")


def coded_weekend(col: Column) -> Column:
    return coded_weekday(col).isin(0, 6).cast("int")


def coded_hour(col: Column) -> Column:
    return F.substring(col, 7, 2).cast("int")


def hash_bucket(col: Column, buckets: int, hash_of=F.xxhash64) -> Column:
    return F.pmod(hash_of(col), F.lit(buckets)).cast("int")


def quantile_bucket(col: Column, boundaries: list[float]) -> Column:
    """Number of boundaries at or below the value."""
    edges = F.array(*[F.lit(float(b)) for b in boundaries])
    return F.when(col.isNotNull(), F.size(F.filter(edges, lambda b: b <= col))).cast("int")


def stable_id(col: Column) -> Column:
    """Non-negative 60-bit id of a text, the first 15 digits of its md5; empty and null text has id -1."""
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(-1).cast("long")).otherwise(
        F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("long"))


def blake_id(col: Column) -> Column:
    """Non-negative 63-bit id of a text: the first 8 bytes of its blake2b, little endian, without the sign bit; empty
    and null text has id -1. Arrow batches; each distinct text of a batch is hashed once."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("long")
    def ids(texts: pd.Series) -> pd.Series:
        codes, values = pd.factorize(texts)
        hashed = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") & 0x7FFFFFFFFFFFFFFF if v else -1 for v in values]
        return pd.Series([-1, *hashed], dtype="int64").take(codes + 1).reset_index(drop=True)

    return ids(col.cast("string"))


def popularity_transform(count: Column, transform: str = "log1p") -> Column:
    x = count.cast("double")
    x = F.when(x.isNull() | ~is_finite(x), F.lit(0.0)).otherwise(x)
    if transform in ("log", "log1p"):
        return F.log1p(F.greatest(x, F.lit(0.0)))
    if transform == "sqrt":
        return F.sqrt(F.greatest(x, F.lit(0.0)))
    if transform in ("raw", "none"):
        return x
    raise ValueError(f"unknown popularity transform: {transform}")


def popularity_stats(df: DataFrame, count_col: str, transform: str = "log1p") -> dict:
    """Mean, population std, min, max, max-abs of the transformed counts (one row)."""
    x = popularity_transform(F.col(count_col), transform)
    row = df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"),
                 F.max(x).alias("max"), F.max(F.abs(x)).alias("maxabs")).first()
    return {k: float(v) if v is not None else 0.0 for k, v in row.asDict().items()}


def popularity_prior(count: Column, stats: dict, transform: str = "log1p",
                     normalize: str = "zscore") -> Column:
    x = popularity_transform(count, transform)
    if normalize in ("zscore", "standard", "standardize"):
        return (x - stats["mean"]) / stats["std"] if stats["std"] > STD_EPS else x
    if normalize in ("max", "maxabs"):
        return x / stats["maxabs"] if stats["maxabs"] > STD_EPS else x
    if normalize == "minmax":
        span = stats["max"] - stats["min"]
        return (x - stats["min"]) / span if span > STD_EPS else x
    if normalize in ("none", "raw"):
        return x
    raise ValueError(f"unknown popularity normalisation: {normalize}")


def blend_logit(logit: Column, prior: Column, weight: float) -> Column:
    return logit + F.lit(float(weight)) * prior


def laplace_noise(uniform: Column, scale: float) -> Column:
    """Inverse-CDF Laplace draw from a uniform in (0, 1)."""
    u = uniform - 0.5
    return -F.lit(float(scale)) * F.signum(u) * F.log1p(-2.0 * F.abs(u))


def hash_uniform(*key: Column) -> Column:
    """Uniform in (0, 1) from a hash of the key: the same row always draws the same."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
