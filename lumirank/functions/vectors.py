"""Array-of-float expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    size = F.greatest(norm(a), F.lit(eps))
    return F.transform(_double(a), lambda x: x / size)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def similarity(a: Column, b: Column, temperature: float = 1.0, sigmoid: bool = False) -> Column:
    from lumirank.functions.numeric import sigmoid as squash
    s = dot(a, b) / F.lit(float(temperature))
    return squash(s) if sigmoid else s


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine moved to [0, 1]."""
    return (1.0 + cosine(a, b)) / 2.0


def k_max_places(arr: Column, k: int) -> Column:
    """Places (from 1, ascending) of the k largest values; of equal values the earlier stay. NaN is the largest, nulls come last."""
    keyed = F.transform(arr, lambda x, i: F.struct(x.alias("val"), (-i).alias("back")))
    return F.array_sort(F.transform(F.slice(F.sort_array(keyed, asc=False), 1, k), lambda s: 1 - s["back"]))


def k_max(arr: Column, k: int) -> Column:
    """The k largest values in their original order; of equal values the earlier stay."""
    return F.transform(k_max_places(arr, k), lambda p: F.get(arr, p - 1))