"""Nested-delimiter click logs: a skeleton of samples and shared feature bundles.

Skeleton line: sample, click, purchase, bundle id, feature count, features.
Bundle line:   bundle id, feature count, features.
Features are field/id/value triples with control characters between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumirank.functions.text import append_capped
from lumirank.operators.filters import drop_inconsistent_conversions

# fixed values
BETWEEN, AFTER_FIELD, AFTER_ID = "\x01", "\x02", "\x03"
ABSENT = "0"


def triples(text: Column) -> Column:
    """array<struct<field, id, value>>"""
    def one(t: Column) -> Column:
        field, rest = F.split_part(t, F.lit(AFTER_FIELD), F.lit(1)), F.split_part(t, F.lit(AFTER_FIELD), F.lit(2))
        return F.struct(field.alias("field"), F.split_part(rest, F.lit(AFTER_ID), F.lit(1)).alias("id"),
                        F.split_part(rest, F.lit(AFTER_ID), F.lit(2)).alias("value"))
    return F.transform(F.split(text, BETWEEN, -1), one)


def read_skeleton(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", ",", -1)
    return spark.read.text(path).select(p[0].alias("sample"), p[1].cast("int").alias("click"), p[2].cast("int").alias("purchase"),
                                        p[3].alias("bundle"), triples(p[5]).alias("own"))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", ",", -1)
    return spark.read.text(path).select(p[0].alias("bundle"), triples(p[2]).alias("shared"))


def _values(arr: Column, field: str, part: str, cap: int | None) -> Column:
    got = F.transform(F.filter(arr, lambda t: t["field"] == field), lambda t: t[part])
    return append_capped(got, cap) if cap else got


def convert(skeleton: DataFrame, bundles: DataFrame, sparse: Sequence[str], dense: Sequence[str],
            max_values: int | None = None) -> DataFrame:
    """One row per sample: click, purchase, and one column per field (dense fields get a D prefix).

    A field in the shared bundle replaces the sample's own. A bundle id that no bundle has
    stops the job. Several values of a field are joined by `^`, the first `max_values` if given.
    """
    j = drop_inconsistent_conversions(skeleton).join(bundles, "bundle", "left")
    shared = F.when(F.col("shared").isNull(), F.raise_error(F.concat(F.lit("no feature bundle "), F.col("bundle")))
                    .cast(bundles.schema["shared"].dataType)).otherwise(F.col("shared"))
    j = j.withColumn("shared", shared)
    cols = []
    for names, part, prefix in ((sparse, "id", ""), (dense, "value", "D")):
        for f in names:
            theirs, own = _values(F.col("shared"), f, part, max_values), _values(F.col("own"), f, part, max_values)
            got = F.when(F.size(theirs) > 0, theirs).otherwise(own)
            cols.append(F.when(F.size(got) > 0, F.array_join(got, "^")).otherwise(F.lit(ABSENT)).alias(prefix + f))
    return j.select("sample", "click", "purchase", *cols)
