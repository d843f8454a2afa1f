"""Synthetic impression splits for tests and trial runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HISTORY = 6


def synthetic_split(spark: SparkSession, rows: int, offset: int = 0, users: int = 12, items: int = 24,
                    positive_only: bool = False, seed: int = 2024) -> DataFrame:
    """One row in four is a positive drawn from the user's history; holdouts hold positives only."""
    i = F.col("id")

    def seen(at: Column) -> Column:
        return (F.col("user_id") * 3 + at) % items + 1

    base = spark.range(rows).withColumn("user_id", i % users + 1)
    hit = F.lit(True) if positive_only else i % 4 == 0
    other = (i * 7 + F.col("user_id") + F.pmod(F.xxhash64(F.lit(seed), i), F.lit(items))) % items + 1
    base = base.withColumn("cand_item_id", F.when(hit, seen(i % HISTORY)).otherwise(other))
    hist = F.transform(F.sequence(F.lit(0), F.lit(HISTORY - 1)), seen)
    item = F.col("cand_item_id")
    return base.select(
        (i + offset).alias("impression_id"), F.when(hit, 1.0).otherwise(0.0).alias("label"), "cand_item_id",
        (item % 6 + 1).alias("cand_category"), (item % 5 + 1).alias("cand_brand"), (item % 4 + 1).alias("cand_price_level"),
        F.array_join(hist.cast("array<string>"), ",").alias("clicked_item_seq"),
        F.array_join(F.transform(hist, lambda x: x % 6 + 1).cast("array<string>"), ",").alias("clicked_category_seq"),
        "user_id", (F.col("user_id") % 6 + 1).alias("user_age_level"), (F.col("user_id") % 2 + 1).alias("user_gender"),
        (F.col("user_id") % 3 + 1).alias("device_type"))


def synthetic_splits(spark: SparkSession, train: int = 96, valid: int = 24, test: int = 24, **kw) -> dict[str, DataFrame]:
    return {"train": synthetic_split(spark, train, 0, **kw),
            "valid": synthetic_split(spark, valid, 100_000, positive_only=True, **kw),
            "test": synthetic_split(spark, test, 200_000, positive_only=True, **kw)}
