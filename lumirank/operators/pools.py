"""Item pools: one row per item, first source wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lumirank.operators.ordering import first_per_key

POOL_SOURCES = {"train": ("train",), "evaluation": ("valid", "test"), "full": ("valid", "test", "train")}


def check_item_columns(df: DataFrame, item: str, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in (item, *columns) if c not in df.columns]
    if missing:
        raise ValueError(f"item source lacks configured columns: {missing}")
    return df.select(item, *columns)


def refuse_null_items(df: DataFrame, item: str) -> DataFrame:
    """Rows with a null item id stop the job when they are reached, in the same pass."""
    guard = F.when(F.col(item).isNull(), F.raise_error(F.lit(f"null item id in {item}"))).otherwise(F.col(item))
    return df.withColumn(item, guard.cast(df.schema[item].dataType))


def build_pool(sources: Sequence[DataFrame], item: str, columns: Sequence[str],
               order: Sequence[str] = ()) -> DataFrame:
    """Union in precedence order, then the first row per item by (source, order, content)."""
    tagged = None
    for i, src in enumerate(sources):
        part = check_item_columns(src, item, [*columns, *[o for o in order if o not in columns]])
        part = part.withColumn("__src", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    pool = first_per_key(refuse_null_items(tagged, item), [item], ["__src", *order])
    return pool.select(item, *columns)


def pool_for(kind: str, splits: dict[str, DataFrame], item: str, columns: Sequence[str],
             order: Sequence[str] = ()) -> DataFrame:
    """train, evaluation (valid, test) or full (valid, test, train) pool."""
    if kind not in POOL_SOURCES:
        raise ValueError(f"unknown pool: {kind}")
    return build_pool([splits[s] for s in POOL_SOURCES[kind]], item, columns, order)


def negatives_pool(splits: dict[str, DataFrame], item: str, columns: Sequence[str], requested: str = "train",
                   order: Sequence[str] = ()) -> DataFrame:
    """Negatives are drawn from train items whatever pool is asked for."""
    return pool_for("train", splits, item, columns, order)


def coverage(data: DataFrame, pool: DataFrame, item: str) -> DataFrame:
    """Distinct data items, how many are in the pool, missing count and percent (100 if no data)."""
    d = data.select(item).filter(F.col(item).isNotNull()).distinct()
    p = pool.select(item).distinct().withColumn("__in", F.lit(1))
    c = d.join(p, item, "left").agg(F.count("*").alias("data_items"), F.count("__in").alias("covered_items"))
    return c.select("data_items", "covered_items", (F.col("data_items") - F.col("covered_items")).alias("missing_items"),
                    F.when(F.col("data_items") > 0, F.col("covered_items") * 100.0 / F.col("data_items"))
                    .otherwise(100.0).alias("coverage_pct"))


def missing_items(data: DataFrame, pool: DataFrame, item: str) -> DataFrame:
    return data.select(item).distinct().join(pool.select(item), item, "left_anti")


def unseen(batch: DataFrame, seen: DataFrame, item: str, order: Sequence[str]) -> DataFrame:
    """First row of each item of a batch that an earlier batch did not bring."""
    return first_per_key(batch.join(seen.select(item), item, "left_anti"), [item], order)


def conform_items(df: DataFrame, dummies: dict[str, str] | None = None) -> DataFrame:
    """Rename item_* to cand_item_*, and add a default score, label and placeholder features."""
    out = df.select([F.col(c).alias(f"cand_{c}" if c.startswith("item_") else c) for c in df.columns])
    out = out.withColumns({"score": F.lit(0.0), "label": F.lit(0)})
    empty = {"numeric": F.lit(0.0), "categorical": F.lit(0), "sequence": F.array(F.lit(0))}     # fixed values
    return out.withColumns({n: empty[t] for n, t in (dummies or {}).items()}) if dummies else out
