"""Dataset profiles: split counts, id frequencies, label and numeric summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lumirank.functions.numeric import is_close, is_finite, ratio

TOL = 1e-12


def _profile_aggs(label: str, keys: Sequence[str]) -> list[Column]:
    pos = F.count_if(F.col(label) > 0)
    return [F.count("*").alias("rows"), pos.alias("positive_rows"), ratio(pos, F.count("*")).alias("positive_rate"),
            *[F.count_if(F.col(k).isNull()).alias(f"missing_{k}") for k in keys]]


def split_profile(df: DataFrame, label: str, keys: Sequence[str], split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(*_profile_aggs(label, keys))


def combined_profile(df: DataFrame, label: str, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Per split and over all splits in one pass (rollup); the total row is `all`."""
    out = df.rollup(split).agg(F.grouping(split).alias("__g"), *_profile_aggs(label, keys))
    return out.withColumn(split, F.when(F.col("__g") == 1, "all").otherwise(F.col(split))).drop("__g")


def label_aggs(label: Column) -> list[Column]:
    """Label distribution aggregates. Text labels are tried as numbers."""
    x = label.try_cast("double")
    fin = label.isNotNull() & x.isNotNull() & is_finite(x)
    v = F.when(fin, x)
    zero, one = is_close(v, 0.0, TOL), is_close(v, 1.0, TOL)
    n = F.count(v)
    return [n.alias("count"), F.count_if(label.isNull()).alias("missing_count"),
            F.count_if(label.isNotNull() & x.isNull()).alias("non_numeric_count"),
            F.count_if(label.isNotNull() & x.isNotNull() & ~is_finite(x)).alias("non_finite_count"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
            F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.count_if(zero).alias("zero_count"),
            F.count_if(one).alias("one_count"), F.count_if(v > 0).alias("positive_count_gt0"),
            F.count_if(v < 0).alias("negative_count_lt0"), F.count_if(~(zero | one)).alias("non_binary_count"),
            ratio(F.count_if(v > 0), n).alias("positive_rate_gt0"), ratio(F.count_if(one), n).alias("positive_rate_eq1"),
            ratio(F.count_if(~(zero | one)), n).alias("non_binary_rate")]


def label_distribution(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    aggs = label_aggs(F.col(label))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def id_frequencies(df: DataFrame, sides: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """(side, id, n): rows per id for several id columns in one pass."""
    cells = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).cast("string").alias("id")) for s, c in sides.items()])
    return (df.select(*by, F.explode(cells).alias("c")).select(*by, "c.side", "c.id").filter("id is not null")
            .groupBy(*by, "side", "id").agg(F.count("*").alias("n")))


def side_stats(freq: DataFrame, by: Sequence[str] = ("side",), qs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Unique ids, events, and min/max/mean/nearest-rank percentiles of events per id.

    Percentiles run on counts of counts: m ids with distinct counts need m(m+1)/2 rows,
    so a group of N rows has at most sqrt(2N) of them to sort.
    """
    by = list(by)
    cc = freq.groupBy(*by, "n").agg(F.count("*").alias("ids"))
    upto = W.partitionBy(*by).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    placed = cc.select("*", F.coalesce(F.sum("ids").over(upto), F.lit(0)).alias("before"),
                       F.sum("ids").over(W.partitionBy(*by)).alias("total"))
    def at(q):
        i = F.rint((F.col("total") - 1) * F.lit(float(q)))
        return F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("ids")), F.col("n")))
    events = F.sum(F.col("n") * F.col("ids"))
    return placed.groupBy(*by).agg(
        F.sum("ids").alias("unique_ids"), events.alias("total_events"), F.min("n").alias("min"), F.max("n").alias("max"),
        (events / F.sum("ids")).alias("mean"), *[at(q).alias(f"p{int(q * 100)}") for q in qs])


def top_ids(freq: DataFrame, k: int, by: Sequence[str] = ("side",)) -> DataFrame:
    """The k most frequent ids per side, ties by id."""
    from lumirank.operators.ordering import top_k
    return top_k(freq, list(by), [F.desc("n"), F.asc("id")], k)


def item_popularity(df: DataFrame, item: str, label: str | None = None) -> DataFrame:
    """(item, popularity) over all rows or positive rows; counts are combined before the shuffle."""
    src = df.filter(F.col(label) > 0) if label else df
    return src.groupBy(item).agg(F.count("*").alias("popularity"))


def numeric_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).select("c.*")


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows, min, max, mean, sample std per column in one scan without unpivoting rows."""
    cells = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("rows"), F.min(c).cast("double").alias("min"),
                      F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
             for c in columns]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def finite_stats(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Finite-aware stats per column; `top` keeps the columns with the largest absolute value."""
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        v = F.when(is_finite(x), x)
        cells.append(F.struct(F.lit(c).alias("feature"), F.count("*").alias("rows"), F.count(v).alias("finite"),
                              F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
                              F.stddev_pop(v).alias("std"), F.max(F.abs(v)).alias("abs_max")))
    out = df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return out.orderBy(F.desc("abs_max"), "feature").limit(top) if top else out


def infer_encoded_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per encoded column: kind, min and max id, longest array, and vocabulary size (max id + 1)."""
    cells = []
    for c in columns:
        if isinstance(df.schema[c].dataType, T.ArrayType):
            lo, hi, width, kind = F.min(F.array_min(c)), F.max(F.array_max(c)), F.max(F.size(c)), "sequence"
        elif isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            cells.append(F.struct(F.lit(c).alias("feature"), F.lit("numeric").alias("type"), F.lit(None).cast("long").alias("min_id"),
                                  F.lit(None).cast("long").alias("max_id"), F.lit(1).cast("long").alias("max_len"),
                                  F.lit(None).cast("long").alias("vocab_size")))
            continue
        else:
            lo, hi, width, kind = F.min(c), F.max(c), F.lit(1), "categorical"
        cells.append(F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("type"), lo.cast("long").alias("min_id"),
                              hi.cast("long").alias("max_id"), width.cast("long").alias("max_len"),
                              (hi.cast("long") + 1).alias("vocab_size")))
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def best_run(metrics: DataFrame, run: str, metric: str, weights: dict[str, float]) -> DataFrame:
    """Wide table of runs with their weighted monitor value, and the best run flagged."""
    names = sorted(weights)
    wide = metrics.groupBy(run).pivot(metric, names).agg(F.max("value"))
    monitor = sum((F.coalesce(F.col(n), F.lit(0.0)) * F.lit(float(weights[n])) for n in names), F.lit(0.0))
    wide = wide.withColumn("monitor", monitor)
    best = wide.orderBy(F.desc("monitor"), run).limit(1).select(F.col(run).alias("__b"))
    return (wide.join(F.broadcast(best), F.col(run) == F.col("__b"), "left")
            .withColumn("is_best", F.col("__b").isNotNull().cast("int")).drop("__b"))
