"""Intra-list and pool diversity by counting equal values, never by comparing pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumirank.operators.ordering import top_k
from lumirank.operators.ranking_metrics import REQ, pessimistic_order


def _long(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keep..., feature, value) rows, one per cell. Null and the NaN of a float column match nothing;
    a text that reads NaN is a value like others."""
    def cell(f):
        v = F.col(f).cast("string")
        return F.when(~F.isnan(f), v) if isinstance(df.schema[f].dataType, (T.DoubleType, T.FloatType)) else v

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), cell(f).alias("value")) for f in features])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.feature", "c.value")


def _diversity(rows: Column, matches: Column, n_features: int) -> Column:
    n = rows.cast("double")
    return F.when(rows > 1, 1.0 - matches / (n_features * n * (n - 1))).otherwise(0.0)


def _matches(count: str) -> Column:
    return F.sum(F.when(F.col("value").isNotNull(), F.col(count) * (F.col(count) - 1)).otherwise(0))


def list_diversity(df: DataFrame, features: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Per request 1 - (matching ordered pairs) / (F * m * (m - 1)) over the top m = min(k, n).

    Every top row brings one cell per feature, so m is the cell count over F: one pass, no join.
    """
    ks = sorted({k for k in ks if k > 1})
    top = top_k(df, [REQ], pessimistic_order(), max(ks))
    counts = _long(top, [REQ, "rank"], features).groupBy(REQ, "feature", "value").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"c_{k}") for k in ks])
    width = len(features)
    return counts.groupBy(REQ).agg(*[
        _diversity((F.sum(f"c_{k}") / width).cast("long"), _matches(f"c_{k}"), width).alias(f"diversity_{k}") for k in ks])


def pool_diversity(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Diversity of the whole pool (or of each group) in one counting pass; exact, no sample."""
    by, width = list(by), len(features)
    counts = _long(df, by, features).groupBy(*by, "feature", "value").agg(F.count("*").alias("c"))
    n = (F.sum("c") / width).cast("long")
    aggs = [F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(_diversity(n, _matches("c"), width), F.lit(0.0)).alias("diversity")]
    return counts.groupBy(*by).agg(*aggs) if by else counts.agg(*aggs)


def list_quality(df: DataFrame, group: str, size: int, theta: float = 0.7, eps: float = 1e-6,
                 kernel: str = "gram", gamma: float = 1.0, scores_are_logits: bool = True) -> DataFrame:
    """theta * mean(score) + (1 - theta) * logdet(K + eps*I) / n for each list of `size` rows.

    Input columns: group, item_id, score, embedding. Each list is cut to its first `size`
    rows by score and collected to one row, so a matrix never grows past size x size; a task
    stacks the lists of a batch and takes all their determinants at once.
    """
    if kernel not in ("gram", "rbf", "cosine"):
        raise ValueError(f"unknown kernel: {kernel}")
    top = top_k(df.select(group, "item_id", F.col("score").cast("double"), F.col("embedding").cast("array<double>")),
                [group], [F.col("score").desc(), F.col("item_id").asc()], size, "__k").drop("__k")

    rows = top.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "item_id", "embedding"))).alias("l"))
    lists = rows.select(group, F.transform("l", lambda r: -r["neg"]).alias("s"), F.flatten(F.transform("l", lambda r: r["embedding"])).alias("x"))
    schema = T.StructType([df.schema[group], T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("mean_score", "logdet", "quality")]])

    def run(batches):
        for batch in batches:
            at = np.diff(batch.column(1).offsets.to_numpy())
            score = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            first, wide = np.r_[0, np.cumsum(at)], np.r_[0, np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))]
            mean, logdet = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for n in np.unique(at).tolist():                 # lists of one length are stacked
                of = np.flatnonzero(at == n)
                s = score[first[of][:, None] + np.arange(n)]
                d = int(wide[of[0] + 1] - wide[of[0]])
                x = flat[wide[of][:, None] + np.arange(d)].reshape(len(of), n, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=2, keepdims=True), 1e-12)
                cos = x @ x.transpose(0, 2, 1)
                r = 1.0 / (1.0 + np.exp(-s)) if scores_are_logits else s
                if kernel == "rbf":
                    k = np.exp(-gamma * (2.0 - 2.0 * cos))
                elif kernel == "gram":
                    w = r if scores_are_logits else 1.0 / (1.0 + np.exp(-s))
                    k = w[:, :, None] * w[:, None, :] * cos
                else:
                    k = (1.0 + cos) / 2.0
                sign, det = np.linalg.slogdet(k + eps * np.eye(n))
                mean[of], logdet[of] = r.mean(axis=1), np.where((sign > 0) & np.isfinite(det), det, 0.0) / n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int64)), pa.array(mean), pa.array(logdet), pa.array(theta * mean + (1 - theta) * logdet)],
                                             schema=to_arrow_schema(schema))

    return lists.mapInArrow(run, schema)
