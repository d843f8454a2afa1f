"""Pointwise classification metrics: logloss, AUC, average precision, calibration, slices."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumirank.functions.numeric import clip_prob
from lumirank.operators import ranking_metrics as rm
from lumirank.operators.ordering import quantiles_of, with_global_prefix, with_prefix
from lumirank.session import stable


def logloss_expr(label: Column, pred: Column, neg_weight: float = 1.0, pos_weight: float = 1.0) -> Column:
    p = clip_prob(pred)
    return -(F.lit(pos_weight) * label * F.log(p) + F.lit(neg_weight) * (1.0 - label) * F.log(1.0 - p))


def _score_counts(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score: a partial aggregate, so ties shrink before any sort."""
    pos = (F.col(label) > 0).cast("long")
    return df.groupBy(*by, score).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


def _placed(df: DataFrame, score: str, label: str) -> tuple[DataFrame, int, int]:
    """Score counts by falling score with the positives and negatives above each score."""
    counts = _score_counts(df, [], score, label)
    placed, tot = with_global_prefix(counts, [F.col(score).desc()],
                                     {"pos_above": F.col("pos"), "neg_above": F.col("neg")})
    return placed, tot["pos_above"], tot["neg_above"]


def _auc_aggs(p: int, n: int) -> list[Column]:
    wins = F.sum(F.col("pos") * (F.lit(n) - F.col("neg_above") - 0.5 * F.col("neg")))
    cum_pos, cum_neg = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    ap = F.sum(F.col("pos") * (cum_pos / (cum_pos + cum_neg)))
    none = F.lit(None).cast("double")
    return [F.lit(p + n).cast("long").alias("n"), F.lit(p).cast("long").alias("n_pos"),
            (wins / F.lit(float(p) * n) if p > 0 and n > 0 else none).alias("auc"),
            (ap / F.lit(float(p)) if p else none).alias("average_precision")]


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC-AUC (ties half) and average precision over the whole frame; null for one class."""
    placed, p, n = _placed(df, score, label)
    return placed.agg(*_auc_aggs(p, n))


def _group_auc_rows(df, group, score, label, hot_rows=None, counts=None):
    upper = df if counts is None else None
    counts = _score_counts(df, [group], score, label) if counts is None else counts
    placed = with_prefix(counts, [group], [F.col(score).desc()], {"neg_above": F.col("neg")}, hot_rows, upper)
    g = placed.groupBy(group).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos") * (F.col("neg_above") + 0.5 * F.col("neg"))).alias("lost"))
    pairs = F.col("p") * F.col("n")
    return g.select(group, (F.col("p") + F.col("n")).alias("samples"), "p", "n",
                    F.when(pairs > 0, (pairs - F.col("lost")) / pairs).alias("auc"))


def group_auc(df: DataFrame, group: str, score: str = "score", label: str = "label",
              hot_rows: int | None = None) -> DataFrame:
    """Sample-weighted and plain mean AUC over the groups that have both classes."""
    g = _group_auc_rows(df, group, score, label, hot_rows)
    ok = F.col("auc").isNotNull()
    return g.agg(
        (F.sum(F.col("auc") * F.col("samples")) / F.sum(F.when(ok, F.col("samples")))).alias("gauc"),
        F.avg("auc").alias("avg_auc"),
        F.count_if(ok).alias("gauc_valid_groups"),
        F.coalesce(F.sum(F.when(ok, F.col("samples"))), F.lit(0)).cast("long").alias("gauc_valid_samples"))


def slice_metrics(df: DataFrame, feature: str, score: str = "score", label: str = "label",
                  hot_rows: int | None = None) -> DataFrame:
    """Count, share, AUC (0 for one class) and logloss per value of a feature.

    Values are few and large, so rows are first summed per (value, score), once; the AUC
    then runs on those sums with large values split.
    """
    pos = (F.col(label) > 0).cast("long")
    sums = stable(df.groupBy(feature, score).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"), F.count("*").alias("rows"),
        F.sum(logloss_expr(F.col(label), F.col(score))).alias("loss")))
    a = _group_auc_rows(df, feature, score, label, hot_rows, sums.select(feature, score, "pos", "neg"))
    ll = sums.groupBy(feature).agg(F.sum("rows").alias("count"), (F.sum("loss") / F.sum("rows")).alias("logloss"))
    total = sums.agg(F.sum("rows")).first()[0] or 0
    return (ll.join(a.select(F.col(feature).alias("__f"), "auc"), F.col(feature).eqNullSafe(F.col("__f")), "left")
            .select(feature, "count", (F.col("count") * 100.0 / F.lit(max(total, 1))).alias("ratio"),
                    F.coalesce("auc", F.lit(0.0)).alias("auc"), "logloss"))


def calibration(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    p = clip_prob(F.col(score))
    s = df.agg(F.sum(p).alias("sum_pred"), F.sum(label).alias("sum_label"))
    return s.select("sum_pred", "sum_label",
                    F.when(F.col("sum_label") > 0, F.col("sum_pred") / F.col("sum_label")).alias("pcoc"),
                    F.when(F.col("sum_pred") > 0, F.col("sum_label") / F.col("sum_pred")).alias("copc"))


def pointwise_report(df: DataFrame, score: str = "score", label: str = "label", group: str | None = None,
                     prefix: str = "") -> DataFrame:
    """One row: counts, prediction spread, AUC, AP, logloss, calibration and group AUC."""
    d = stable(df.select(F.col(label).cast("double").alias("__y"), clip_prob(F.col(score)).alias("__p"),
                         *([F.col(group)] if group else [])))
    placed, p, n = _placed(d, "__p", "__y")
    a = placed.agg(*_auc_aggs(p, n)).first()
    q = quantiles_of(placed, "__p", F.lit(p + n) - F.col("pos_above") - F.col("neg_above") - F.col("pos") - F.col("neg"),
                     F.col("pos") + F.col("neg"), p + n, [0.01, 0.5, 0.99])
    extra = {"auc": a["auc"], "prauc": a["average_precision"],
             "pred_p01": q[0.01], "pred_p50": q[0.5], "pred_p99": q[0.99]}
    if group:
        g = group_auc(d, group, "__p", "__y").first()
        extra.update(gauc=g["gauc"], gauc_valid_groups=g["gauc_valid_groups"],
                     gauc_valid_samples=g["gauc_valid_samples"])
    sum_p, sum_y = F.sum("__p"), F.sum("__y")
    base = d.agg(
        F.count("*").alias("sample_count"), F.avg("__y").alias("positive_ratio"),
        F.min("__p").alias("pred_min"), F.avg("__p").alias("pred_mean"), F.max("__p").alias("pred_max"),
        F.avg(logloss_expr(F.col("__y"), F.col("__p"))).alias("logloss"),
        F.when(sum_y > 0, sum_p / sum_y).alias("pcoc"), F.when(sum_p > 0, sum_y / sum_p).alias("copc"))
    out = base.withColumns({k: F.lit(v) for k, v in extra.items()})
    return out.select([F.col(c).alias(prefix + c) for c in out.columns])


def multitask(df: DataFrame, tasks: dict[str, tuple[str, str]]) -> DataFrame:
    """AUC and logloss per task (label, score columns), and their mean in row `all`."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(y).cast("double").alias("label"), F.col(s).cast("double").alias("score"))
        for t, (y, s) in tasks.items()])).alias("r")).select("r.*")
    per = slice_metrics(stacked, "task").select("task", "auc", "logloss")
    mean = per.agg(F.lit("all").alias("task"), F.avg("auc").alias("auc"), F.avg("logloss").alias("logloss"))
    return per.unionByName(mean)


_NDCG = re.compile(r"NDCG(?:\(([1-9]\d*)\)|@([1-9]\d*))?")


def resolve_metric(name: str) -> tuple[str, int | None]:
    """Known metric names only; names are parsed, never evaluated."""
    if name in ("logloss", "binary_crossentropy", "AUC", "gAUC", "avgAUC", "MRR"):
        return name, None
    m = _NDCG.fullmatch(name) if isinstance(name, str) else None
    if m:
        return "NDCG", int(m.group(1) or m.group(2) or 1)
    raise NotImplementedError(f"metric not supported: {name!r}")


def _group_metrics(d: DataFrame, group: str, ks: Sequence[int], hot_rows: int | None) -> dict:
    """gAUC, avgAUC, MRR and NDCG@k of all groups from one ranking of the rows.

    Rows are placed once per group by falling score, positives last within equal scores; sums per
    (group, score) then give every metric. The ideal order needs only the counts of each label.
    """
    pos = (F.col("label") > 0).cast("long")
    placed = with_prefix(d, [group], rm.pessimistic_order(), {"__before": F.lit(1).cast("long"), "__neg": 1 - pos}, hot_rows)
    place = F.col("__before") + 1
    gain = F.pow(F.lit(2.0), F.col("label")) - 1.0
    same = placed.groupBy(group, "score").agg(
        F.sum(pos).alias("p"), F.count("*").alias("n"), F.min("__neg").alias("nb"), F.sum("label").alias("y"),
        F.sum(F.col("label") / place).alias("rr"),
        *[F.sum(F.when(place <= k, gain / F.log2(place + 1.0)).otherwise(0.0)).alias(f"dcg_{k}") for k in ks])
    g = same.groupBy(group).agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("rr").alias("rr"),
        F.sum(F.col("p") * (F.col("nb") + 0.5 * (F.col("n") - F.col("p")))).alias("lost"), *[F.sum(f"dcg_{k}").alias(f"dcg_{k}") for k in ks])
    if ks:
        counts = d.groupBy(group, "label").agg(F.count("*").alias("c"))
        ahead = with_prefix(counts, [group], [F.col("label").desc()], {"__ahead": F.col("c")}, hot_rows)
        best = ahead.groupBy(group).agg(*[
            F.sum(gain * (rm.ideal_dcg(F.col("__ahead") + F.col("c"), k) - rm.ideal_dcg(F.col("__ahead"), k))).alias(f"best_{k}") for k in ks])
        best = best.withColumnRenamed(group, "__g")
        g = g.join(best, F.col(group).eqNullSafe(F.col("__g")))
    neg = F.col("n") - F.col("p")
    one = F.when((F.col("p") > 0) & (neg > 0), (F.col("p") * neg - F.col("lost")) / (F.col("p") * neg))
    return g.withColumn("__auc", one).agg(
        (F.sum(F.col("__auc") * F.col("n")) / F.sum(F.when(F.col("__auc").isNotNull(), F.col("n")))).alias("gAUC"),
        F.avg("__auc").alias("avgAUC"), F.avg(F.col("rr") / (F.col("y") + 1e-12)).alias("MRR"),
        *[F.avg(F.col(f"dcg_{k}") / (F.col(f"best_{k}") + 1e-12)).alias(f"NDCG@{k}") for k in ks]).first().asDict()


def evaluate(df: DataFrame, metrics: Sequence[str], group: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """Long table (metric, value) of the named metrics. The rows are written once; all group metrics
    share one ranking, and AUC is made from one count per score."""
    parsed = [(m, *resolve_metric(m)) for m in metrics]
    grouped = {kind for _, kind, _ in parsed} & {"gAUC", "avgAUC", "MRR", "NDCG"}
    if group is None and grouped:
        raise ValueError("group metrics need a group column")
    d = stable(df.select(*([group] if grouped else []), *([rm.ITEM] if grouped else []), "score", "label"))
    values: dict[tuple, float | None] = {}
    if grouped:
        ks = sorted({k for _, kind, k in parsed if kind == "NDCG"})
        got = _group_metrics(d, group, ks, hot_rows)
        values.update({(n.split("@")[0], int(n.split("@")[1]) if "@" in n else None): v for n, v in got.items()})
    kinds = {kind for _, kind, _ in parsed}
    if "AUC" in kinds:
        values["AUC", None] = auc(d).first()["auc"]
    if kinds & {"logloss", "binary_crossentropy"}:
        loss = d.agg(F.avg(logloss_expr(F.col("label"), F.col("score")))).first()[0]
        values["logloss", None] = values["binary_crossentropy", None] = loss
    return df.sparkSession.createDataFrame([(name, values[kind, k]) for name, kind, k in parsed], "metric string, value double")


def global_auc_at_k(ranked: DataFrame, k: int, score: str = "score", label: str = "label") -> DataFrame:
    """AUC over the union of the top-K lists that hold a positive."""
    from lumirank.operators.ordering import top_k
    top = top_k(ranked, [rm.REQ], rm.pessimistic_order(score, label), k, "__k")
    good = top.groupBy(rm.REQ).agg(F.max(label).alias("__best")).filter(F.col("__best") > 0).select(rm.REQ)
    return auc(top.join(good, rm.REQ, "left_semi"), score, label)
