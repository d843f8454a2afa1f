"""Ranking and agreement losses as offline aggregates over scored rows.

Pairwise losses take one row per anchor and negative (anchor, pos_score, neg_score):
each anchor keeps its own drawn negatives, so the work is linear in the rows given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumirank.functions.numeric import sigmoid, softplus


def bpr(pos: Column, neg: Column) -> Column:
    return softplus(neg - pos)


def margin(pos: Column, neg: Column, gap: float = 1.0) -> Column:
    return F.greatest(F.lit(float(gap)) - pos + neg, F.lit(0.0))


def pairwise_losses(pairs: DataFrame, anchor: str, gap: float = 1.0) -> DataFrame:
    """Mean BPR and hinge per pair, and mean softmax cross-entropy per anchor."""
    pos, neg = F.col("pos_score"), F.col("neg_score")
    # the largest margin of an anchor keeps exp() in range; same exchange as the groupBy below
    top = F.greatest(F.lit(0.0), F.max(neg - pos).over(W.partitionBy(anchor)))
    per = pairs.withColumn("__top", top).groupBy(anchor).agg(
        F.sum(bpr(pos, neg)).alias("bpr"), F.sum(margin(pos, neg, gap)).alias("hinge"), F.count("*").alias("n"),
        (F.max("__top") + F.log(F.exp(-F.max("__top")) + F.sum(F.exp(neg - pos - F.col("__top"))))).alias("softmax_ce"))
    return per.agg(F.sum("n").alias("pairs"), F.count("*").alias("anchors"),
                   (F.sum("bpr") / F.sum("n")).alias("bpr"), (F.sum("hinge") / F.sum("n")).alias("hinge"),
                   F.avg("softmax_ce").alias("softmax_ce"))


def bernoulli_kl(student: Column, teacher: Column, temperature: float = 1.0) -> Column:
    """KL(teacher || student) of two logits at a temperature, times its square."""
    s, t = student / float(temperature), teacher / float(temperature)
    q = sigmoid(t)
    kl = (softplus(s) - q * s) - (softplus(t) - q * t)
    return F.greatest(kl, F.lit(0.0)) * float(temperature) ** 2


def agreement_losses(df: DataFrame, student: str, teacher: str, temperature: float = 1.0) -> DataFrame:
    """MSE, Bernoulli KL and cosine distance between two logit columns."""
    if not temperature > 0 or temperature == float("inf"):
        raise ValueError(f"temperature must be finite and > 0, got {temperature!r}")
    s, t = F.col(student), F.col(teacher)
    dot, ss, tt = F.sum(s * t), F.sum(s * s), F.sum(t * t)
    return df.agg(F.avg((s - t) * (s - t)).alias("mse"),
                  F.avg(bernoulli_kl(s, t, temperature)).alias("kl"),
                  (1.0 - dot / (F.greatest(F.sqrt(ss), F.lit(1e-8)) * F.greatest(F.sqrt(tt), F.lit(1e-8))))
                  .alias("cosine_distance"))
