"""Per-request ranking metrics and their averages.

Ties follow the pessimistic order: among equal scores positives come last.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumirank.operators.ordering import with_prefix

REQ, ITEM, SCORE, LABEL = "request_id", "item_id", "score", "label"


def pessimistic_order(score: str = SCORE, label: str = LABEL, item: str = ITEM) -> list[Column]:
    return [F.col(score).desc(), F.col(label).asc(), F.col(item).asc()]


def ranked(df: DataFrame, score: str = SCORE, tie: str = "pessimistic", seed: int = 0,
           hot_rows: int | None = None, extra: dict[str, Column] | None = None,
           upper: DataFrame | None = None) -> DataFrame:
    """Add `rank`, `pos` (0/1), `neg_before` (negatives placed ahead of the row) and further running sums.

    `upper`: a cheaper frame with at least as many rows per request, for the check of hot requests.
    """
    flagged = df.withColumn("pos", (F.coalesce(F.col(LABEL), F.lit(0)) > 0).cast("long"))
    if tie == "pessimistic":
        order = [F.col(score).desc(), F.col("pos").asc(), F.col(ITEM).asc()]
    elif tie == "seeded":
        order = [F.col(score).desc(), F.xxhash64(F.lit(seed), F.col(REQ), F.col(ITEM)).asc(), F.col(ITEM).asc()]
    else:
        raise ValueError(f"unknown tie rule: {tie}")
    out = with_prefix(flagged, [REQ], order,
                      {"__rows": F.lit(1).cast("long"), "__pos": F.col("pos"), **(extra or {})}, hot_rows, upper)
    return (out.withColumn("rank", F.col("__rows") + 1)
            .withColumn("neg_before", F.col("__rows") - F.col("__pos"))
            .drop("__rows", "__pos"))


def ideal_dcg(n_pos: Column, k: int) -> Column:
    """Sum of 1/log2(i+1) for i = 1..min(n_pos, k); the table depends on k alone."""
    total, table = 0.0, [0.0]
    for i in range(1, k + 1):
        total += 1.0 / math.log2(i + 1)
        table.append(total)
    return F.element_at(F.array(*[F.lit(v) for v in table]), F.least(n_pos, F.lit(k)).cast("int") + 1)


def per_request(df: DataFrame, ks: Sequence[int], score: str = SCORE, top_k: int | None = None,
                restrict: str | None = None, tie: str = "pessimistic",
                hot_rows: int | None = None, upper: DataFrame | None = None) -> DataFrame:
    """One row per request: n, n_pos, mrr, gauc, recall@k, ndcg@k, and mrr/gauc within top_k.

    With `restrict` (a boolean column) Recall and nDCG rank only the flagged rows while
    MRR and gAUC keep the whole pool; Recall still divides by the positives of the pool.
    """
    extra = {"__kept": F.col(restrict).cast("long")} if restrict else None
    rows = ranked(df, score, tie, hot_rows=hot_rows, extra=extra, upper=upper)
    rank_for_k = F.when(F.col(restrict), F.col("__kept") + 1) if restrict else F.col("rank")
    is_pos = F.col("pos") == 1

    # Equal scores are summed first. Negatives scored strictly higher are those ahead of
    # the first row of a tie, whatever the order inside it; tied negatives cost one half.
    aggs = [F.count("*").alias("n"), F.sum("pos").alias("p"), F.min("neg_before").alias("nb"),
            F.min(F.when(is_pos, F.col("rank"))).alias("first")]
    for k in ks:
        hit = is_pos & (rank_for_k <= k)
        aggs += [F.sum(F.when(hit, 1).otherwise(0)).alias(f"hits_{k}"),
                 F.sum(F.when(hit, 1.0 / F.log2(rank_for_k + 1.0)).otherwise(0.0)).alias(f"dcg_{k}")]
    if top_k:
        inside = F.col("rank") <= top_k
        aggs += [F.sum(F.when(inside, 1).otherwise(0)).alias("n_in"),
                 F.sum(F.when(inside, F.col("pos")).otherwise(0)).alias("p_in")]
    by_score = rows.groupBy(REQ, score).agg(*aggs)

    def lost(p, n):
        return F.sum(F.col(p) * (F.col("nb") + 0.5 * (F.col(n) - F.col(p))))

    outer = [F.sum("n").alias("n"), F.sum("p").alias("n_pos"), F.min("first").alias("first"),
             lost("p", "n").alias("lost")]
    for k in ks:
        outer += [F.sum(f"hits_{k}").alias(f"hits_{k}"), F.sum(f"dcg_{k}").alias(f"dcg_{k}")]
    if top_k:
        outer += [F.sum("n_in").alias("n_in"), F.sum("p_in").alias("p_in"), lost("p_in", "n_in").alias("lost_in")]
    g = by_score.groupBy(REQ).agg(*outer)

    n_neg = F.col("n") - F.col("n_pos")
    out = [F.col(REQ), F.col("n"), F.col("n_pos"),
           F.when(F.col("n_pos") > 0, 1.0 / F.col("first")).otherwise(0.0).alias("mrr"),
           _auc(F.col("n_pos"), n_neg, F.col("lost")).alias("gauc")]
    for k in ks:
        idcg = ideal_dcg(F.col("n_pos"), k)
        out += [F.when(F.col("n_pos") > 0, F.col(f"hits_{k}") / F.col("n_pos")).otherwise(0.0).alias(f"recall_{k}"),
                F.when(F.col("n_pos") > 0, F.col(f"dcg_{k}") / idcg).otherwise(0.0).alias(f"ndcg_{k}")]
    if top_k:
        # given only where K rows exist and the top K hold a positive
        shown = (F.col("n") >= top_k) & (F.col("p_in") > 0)
        out += [F.when(shown, 1.0 / F.col("first")).alias(f"mrr_at_{top_k}"),
                F.when(shown, _auc(F.col("p_in"), F.col("n_in") - F.col("p_in"), F.col("lost_in"))).alias(f"gauc_at_{top_k}"),
                F.col("p_in").alias("pos_in_top")]
    return g.select(*out)


def _auc(p: Column, n: Column, lost: Column) -> Column:
    """Share of positive-negative pairs in the right order; 0 for one-class groups."""
    return F.when((p > 0) & (n > 0), (p * n - lost) / (p * n)).otherwise(0.0)


def averages(per_req: DataFrame, ks: Sequence[int], denominator: str = "all",
             top_k: int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Cross-request means, each with its own denominator.

    all: divide by every request. with_positive: by requests that have a positive.
    The top-K metrics divide by requests whose top K rows hold a positive ("all"),
    or by the requests that have the metric ("with_positive").
    """
    if denominator not in ("all", "with_positive"):
        raise ValueError(f"unknown denominator: {denominator}")
    has_pos = F.col("n_pos") > 0
    denom = F.count("*") if denominator == "all" else F.count_if(has_pos)
    cols = [F.count("*").alias("requests"), F.count_if(has_pos).alias("requests_with_positive")]
    for m in ["mrr", "gauc", *[f"{m}_{k}" for m in ("recall", "ndcg") for k in ks], *extra]:
        total = F.sum(F.when(has_pos, F.col(m)).otherwise(0.0))
        cols.append(F.when(denom > 0, total / denom).otherwise(0.0).alias(m))
    if top_k:
        for m in (f"mrr_at_{top_k}", f"gauc_at_{top_k}"):
            d = F.count_if(F.col("pos_in_top") > 0) if denominator == "all" else F.count(m)
            cols.append(F.when(d > 0, F.sum(F.coalesce(F.col(m), F.lit(0.0))) / d).otherwise(0.0).alias(m))
    return per_req.agg(*cols)


def hit_rate(df: DataFrame, ks: Sequence[int], requests: DataFrame, rank: str = "rank") -> DataFrame:
    """Share of requests with any positive in their first k rows, over all requests."""
    hits = df.filter(F.col(LABEL) > 0).groupBy(REQ).agg(F.min(rank).alias("best"))
    joined = requests.select(REQ).join(hits, REQ, "left")
    return joined.agg(F.count("*").alias("requests"),
                      *[(F.count_if(F.col("best") <= k) / F.count("*")).alias(f"hit_rate_{k}") for k in ks])


def group_mrr_all(df: DataFrame, group: str, hot_rows: int | None = None) -> DataFrame:
    """Sum(label / rank) / sum(label) per group, then the plain mean over groups."""
    order = [F.col(SCORE).desc(), F.col(LABEL).asc(), F.col(ITEM).asc()]
    rows = with_prefix(df, [group], order, {"__r": F.lit(1).cast("long")}, hot_rows)
    g = rows.groupBy(group).agg(
        (F.sum(F.col(LABEL) / (F.col("__r") + 1)) / (F.sum(LABEL) + 1e-12)).alias("mrr"))
    return g.agg(F.count("*").alias("groups"), F.avg("mrr").alias("mrr"))


def group_ndcg(df: DataFrame, group: str, k: int = 1) -> DataFrame:
    """NDCG@k with gain 2^label - 1 per group, then the plain mean over groups."""
    from lumirank.operators.ordering import top_k
    gain = F.pow(F.lit(2.0), F.col(LABEL)) - 1.0
    disc = F.log2(F.col("rank") + 1.0)
    item = [F.col(ITEM).asc()]

    def dcg(order, name):
        return (top_k(df.select(group, ITEM, SCORE, LABEL), [group], order + item, k)
                .groupBy(group).agg(F.sum(gain / disc).alias(name)))

    got = dcg([F.col(SCORE).desc(), F.col(LABEL).asc()], "dcg")
    best = dcg([F.col(LABEL).desc()], "idcg")
    return (got.join(best, group)
            .agg(F.count("*").alias("groups"), F.avg(F.col("dcg") / (F.col("idcg") + 1e-12)).alias("ndcg")))
