"""Ranking stage on candidate relations: validity, feature joins, scoring, top-K, diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumirank.functions.numeric import safe_logit
from lumirank.operators.ordering import first_per_key, top_k
from lumirank.operators.ranking_metrics import ITEM, LABEL, REQ, pessimistic_order

Scorer = Column | Callable[[DataFrame], DataFrame]


def valid_candidates(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    ids = pool.select(F.col(ITEM).cast(candidates.schema[ITEM].dataType)).distinct()
    return candidates.join(ids, ITEM, "left_semi")


def dropped_candidates(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """Kept and dropped candidate rows, and how many dropped rows were positive."""
    ids = pool.select(F.col(ITEM).cast(candidates.schema[ITEM].dataType)).distinct().withColumn("__in", F.lit(1))
    j = candidates.join(ids, ITEM, "left")
    gone = F.col("__in").isNull()
    return j.agg(F.count("__in").alias("kept"), F.count_if(gone).alias("dropped"),
                 F.count_if(gone & (F.col(LABEL) > 0)).alias("dropped_positives"))


def with_item_features(candidates: DataFrame, pool: DataFrame, columns: Sequence[str],
                       fallback: dict | None = None) -> DataFrame:
    """Inner lookup, or a left lookup with fallback values for items the pool lacks."""
    feats = pool.select(ITEM, *columns)
    if not fallback:
        return candidates.join(feats, ITEM)
    j = candidates.join(feats, ITEM, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fallback.items()})


def with_user_features(candidates: DataFrame, users: DataFrame, columns: Sequence[str]) -> DataFrame:
    return candidates.join(users.select(REQ, *columns), REQ, "left")


def enrich_user_features(users: DataFrame, source: DataFrame, order: Sequence[str],
                         columns: Sequence[str] | None = None) -> DataFrame:
    """Add the columns the user table lacks, from each request's first source row."""
    missing = [c for c in (columns or source.columns) if c not in users.columns and c != REQ]
    if not missing:
        return users
    keep = [REQ, *missing, *[o for o in order if o not in missing and o != REQ]]
    first = first_per_key(source.select(*keep), [REQ], order).select(REQ, *missing)
    return users.join(first, REQ, "left")


def flag_members(candidates: DataFrame, other: DataFrame, name: str = "in_other") -> DataFrame:
    """Flag the rows whose (request, item) is in the other stage's candidates."""
    o = other.select(REQ, ITEM).distinct().withColumn("__m", F.lit(True))
    return candidates.join(o, [REQ, ITEM], "left").withColumn(name, F.coalesce("__m", F.lit(False))).drop("__m")


def score_rows(df: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """A scorer is a column, or a function of the frame (an ML pipeline model, mapInPandas)."""
    return scorer(df) if callable(scorer) and not isinstance(scorer, Column) else df.withColumn(name, scorer)


def rank_top_k(df: DataFrame, k: int) -> DataFrame:
    return top_k(df, [REQ], pessimistic_order(), k)


def inject_teacher(df: DataFrame, teacher: DataFrame, scale: float = 1.0, weight: float | None = None) -> DataFrame:
    """Join another stage's score as the feature `teacher_score`; with a weight also add it to the score."""
    t = teacher.select(REQ, ITEM, (F.col("score") / F.lit(float(scale))).alias("teacher_score"))
    j = df.join(t, [REQ, ITEM], "left").withColumn("teacher_score", F.coalesce("teacher_score", F.lit(0.0)))
    return j.withColumn("score", F.col("score") + F.lit(float(weight)) * F.col("teacher_score")) if weight else j


def attach_popularity(pool: DataFrame, popularity: DataFrame) -> DataFrame:
    return pool.join(popularity, ITEM, "left").withColumn("popularity", F.coalesce("popularity", F.lit(0)).cast("long"))


def top_report(df: DataFrame, k: int = 10) -> DataFrame:
    """Per request: best positive, first place, hit@1, and the first k items as JSON."""
    order = pessimistic_order()
    best = top_k(df.filter(F.col(LABEL) > 0), [REQ], order, 1).select(
        REQ, F.col(ITEM).alias("positive_item"), F.col("score").alias("positive_score"))
    top = top_k(df, [REQ], order, k)
    lists = top.groupBy(REQ).agg(
        F.max(F.when(F.col("rank") == 1, F.col(ITEM))).alias("top1_item"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"),
        F.max(F.when(F.col("rank") == 1, (F.col(LABEL) > 0).cast("int"))).alias("hit_at_1"),
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", ITEM))), lambda s: s[ITEM])).alias("top_items"))
    return lists.join(best, REQ, "left")


def route_scores(mode: str, mask: Column, cloud: Column, device: Column) -> Column:
    """`cloud` and `device` take one score; `auto` takes cloud where the mask holds."""
    if mode == "cloud":
        return cloud
    if mode == "device":
        return device
    if mode == "auto":
        return F.when(mask, cloud).otherwise(device)
    raise ValueError(f"unknown mode: {mode}")


def scene_score(value: Column, scene_of: dict, scores: Column, default: int = 0, shift: int = 0) -> Column:
    """Map a value to its scene (with a default and a shift) and take that scene's score."""
    table = F.create_map(*[x for k, v in scene_of.items() for x in (F.lit(k), F.lit(int(v)))])
    scene = F.coalesce(F.try_element_at(table, value), F.lit(default)) - F.lit(shift)
    return F.get(scores, scene)


def privacy_mask(df: DataFrame, mask: Column, padding: dict[str, object]) -> DataFrame:
    """Masked rows get the padding value in the listed columns."""
    return df.withColumns({c: F.when(mask, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c))
                           for c, v in padding.items()})


def group_flag(df: DataFrame, column: str) -> Column | None:
    """1.0 for rows flagged 1, else 2.0; None when the column is absent."""
    if column not in df.columns:
        return None
    return F.when(F.col(column) == 1, F.lit(1.0)).otherwise(F.lit(2.0))


def residual_score(score: Column, teacher_prob: Column, weight: float, scale: float = 1.0) -> Column:
    return score + F.lit(float(weight)) * safe_logit(teacher_prob) / F.lit(float(scale))
