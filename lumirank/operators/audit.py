"""Leakage audits and strict evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from lumirank.functions.text import normalize_id
from lumirank.operators.ranking_metrics import ITEM, LABEL, REQ
from lumirank.schema import FeatureGroups


# fixed values: names that stand for the candidate or the row in any schema
CANDIDATE_NAMES = ("cand_item_id", "app_id", "label", "column_id")


def conditioned_columns(user_columns: Sequence[str], item_columns: Sequence[str], ids: Sequence[str], labels: Sequence[str],
                        groups: FeatureGroups | None = None, keys: Sequence[str] = ("request_id", "user_id")) -> list[str]:
    """User-side columns that depend on the candidate, from the declared schema.

    The candidate's side is everything declared for it: its ids, the labels, the columns of the
    item table and the item group. What of it stands in the user table, but for the user's own
    keys, must not reach a user-side model.
    """
    candidate_side = {*CANDIDATE_NAMES, *ids, *labels, *item_columns, *(groups.item() if groups else ())}
    leaked = candidate_side.intersection(user_columns).difference(keys)
    return sorted(leaked, key=list(user_columns).index)


def neutralize(df: DataFrame, columns: Sequence[str], specs: dict[str, dict] | None = None) -> DataFrame:
    """Replace candidate-conditioned columns by 0, 0.0, or a padding array of the declared length."""
    specs = specs or {}
    new = {}
    for c in columns:
        spec = specs.get(c, {})
        kind = df.schema[c].dataType
        if isinstance(kind, T.ArrayType) or spec.get("type") == "sequence":
            v = F.array_repeat(F.lit(int(spec.get("padding_idx", 0))), max(1, int(spec.get("max_len", 1))))
            kind = kind if isinstance(kind, T.ArrayType) else T.ArrayType(T.IntegerType())
        else:
            v = F.lit(0.0 if spec.get("type") == "numeric" else 0)
        new[c] = v.cast(kind)
    return df.withColumns(new)


def sequence_leakage(users: DataFrame, positives: DataFrame, sequences: Sequence[str]) -> DataFrame:
    """(request, sequence_column, positive_item or null): one row per check.

    A check is a sequence column of a request that has positives. History values are
    exploded and joined on (request, item), so a request with many positives is not gathered.
    """
    pos = positives.filter(F.coalesce(F.col(LABEL), F.lit(0)) > 0).select(
        normalize_id(F.col(REQ)).alias("__r"), normalize_id(F.col(ITEM)).alias("__i")).distinct()
    cells = F.array(*[F.struct(F.lit(c).alias("sequence_column"), F.col(c).cast("array<string>").alias("vals"))
                      for c in sequences])
    x = (users.select(normalize_id(F.col(REQ)).alias("__r"), F.explode(cells).alias("c"))
         .select("__r", "c.sequence_column", "c.vals"))
    checks = x.select("__r", "sequence_column").join(pos.select("__r").distinct(), "__r", "left_semi")
    vals = x.select("__r", "sequence_column", F.explode("vals").alias("v")).select(
        "__r", "sequence_column", normalize_id(F.col("v")).alias("__i")).distinct()
    hits = vals.join(pos, ["__r", "__i"], "left_semi").groupBy("__r", "sequence_column").agg(F.min("__i").alias("positive_item"))
    return checks.join(hits, ["__r", "sequence_column"], "left").select(
        F.col("__r").alias(REQ), "sequence_column", "positive_item")


def history_leakage(users: DataFrame, events: DataFrame, positives: DataFrame, user: str, value: str,
                    sequence: str = "hist") -> DataFrame:
    """`sequence_leakage` for a history that is a table of events: no list is built.

    A request of `users` (request, user) with positives and with events is a check; it leaks when one
    of its positives is a value among the events of its user, at any place.
    """
    pos = positives.filter(F.coalesce(F.col(LABEL), F.lit(0)) > 0).select(
        normalize_id(F.col(REQ)).alias("__r"), normalize_id(F.col(ITEM)).alias("__i")).distinct()
    seen = events.select(F.col(user).alias("__u"), normalize_id(F.col(value)).alias("__i")).distinct()
    requests = users.select(normalize_id(F.col(REQ)).alias("__r"), F.col(user).alias("__u"))
    checks = (requests.join(pos.select("__r").distinct(), "__r", "left_semi")
              .join(seen.select("__u").distinct(), "__u", "left_semi"))
    hits = (checks.join(pos, "__r").join(seen, ["__u", "__i"], "left_semi")
            .groupBy("__r").agg(F.min("__i").alias("positive_item")))
    return checks.join(hits, "__r", "left").select(F.col("__r").alias(REQ), F.lit(sequence).alias("sequence_column"), "positive_item")


def leakage_summary(checks: DataFrame) -> DataFrame:
    n, h = F.count("*"), F.count("positive_item")
    return checks.agg(n.alias("checks"), h.alias("hits"), F.when(n > 0, h / n).otherwise(0.0).alias("hit_rate"))


def leakage_examples(checks: DataFrame, limit: int = 20) -> DataFrame:
    """The first hits of the report by request and column."""
    return checks.filter("positive_item is not null").orderBy(REQ, "sequence_column").limit(limit)
