"""Row filters, splits and row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumirank.operators.ordering import with_global_prefix, with_row_number


def positives(df: DataFrame, label: str = "label", rule: str = "eq1") -> DataFrame:
    """`eq1` keeps label == 1, `gt0` keeps label > 0."""
    if rule not in ("eq1", "gt0"):
        raise ValueError(f"unknown positive rule: {rule}")
    return df.filter(F.col(label) == 1 if rule == "eq1" else F.col(label) > 0)


def binarize(label: Column, threshold: float = 0.0) -> Column:
    return (F.coalesce(label, F.lit(0)) > threshold).cast("int")


def frequent_items(df: DataFrame, item: str, min_count: int, label: str | None = None) -> DataFrame:
    """Items with at least min_count rows (or positive rows)."""
    src = df.filter(F.col(label) > 0) if label else df
    return src.groupBy(item).count().filter(F.col("count") >= min_count).select(item)


def filter_rare_items(df: DataFrame, item: str, min_count: int) -> DataFrame:
    """Semi join to the kept items; a hot item is split by AQE, which may split the left side."""
    return df.join(frequent_items(df, item, min_count), item, "left_semi")


def keep_items(df: DataFrame, keep: DataFrame, item: str) -> DataFrame:
    return df.join(keep.select(item), item, "left_semi")


def train_view(df: DataFrame, num_negatives: int = 0, hybrid: bool = False, label: str = "label") -> DataFrame:
    """Pairwise training reads positives only; pointwise and hybrid training read every row."""
    return positives(df, label) if num_negatives > 0 and not hybrid else df


def with_request_id(df: DataFrame, order: Sequence[str], name: str = "request_id") -> DataFrame:
    """Row number minus one over a declared total order; an existing id is kept."""
    if name in df.columns:
        return df
    return with_row_number(df, [], order, name).withColumn(name, F.col(name) - 1)


def fill_missing_request_id(df: DataFrame, order: Sequence[str], name: str = "request_id", missing: int = -1) -> DataFrame:
    """Rows whose id is the missing mark get running numbers over the declared order."""
    todo = df.filter(F.coalesce(F.col(name), F.lit(missing)) == missing)
    fine = df.filter(F.coalesce(F.col(name), F.lit(missing)) != missing)
    fixed = with_row_number(todo, [], order, "__id").withColumn(name, F.col("__id") - 1).drop("__id")
    return fine.unionByName(fixed.select(*df.columns))


def drop_inconsistent_conversions(df: DataFrame, click: str = "click", purchase: str = "purchase") -> DataFrame:
    return df.filter(~((F.col(click) == 0) & (F.col(purchase) == 1)))


def sanitize_id(col: Column, vocab_size: int) -> Column:
    """Negative ids go to 0 and ids past the table to its last entry."""
    return F.least(F.greatest(col, F.lit(0)), F.lit(vocab_size - 1))


def id_violations(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Per column: how many ids are negative or past the vocabulary."""
    cells = [F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c) < 0).alias("negative"),
                      F.count_if(F.col(c) >= n).alias("past_vocab")) for c, n in sizes.items()]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def check_ids(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Strict mode of `sanitize_id`: refuse the frame when any id is out of range."""
    bad = [r.asDict() for r in id_violations(df, sizes).filter("negative > 0 or past_vocab > 0").collect()]
    if bad:
        raise ValueError(f"ids out of range: {bad}")
    return df


def split_train_test(df: DataFrame, order: Sequence[str], test_size: float = 0.2, valid_size: float = 0.0,
                     mode: str = "sequential", seed: int = 0, key: Sequence[str] | None = None,
                     hash_expr: Column | None = None) -> DataFrame:
    """Add `split` with exact counts. Sizes below 1 are shares of the rows, else row counts.

    sequential: the tail of `order` is test and the part before it valid.
    random: the same cut on a seeded hash of `key`, or on a given one.
    """
    if mode not in ("sequential", "random"):
        raise ValueError(f"unknown split mode: {mode}")
    h = hash_expr if hash_expr is not None else F.xxhash64(F.lit(seed), *[F.col(c) for c in (key or order)])
    by = list(order) if mode == "sequential" else [h, *order]
    out, tot = with_global_prefix(df, by, {"__pos": F.lit(1).cast("long")})
    n = tot["__pos"]
    n_test = int(n * test_size) if test_size < 1 else int(test_size)
    n_valid = int(n * valid_size) if valid_size < 1 else int(valid_size)
    split = (F.when(F.col("__pos") >= n - n_test, "test")
             .when(F.col("__pos") >= n - n_test - n_valid, "valid").otherwise("train"))
    return out.withColumn("split", split).drop("__pos")


def half_split(df: DataFrame, key: Sequence[str], test_size: float = 0.5, seed: int = 0,
               hash_expr: Column | None = None) -> DataFrame:
    """Seeded shuffle split with exact counts; the shuffle key may be given."""
    h = hash_expr if hash_expr is not None else F.xxhash64(F.lit(seed), *[F.col(c) for c in key])
    out, tot = with_global_prefix(df, [h, *key], {"__pos": F.lit(1).cast("long")})
    n_test = int(tot["__pos"] * test_size)
    return out.withColumn("split", F.when(F.col("__pos") < n_test, "test").otherwise("train")).drop("__pos")


def cap_requests(df: DataFrame, request: str, order: str, max_requests: int, item_count: int | None = None,
                 max_candidate_rows: int | None = None, positive_only: bool = False,
                 label: str = "label") -> DataFrame:
    """Rows of the first requests by first position, under the smaller of the given budgets."""
    src = df
    if positive_only:
        src = df.join(df.filter(F.col(label) > 0).select(request).distinct(), request, "left_semi")
    cap = max_requests
    if max_candidate_rows and item_count:
        cap = min(cap, max(1, max_candidate_rows // item_count))
    placed, _ = with_global_prefix(src.groupBy(request).agg(F.min(order).alias("__at")), ["__at", request],
                                   {"__before": F.lit(1).cast("long")})
    return src.join(placed.filter(F.col("__before") < cap).select(request), request, "left_semi")


def request_offsets(df: DataFrame, request: str, order: str) -> DataFrame:
    """Per request, in order of first appearance: its row count and the rows before it."""
    firsts = df.groupBy(request).agg(F.min(order).alias("first_pos"), F.count("*").alias("n"))
    out, _ = with_global_prefix(firsts, ["first_pos", request], {"row_offset": F.col("n")})
    return out.withColumn("row_offset", F.col("row_offset").cast("long"))
