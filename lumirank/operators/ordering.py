"""Ranks and running sums that hold when one group has a third of all rows.

A plain window puts each group into one task. Here a group past `hot_rows` rows is
range-partitioned on (group, order) instead: every piece gets its running sum in
parallel and one offset per piece is added. Offsets number at most one per
partition, so sending them to all tasks is bounded by the partition count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumirank.session import stable

DEFAULT_HOT_ROWS = 2_000_000
HOT_ROWS_CONF = "lumirank.hotGroupRows"
_PIECE = "__piece"


def hot_limit(df: DataFrame, hot_rows: int | None) -> int:
    return int(hot_rows or df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def hot_keys(df: DataFrame, by: Sequence[str], hot_rows: int | None = None,
             upper: DataFrame | None = None) -> DataFrame | None:
    """Keys with more than `hot_rows` rows, or None. At most rows / hot_rows keys exist.

    `upper` is a cheaper frame with at least as many rows per key (the rows before an
    aggregation): when it has no hot key, `df` is not run for the check.
    """
    limit = hot_limit(df, hot_rows)
    if upper is not None and upper.groupBy(*by).count().filter(F.col("count") > limit).isEmpty():
        return None
    keys = df.groupBy(*by).count().filter(F.col("count") > limit).select(*by)
    if keys.isEmpty():
        return None
    return stable(keys)


def _order_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _window_prefix(df, by, order, sums):
    w = (W.partitionBy(*by).orderBy(*order)
         .rowsBetween(W.unboundedPreceding, -1))
    return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(n) for n, v in sums.items()])


def _ranged_pieces(df: DataFrame, by, order) -> DataFrame:
    # no partition count: AQE may merge neighbouring small ranges, which keeps their order
    return stable(df.repartitionByRange(*[F.col(b) for b in by], *order)
                  .withColumn(_PIECE, F.spark_partition_id()))


def _local_prefix(pieces, by, order, sums):
    w = (W.partitionBy(_PIECE, *by).orderBy(*order)
         .rowsBetween(W.unboundedPreceding, -1))
    return pieces.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(n) for n, v in sums.items()])


def _ranged_prefix(df, by, order, sums):
    pieces = _ranged_pieces(df, by, order)
    totals = pieces.groupBy(_PIECE, *by).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()])
    before = W.partitionBy(*by).orderBy(_PIECE).rowsBetween(W.unboundedPreceding, -1)
    # a group has an offset only in pieces after its first: at most one such group per piece
    offsets = (totals
               .select(_PIECE, *by, F.row_number().over(W.partitionBy(*by).orderBy(_PIECE)).alias("__nth"),
                       *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in sums])
               .filter("__nth > 1").drop("__nth"))
    local = _local_prefix(pieces, by, order, sums)
    keyed = offsets.withColumnsRenamed({b: f"__k_{b}" for b in by})
    joined = local.join(keyed, [_PIECE], "left") if not by else local.join(
        keyed.withColumnRenamed(_PIECE, "__k_piece"),
        [F.col(_PIECE) == F.col("__k_piece"), *[F.col(b).eqNullSafe(F.col(f"__k_{b}")) for b in by]], "left")
    return joined.select(*df.columns, *[(F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n)
                                        for n in sums])


def with_prefix(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
                sums: Mapping[str, Column], hot_rows: int | None = None,
                upper: DataFrame | None = None) -> DataFrame:
    """Add, per row, the sum of each value over the rows of its group that come before it.

    `order` must be total up to rows that are equal in every used column.
    """
    by, order = list(by), _order_columns(order)
    keys = hot_keys(df, by, hot_rows, upper)
    if keys is None:
        return _window_prefix(df, by, order, sums)
    # null is a group like others, so keys are compared null-safely
    k = keys.select(*[F.col(b).alias(f"__k_{b}") for b in by])
    same = [F.col(b).eqNullSafe(F.col(f"__k_{b}")) for b in by]
    cold = df.join(k, same, "left_anti")
    hot = df.join(k, same, "left_semi").select(*df.columns)
    return _window_prefix(cold, by, order, sums).unionByName(_ranged_prefix(hot, by, order, sums))


def with_global_prefix(df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, Column],
                       ) -> tuple[DataFrame, dict]:
    """`with_prefix` over the whole frame as one group; also returns the grand totals."""
    order = _order_columns(order)
    pieces = _ranged_pieces(df, [], order)
    per_piece = pieces.groupBy(_PIECE).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    offsets, totals = [], {n: 0 for n in sums}
    for r in sorted(per_piece.collect(), key=lambda r: r[_PIECE]):          # one row per partition
        offsets.append((r[_PIECE], *totals.values()))
        for n in sums:
            totals[n] += r[n] or 0
    local = _local_prefix(pieces, [], order, sums)
    table = df.sparkSession.createDataFrame(offsets, per_piece.schema).withColumnsRenamed({n: f"__o_{n}" for n in sums})
    local = local.join(F.broadcast(table), _PIECE, "left")        # as many rows as partitions
    local = local.withColumns({n: F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0)) for n in sums}).drop(*[f"__o_{n}" for n in sums])
    return local.drop(_PIECE), totals


def with_segmented_prefix(df: DataFrame, segment: str, order: Sequence[str | Column], sums: Mapping[str, Column],
                          ) -> tuple[DataFrame, dict]:
    """`with_prefix` by one key for all its values in a single range sort, however large each is; also returns
    the totals per value. Values are few and not null: the driver gets one row per partition and value met there."""
    order = _order_columns(order)
    pieces = _ranged_pieces(df, [segment], order)
    per_piece = pieces.groupBy(_PIECE, segment).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    offsets, totals = [], {}
    for r in sorted(per_piece.collect(), key=lambda r: r[_PIECE]):
        so_far = totals.setdefault(r[segment], {n: 0 for n in sums})
        offsets.append((r[_PIECE], r[segment], *so_far.values()))
        for n in sums:
            so_far[n] += r[n] or 0
    local = _local_prefix(pieces, [segment], order, sums)
    table = df.sparkSession.createDataFrame(offsets, per_piece.schema).withColumnsRenamed({n: f"__o_{n}" for n in sums})
    local = local.join(F.broadcast(table), [_PIECE, segment])
    local = local.withColumns({n: F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0)) for n in sums}).drop(*[f"__o_{n}" for n in sums])
    return local.drop(_PIECE), totals


def with_row_number(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
                    name: str = "rank", hot_rows: int | None = None, upper: DataFrame | None = None) -> DataFrame:
    """1-based position per group; `by=[]` numbers the whole frame."""
    ones = {name: F.lit(1).cast("long")}
    if by:
        out = with_prefix(df, by, order, ones, hot_rows, upper)
    else:
        out, _ = with_global_prefix(df, order, ones)
    return out.withColumn(name, (F.col(name) + 1).cast("long"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int,
          name: str = "rank") -> DataFrame:
    """First k rows per group. Spark prunes each map partition to k rows per group
    before the shuffle (WindowGroupLimit), so a hot group costs k rows per task. Past the k up to
    which Spark does that, groups with many rows are numbered in ranges instead."""
    if k >= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return with_row_number(df, list(by), order, name).filter(F.col(name) <= k).withColumn(name, F.col(name).cast("int"))
    w = W.partitionBy(*by).orderBy(*_order_columns(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row that comes first in `order` for each key, as a partial aggregate."""
    rest = [c for c in df.columns if c not in key]
    lead = [c for c in order if c not in key]
    packed = F.struct(*lead, *[c for c in rest if c not in lead])
    return (df.groupBy(*key).agg(F.min(packed).alias("__first"))
            .select(*key, *[F.col(f"__first.{c}").alias(c) for c in rest])
            .select(*df.columns))


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float]) -> dict[float, float]:
    """Exact linear-interpolation quantiles of a column without sorting it in one task."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    placed, totals = with_global_prefix(counts, [column], {"__before": F.col("__n")})
    return quantiles_of(placed, column, F.col("__before"), F.col("__n"), totals["__before"], qs)


def quantiles_of(placed: DataFrame, column: str, before: Column, count: Column, n: int,
                 qs: Sequence[float]) -> dict[float, float]:
    """Quantiles of values that know how many of the n rows hold them and how many come before."""
    if not n:
        return {q: None for q in qs}
    want = {}
    for q in qs:
        h = (n - 1) * q
        lo = int(h)
        want[q] = (lo, min(lo + 1, n - 1), h - lo)
    at = {i for lo, hi, _ in want.values() for i in (lo, hi)}
    row = placed.agg(*[F.max(F.when((before <= i) & (before + count > i), F.col(column))).alias(f"v{i}")
                       for i in sorted(at)]).first()
    return {q: float(row[f"v{lo}"]) + frac * (float(row[f"v{hi}"]) - float(row[f"v{lo}"]))
            for q, (lo, hi, frac) in want.items()}
