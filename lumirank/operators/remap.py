"""Id compaction: used ids, decisions, dense maps, and applying them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumirank.functions.text import array_key
from lumirank.operators.ordering import with_row_number
from lumirank.session import stable


def _is_array(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.ArrayType)


def used_ids(df: DataFrame, columns: Sequence[str], share: dict[str, str] | None = None) -> DataFrame:
    """Distinct (feature, id) over scalar and array columns, padding 0 left out.
    Columns that share a table are reported under its name."""
    share = share or {}
    out = None
    for c in columns:                     # one pruned scan per column; repeats go before the shuffle
        ids = F.explode(F.col(c).cast("array<bigint>")) if _is_array(df, c) else F.col(c).cast("bigint")
        part = df.select(ids.alias("id")).filter("id is not null and id <> 0").distinct()
        part = part.select(F.lit(share.get(c, c)).alias("feature"), "id")
        out = part if out is None else out.unionByName(part)
    return stable(out.distinct())


def pruning_decisions(used: DataFrame, vocab_sizes: dict[str, int], min_vocab: int = 100,
                      min_reduction: float = 0.3) -> DataFrame:
    """Per feature: sizes before and after, reduction, and whether to compact it."""
    sizes = F.create_map(*[x for f, n in vocab_sizes.items() for x in (F.lit(f), F.lit(int(n)))])
    c = used.groupBy("feature").agg(F.count("*").alias("used")).withColumn(
        "vocab_size", F.element_at(sizes, F.col("feature")).cast("long")).filter("vocab_size is not null")
    red = 1.0 - F.col("used") / F.col("vocab_size")
    return c.select("feature", "used", "vocab_size", (F.col("used") + 1).alias("compact_size"), red.alias("reduction"),
                    ((F.col("vocab_size") > min_vocab) & (red >= min_reduction)).cast("int").alias("prune"))


def remap_table(used: DataFrame, vocab_sizes: dict[str, int] | None = None, features: Sequence[str] | None = None,
                hot_rows: int | None = None) -> DataFrame:
    """(feature, old_id, new_id): ids in ascending order become 1..n; 0 stays for padding and unknown."""
    src = used.filter(F.col("feature").isin(*features)) if features is not None else used
    t = with_row_number(src, ["feature"], ["id"], "new_id", hot_rows).select("feature", F.col("id").alias("old_id"), "new_id")
    if vocab_sizes:
        sizes = F.create_map(*[x for f, n in vocab_sizes.items() for x in (F.lit(f), F.lit(int(n)))])
        t = t.filter(F.col("old_id") < F.element_at(sizes, F.col("feature")))
    return t


def check_remap(table: DataFrame) -> DataFrame:
    """Refuse unnamed features, negative ids, and ids mapped twice."""
    seen = table.groupBy("feature", "old_id").agg(F.count("*").alias("n"), F.min("new_id").alias("low"),
                                                  F.count("new_id").alias("given"))
    bad = seen.agg(F.count_if(F.coalesce(F.trim("feature"), F.lit("")) == "").alias("unnamed"),
                   F.count_if((F.col("old_id") < 0) | (F.col("low") < 0)).alias("negative"),
                   F.count_if(F.col("old_id").isNull() | (F.col("given") < F.col("n"))).alias("missing"),
                   F.count_if(F.col("n") > 1).alias("twice")).first().asDict()
    wrong = {k: v for k, v in bad.items() if v}
    if wrong:
        raise ValueError(f"remap table is not valid: {wrong}")
    return table


def _one(table: DataFrame, feature: str, src: str, dst: str) -> DataFrame:
    return table.filter(F.col("feature") == feature).select(F.col(src).alias("__old"), F.col(dst).alias("__new"))


def remap_scalar(df: DataFrame, column: str, table: DataFrame, feature: str | None = None) -> DataFrame:
    m = _one(table, feature or column, "old_id", "new_id")
    return (df.join(m, F.col(column).cast("bigint") == F.col("__old"), "left")
            .withColumn(column, F.coalesce("__new", F.lit(0)).cast("long")).drop("__old", "__new"))


def remap_sequence(df: DataFrame, column: str, table: DataFrame, feature: str | None = None) -> DataFrame:
    """`df` with the array's ids replaced, order and length kept. Each distinct array is remapped once under a digest
    of 16 bytes, which is all that its ids carry through the lookup; rows need no key, and null becomes an empty array."""
    m = _one(table, feature or column, "old_id", "new_id")
    ids = F.col(column).cast("array<bigint>")
    seqs = (df.select(array_key(ids).alias("__key"), ids.alias("__seq")).filter("__key is not null")
            .groupBy("__key").agg(F.first("__seq").alias("__seq")))
    x = seqs.select("__key", F.posexplode("__seq").alias("__pos", "__old")).join(m, "__old", "left")
    pair = F.struct("__pos", F.coalesce("__new", F.lit(0)).cast("long").alias("__id"))
    rows = (x.groupBy("__key").agg(F.array_sort(F.collect_list(pair)).alias("__s"))
            .select("__key", F.transform("__s", lambda s: s["__id"]).alias("__ids")))
    empty = F.array().cast("array<bigint>")
    return df.join(rows, array_key(ids) == F.col("__key"), "left").withColumn(column, F.coalesce("__ids", empty)).drop("__key", "__ids")


def remap_frame(df: DataFrame, columns: Sequence[str], table: DataFrame, share: dict[str, str] | None = None) -> DataFrame:
    share = share or {}
    out = df
    for c in columns:
        out = (remap_sequence if _is_array(df, c) else remap_scalar)(out, c, table, share.get(c, c))
    return out.select(*df.columns)


def unmap(df: DataFrame, column: str, table: DataFrame, feature: str, out: str) -> DataFrame:
    """Compact id back to the old id; ids past the table take its last entry, 0 stays 0."""
    size = table.filter(F.col("feature") == feature).agg(F.coalesce(F.max("new_id"), F.lit(0))).first()[0]
    m = _one(table, feature, "new_id", "old_id")
    safe: Column = F.least(F.greatest(F.col(column), F.lit(0)), F.lit(size))
    return (df.join(m, safe == F.col("__old"), "left")
            .withColumn(out, F.coalesce("__new", F.lit(0)).cast("long")).drop("__old", "__new"))
