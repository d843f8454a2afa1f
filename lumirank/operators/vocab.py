"""Vocabularies as tables (token, idx): fit, merge, extend, encode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumirank.functions import text
from lumirank.operators.ordering import with_global_prefix, with_row_number, with_segmented_prefix
from lumirank.session import stable

# fixed values
PAD, OOV = "__PAD__", "__OOV__"


def token_counts(df: DataFrame, column: str, splitter: str | None = None, lower: bool = False) -> DataFrame:
    """(token, count); sequences are split and exploded, counted map-side first."""
    c = F.col(column).cast("string")
    src = df.select(F.explode(text.tokens(c, splitter)).alias("token")) if splitter else df.select(c.alias("token"))
    if lower:
        src = src.withColumn("token", F.lower("token"))
    return src.filter(F.col("token").isNotNull()).groupBy("token").agg(F.count("*").alias("count"))


def max_sequence_length(df: DataFrame, column: str, splitter: str) -> int:
    return df.agg(F.max(F.size(text.tokens(F.col(column), splitter)))).first()[0] or 0


def cut_counts(counts: DataFrame, most: int) -> DataFrame:
    """Rows of (token, count) that hold the `most` first by falling count and token, and few more, found without a sort.

    Few distinct counts exist (at most the square root of twice all rows), so the least count that still has a place is
    found from how many tokens share each. Of the tokens that have just that count, the first by token are picked by
    a bounded heap in each task, up to the places left.
    """
    per = counts.groupBy("count").agg(F.count("*").alias("tokens"))
    above = F.sum("tokens").over(W.orderBy(F.desc("count")).rowsBetween(W.unboundedPreceding, -1))
    edge = per.withColumn("above", F.coalesce(above, F.lit(0))).filter((F.col("above") < most) & (F.col("above") + F.col("tokens") >= most)).first()
    if edge is None:
        return counts
    tied = counts.filter(F.col("count") == edge["count"]).orderBy("token").limit(most - edge["above"])
    return counts.filter(F.col("count") > edge["count"]).unionByName(tied)


def build_sized_vocab(counts: DataFrame, max_features: int | None = None, min_freq: int = 1, na_value: str = "",
                      remap: bool = True) -> tuple[DataFrame, int]:
    """(token, idx) by falling count, ties by token, and the OOV index.

    Indices start at 1 after the na token is dropped; PAD is 0 and OOV one past the largest.
    The table is written once, because fitting and every encoding read it. With `max_features` only tokens that can
    have a place are sorted.
    """
    if max_features:
        counts = cut_counts(stable(counts), max_features)
    placed, _ = with_global_prefix(counts, [F.desc("count"), F.asc("token")], {"__before": F.lit(1).cast("long")})
    words = placed.filter((F.col("count") >= min_freq) & (F.col("token") != na_value))
    if max_features:
        words = words.filter(F.col("__before") < max_features)
    if remap:
        # the na token's place is left out; rare words all stand behind the others
        na = placed.filter(F.col("token") == na_value).select("__before").first()
        past = F.when(F.col("__before") > na["__before"], 0).otherwise(1) if na else F.lit(1)
        words = stable(words.select("token", (F.col("__before") + past).cast("long").alias("idx")))
    else:
        words = words.select("token", F.col("token").cast("long").alias("idx"))
    oov = (words.agg(F.max("idx")).first()[0] or 0) + 1
    marks = counts.sparkSession.createDataFrame([(PAD, 0), (OOV, oov)], "token string, idx long")
    return stable(words.unionByName(marks)), oov


def stacked_counts(df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """(feature, token, count) of several columns from one scan; a column with a splitter is a sequence."""
    def cell(c, splitter):
        value = F.col(c).cast("string")
        toks = F.coalesce(text.tokens(value, splitter), F.array().cast("array<string>")) if splitter else F.array(value)
        return F.transform(toks, lambda t: F.struct(F.lit(c).alias("feature"), t.alias("token")))

    cells = [cell(c, sp) for c, sp in columns.items()]
    rows = df.select(F.explode(F.flatten(F.array(*cells))).alias("c")).select("c.feature", "c.token")
    return rows.filter(F.col("token").isNotNull()).groupBy("feature", "token").agg(F.count("*").alias("count"))


def build_vocabs(counts: DataFrame, rules: dict[str, dict]) -> dict[str, tuple[DataFrame, int]]:
    """`build_sized_vocab` of every feature of (feature, token, count) at once: one sort of all of them, one written table.

    `rules` gives each feature's max_features, min_freq, na_value and remap, as far as they differ from the defaults. The
    driver gets one row per feature and per partition.
    """
    spark = counts.sparkSession
    full = {f: {"max_features": None, "min_freq": 1, "na_value": "", "remap": True, **r} for f, r in rules.items()}

    def rule(name, kind):
        return F.element_at(F.create_map(*[x for f, r in full.items() for x in (F.lit(f), F.lit(r[name]).cast(kind))]), F.col("feature"))

    is_na = (F.col("token") == rule("na_value", "string")).cast("long")
    placed, _ = with_segmented_prefix(counts, "feature", [F.desc("count"), F.asc("token")], {"__before": F.lit(1).cast("long"), "__na": is_na})
    most = rule("max_features", "long")
    w = placed.filter((F.col("count") >= rule("min_freq", "long")) & (is_na == 0) & (most.isNull() | (F.col("__before") < most)))
    # the na token's place is left out; without remapping a word's index is its own value
    idx = F.when(rule("remap", "boolean"), F.col("__before") + 1 - F.col("__na")).otherwise(
        F.when(~rule("remap", "boolean"), F.col("token")).cast("long"))
    words = stable(w.select("feature", "token", idx.cast("long").alias("idx")))
    last = {r["feature"]: r["m"] for r in words.groupBy("feature").agg(F.max("idx").alias("m")).collect()}
    oovs = {f: (last.get(f) or 0) + 1 for f in full}
    marks = spark.createDataFrame([m for f, n in oovs.items() for m in ((f, PAD, 0), (f, OOV, n))], "feature string, token string, idx long")
    both = words.unionByName(marks)
    return {f: (both.filter(F.col("feature") == f).select("token", "idx"), n) for f, n in oovs.items()}


def build_vocab(counts: DataFrame, max_features: int | None = None, min_freq: int = 1,
                na_value: str = "", remap: bool = True) -> DataFrame:
    return build_sized_vocab(counts, max_features, min_freq, na_value, remap)[0]


def _append(vocab: DataFrame, fresh: DataFrame, order: list) -> DataFrame:
    """New words take indices from the old OOV index on; OOV moves to the end."""
    old_oov = oov_index(vocab)
    placed, tot = with_global_prefix(fresh, order, {"__before": F.lit(1).cast("long")})
    if not tot["__before"]:
        return vocab
    words = vocab.filter(F.col("token") != OOV).select("token", "idx").unionByName(
        placed.select("token", (F.col("__before") + F.lit(old_oov)).alias("idx")))
    mark = vocab.sparkSession.createDataFrame([(OOV, max(old_oov, vocab_size(vocab) - 1) + tot["__before"])], "token string, idx long")
    return stable(words.unionByName(mark))


def merge_vocab(base: DataFrame, other: DataFrame, remap: bool = True) -> DataFrame:
    """Shared vocabulary: the other's unseen words follow the base's, in their own order.
    Without remapping, words keep the index that is their own value."""
    fresh = other.filter(~F.col("token").isin(PAD, OOV)).join(base.select("token"), "token", "left_anti")
    if not remap:
        words = base.filter(F.col("token") != OOV).unionByName(fresh)
        mark = base.sparkSession.createDataFrame([(OOV, vocab_size(words))], "token string, idx long")
        return stable(words.unionByName(mark))
    return _append(base, fresh, ["idx"])


def extend_vocab(vocab: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Add values not yet known (meta columns, an item pool), in value order."""
    fresh = (values.select(F.col(column).cast("string").alias("token")).filter("token is not null").distinct()
             .join(vocab.select("token"), "token", "left_anti"))
    return _append(vocab, fresh, ["token"])


def oov_index(vocab: DataFrame) -> int:
    return vocab.filter(F.col("token") == OOV).select("idx").first()[0]


def vocab_size(vocab: DataFrame) -> int:
    return vocab.agg(F.max("idx") + 1).first()[0]


def encode_category(df: DataFrame, column: str, vocab: DataFrame, out: str | None = None,
                    oov: int | None = None) -> DataFrame:
    """Token to index, unknown to OOV. The join is broadcast only if Spark finds the
    vocabulary below its size threshold; otherwise it shuffles and AQE splits hot tokens."""
    oov = oov_index(vocab) if oov is None else oov
    v = vocab.select(F.col("token").alias("__tok"), F.col("idx").alias("__idx"))
    joined = df.join(v, F.col(column).cast("string") == F.col("__tok"), "left")
    return joined.withColumn(out or column, F.coalesce("__idx", F.lit(oov)).cast("long")).drop("__tok", "__idx")


def encode_sequence(df: DataFrame, column: str, vocab: DataFrame, max_len: int, splitter: str = "^",
                    padding: str = "post", na_value: str = "", oov: int | None = None, out: str | None = None) -> DataFrame:
    """`df` with the column encoded as a fixed-width array; rows need no key.

    Each distinct sequence is encoded once under a digest of 16 bytes: what survives truncation leaves its task
    once per digest, is exploded, looked up and regrouped by digest, and joined back by digest. Histories that
    many rows of a request share are so encoded once; null reads as the empty sequence.
    """
    oov = oov_index(vocab) if oov is None else oov
    kept = F.coalesce(F.col(column).cast("string"), F.lit(""))
    toks = text.truncate(text.tokens(kept, splitter), max_len, padding)
    # distinct rows are hashed, where a first value of each key would sort all rows of a task
    seqs = df.select(text.content_key(kept).alias("__key"), toks.alias("__toks")).distinct()
    exploded = seqs.select("__key", F.posexplode("__toks").alias("__pos", "__tok"))
    v = vocab.select(F.col("token").alias("__tok"), F.col("idx").alias("__idx"))
    code = F.when(F.col("__tok") == na_value, F.lit(0)).otherwise(F.coalesce("__idx", F.lit(oov))).cast("int")
    coded = exploded.join(v, "__tok", "left").select("__key", "__pos", code.alias("__code"))
    rows = coded.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__pos", "__code"))).alias("__s"))
    codes = rows.select("__key", text.pad(F.transform("__s", lambda s: s["__code"]), max_len, F.lit(0), padding).alias("__codes"))
    return _joined_codes(df, text.content_key(kept), codes, column, out or column, "inner")


def _joined_codes(df: DataFrame, key: Column, codes: DataFrame, column: str, out: str, how: str) -> DataFrame:
    """`df` with the codes of its sequences; where they replace the column, only its digest is shuffled."""
    keyed = df.withColumn("__digest", key)
    if out == column:
        keyed = keyed.drop(column)
    got = keyed.join(codes, F.col("__digest") == F.col("__key"), how)
    names = df.columns if out in df.columns else [*df.columns, out]
    return got.select(*[F.col("__codes").alias(c) if c == out else F.col(f"`{c}`") for c in names])


def recode_lists(df: DataFrame, column: str, vocab: DataFrame, splitter: str = "^", unknown: int = 0) -> DataFrame:
    """`df` with each value of a joined list replaced by its index, order and length kept; null stays null.
    Each distinct list is looked up once, under its digest."""
    value = F.col(f"`{column}`").cast("string")
    lists = df.select(text.content_key(value).alias("__key"), text.tokens(value, splitter).alias("__toks")).filter("__key IS NOT NULL").distinct()
    v = vocab.select(F.col("token").alias("__tok"), F.col("idx").alias("__idx"))
    cells = lists.select("__key", F.posexplode("__toks").alias("__pos", "__tok")).join(v, "__tok", "left")
    rows = cells.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__pos", F.coalesce("__idx", F.lit(unknown)).alias("__code")))).alias("__s"))
    codes = rows.select("__key", text.join_tokens(F.transform("__s", lambda s: s["__code"]), splitter).alias("__codes"))
    return _joined_codes(df, text.content_key(value), codes, column, column, "left")


def decode(df: DataFrame, column: str, vocab: DataFrame, out: str) -> DataFrame:
    v = vocab.select(F.col("idx").alias("__idx"), F.col("token").alias(out))
    return df.join(v, F.col(column) == F.col("__idx"), "left").drop("__idx")


def legacy_vocab(df: DataFrame, columns: list[str], splitter: str | None = None) -> DataFrame:
    """One 1-based vocabulary over several columns that share it, in value order; 0 is unknown."""
    parts = []
    for c in columns:
        col = F.col(c).cast("string")
        parts.append(df.select(F.explode(text.tokens(col, splitter)).alias("token") if splitter else col.alias("token")))
    words = parts[0]
    for p in parts[1:]:
        words = words.unionByName(p)
    words = words.filter((F.col("token") != "") & F.col("token").isNotNull()).distinct()
    return with_row_number(words, [], ["token"], "idx")
