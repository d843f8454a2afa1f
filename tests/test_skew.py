"""Split groups give the same numbers as plain windows, with one group holding a third of the rows."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lumirank.operators import classification as C, ordering as O, ranking_metrics as R, remap as RM, sampling as SA
from lumirank.operators.ordering import (exact_quantiles, first_per_key, top_k, with_global_prefix, with_prefix,
                                         with_row_number)


@pytest.fixture(scope="module", autouse=True)
def several_pieces(spark):
    """Small ranges are not merged here, so groups do span pieces."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_a_large_group_spans_pieces(skewed):
    pieces = O._ranged_pieces(skewed.filter("request_id = 7"), ["request_id"], order())
    assert pieces.select(O._PIECE).distinct().count() > 2


@pytest.fixture(scope="module")
def skewed(spark):
    i = F.col("id")
    return spark.range(3000).select(
        F.when(i % 3 == 0, 7).otherwise(i % 40).cast("long").alias("request_id"), i.alias("item_id"),
        ((i * 37 % 23) / 10.0).alias("score"), F.when(i * 31 % 11 < 3, 1.0).otherwise(0.0).alias("label"))


def order():
    return [F.col("score").desc(), F.col("label").asc(), F.col("item_id").asc()]


def test_row_numbers_match(skewed):
    plain = with_row_number(skewed, ["request_id"], order(), "r")
    split = with_row_number(skewed, ["request_id"], order(), "r", hot_rows=50)
    assert rows(plain, "item_id", "r") == rows(split, "item_id", "r")
    g = split.groupBy("request_id").agg(F.count("*").alias("n"), F.max("r").alias("m"), F.countDistinct("r").alias("d"))
    assert g.filter("n <> m or n <> d").isEmpty()


def test_prefix_sums_match(skewed):
    sums = {"p": F.col("label").cast("long"), "k": F.lit(1).cast("long")}
    assert rows(with_prefix(skewed, ["request_id"], order(), sums), "item_id", "p", "k") == rows(
        with_prefix(skewed, ["request_id"], order(), sums, hot_rows=50), "item_id", "p", "k")


def test_massive_ties_are_split(spark):
    d = spark.range(2000).select(F.lit(1).alias("request_id"), F.col("id").alias("item_id"), F.lit(0.5).alias("score"),
                                 (F.col("id") % 2).cast("double").alias("label"))
    got = {r.item_id: r.r for r in with_row_number(d, ["request_id"], order(), "r", hot_rows=10).collect()}
    want = sorted(range(2000), key=lambda i: (i % 2, i))
    assert [got[i] for i in want] == list(range(1, 2001))


@pytest.mark.parametrize("tie", ["pessimistic", "seeded"])
def test_metrics_match(skewed, tie):
    a = R.per_request(skewed, [5, 20], top_k=10, tie=tie)
    b = R.per_request(skewed, [5, 20], top_k=10, tie=tie, hot_rows=50)
    assert [tuple(np.round([x or 0 for x in r], 9)) for r in rows(a)] == [tuple(np.round([x or 0 for x in r], 9)) for r in rows(b)]


def test_group_auc_matches(skewed):
    a, b = C.group_auc(skewed, "request_id").first(), C.group_auc(skewed, "request_id", hot_rows=5).first()
    assert a.gauc == pytest.approx(b.gauc) and a.gauc_valid_samples == b.gauc_valid_samples


def test_restricted_matches(skewed):
    d = skewed.withColumn("kept", F.col("item_id") % 2 == 0)
    a, b = (R.per_request(d, [5], restrict="kept", hot_rows=h) for h in (None, 50))
    assert [tuple(np.round(r, 9)) for r in rows(a)] == [tuple(np.round(r, 9)) for r in rows(b)]


def test_remap_of_one_large_feature(skewed):
    used = skewed.select(F.lit("f").alias("feature"), (F.col("item_id") * 2 + 1).alias("id"))
    a, b = RM.remap_table(used), RM.remap_table(used, hot_rows=100)
    assert rows(a) == rows(b)
    assert b.agg(F.max("new_id")).first()[0] == 3000


def test_hard_negatives_of_a_large_request(skewed):
    pos = skewed.filter("label > 0").withColumn("row", F.col("item_id"))
    a, b = (SA.hard(pos, skewed, skewed.select("item_id"), 4, "row", hot_rows=h) for h in (None, 50))
    assert rows(a) == rows(b)
    assert a.filter("neg_item = item_id").isEmpty()
    n = a.groupBy("row").agg(F.count("*").alias("n"), F.countDistinct("neg_item").alias("d"))
    assert n.filter("n <> 4 or d <> 4").isEmpty()


def test_global_prefix(spark):
    d = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"), F.lit(2).cast("long").alias("w"))
    out, tot = with_global_prefix(d, ["k"], {"before": F.col("w")})
    assert tot == {"before": 1000}
    assert rows(out, "k", "before") == [(i, 2 * i) for i in range(500)]


def test_empty_frames(spark):
    e = spark.createDataFrame([], "k long, w long")
    out, tot = with_global_prefix(e, ["k"], {"b": F.col("w")})
    assert tot == {"b": 0} and out.count() == 0
    assert with_row_number(e, ["k"], ["w"], "r").count() == 0
    assert exact_quantiles(e, "w", [0.5]) == {0.5: None}


def test_quantiles_equal_numpy(spark):
    x = np.round(np.random.default_rng(3).normal(size=777), 2)
    d = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = exact_quantiles(d, "v", [0.0, 0.01, 0.37, 0.5, 0.99, 1.0])
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(x, q))


def test_top_k_prunes_before_the_shuffle(skewed):
    plan = top_k(skewed, ["request_id"], order(), 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_first_per_key_is_a_partial_aggregate(skewed):
    out = first_per_key(skewed, ["request_id"], ["score", "item_id"])
    assert "partial_min" in out._jdf.queryExecution().toString()
    best = {}
    for r in skewed.collect():
        best[r.request_id] = min(best.get(r.request_id, (9e9, 9e9)), (r.score, r.item_id))
    assert {r.request_id: (r.score, r.item_id) for r in out.collect()} == best


def test_null_groups_and_deep_top_k_are_split(spark):
    from lumirank.operators.ordering import top_k, with_row_number
    d = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END AS g", "id AS v")
    want = sorted((r.g if r.g is not None else -1, r.v, r.n) for r in d.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY v) AS n").collect())
    got = with_row_number(d, ["g"], ["v"], "n", hot_rows=500)
    assert sorted((r.g if r.g is not None else -1, r.v, r.n) for r in got.collect()) == want
    spark.conf.set("lumirank.hotGroupRows", "500")
    try:
        deep = top_k(d, ["g"], ["v"], 1200).collect()
    finally:
        spark.conf.unset("lumirank.hotGroupRows")
    assert sorted((r.g if r.g is not None else -1, r.v, r["rank"]) for r in deep) == [x for x in want if x[2] <= 1200]
