"""Hand-computed and brute-force metric values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumirank.operators import classification as C, diversity as D, losses as L, ranking_metrics as R


def frame(spark, data):
    return spark.createDataFrame([(1, i, float(s), float(l)) for i, (s, l) in enumerate(data)],
                                 "request_id long, item_id long, score double, label double")


def test_ties_put_positives_last(spark):
    m = R.per_request(frame(spark, [(0.9, 0), (0.5, 1), (0.5, 0), (0.1, 1)]), [1, 2, 3]).first()
    assert m.mrr == pytest.approx(1 / 3)
    assert m.gauc == pytest.approx((0.5 + 0) / 4)       # of 4 pairs only the tie gives a half
    assert (m.recall_1, m.recall_2, m.recall_3) == (0, 0, 0.5)
    assert m.ndcg_3 == pytest.approx((1 / math.log2(4)) / (1 + 1 / math.log2(3)))


def test_perfect_order(spark):
    m = R.per_request(frame(spark, [(0.9, 1), (0.8, 1), (0.1, 0)]), [1, 2]).first()
    assert (m.mrr, m.gauc, m.recall_1, m.recall_2, m.ndcg_2) == (1, 1, 0.5, 1, 1)


def test_request_without_positive_and_denominators(spark):
    d = frame(spark, [(0.9, 1), (0.1, 0)]).unionByName(frame(spark, [(0.3, 0), (0.2, 0)]).withColumn("request_id", F.lit(2).cast("long")))
    per = R.per_request(d, [1])
    assert R.averages(per, [1], "all").first().recall_1 == 0.5
    assert R.averages(per, [1], "with_positive").first().recall_1 == 1.0
    with pytest.raises(ValueError):
        R.averages(per, [1], "other")


def test_top_k_metrics_need_k_rows(spark):
    m = R.per_request(frame(spark, [(0.9, 1), (0.1, 0)]), [], top_k=3).first()
    assert m.mrr_at_3 is None and m.pos_in_top == 1


def test_random_groups_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = [(int(r), int(i), float(s), float(y)) for i, (r, s, y) in enumerate(
        zip(rng.integers(0, 30, 600), rng.integers(0, 12, 600) / 10, rng.integers(0, 4, 600) == 0))]
    d = spark.createDataFrame(data, "request_id long, item_id long, score double, label double")
    got = {r.request_id: r for r in R.per_request(d, [3]).collect()}
    for req in {x[0] for x in data}:
        g = sorted([x for x in data if x[0] == req], key=lambda x: (-x[2], x[3], x[1]))
        pos, neg = [x[2] for x in g if x[3]], [x[2] for x in g if not x[3]]
        auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) if pos and neg else 0
        assert got[req].gauc == pytest.approx(auc)
        assert got[req].recall_3 == pytest.approx(sum(x[3] for x in g[:3]) / len(pos) if pos else 0)


def test_auc_and_average_precision(spark):
    d = frame(spark, [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)])
    r = C.auc(d).first()
    assert r.auc == pytest.approx(0.75) and r.average_precision == pytest.approx(0.8333333)
    assert C.auc(frame(spark, [(0.1, 0), (0.2, 0)])).first().auc is None


def test_group_auc_skips_one_class_groups(spark):
    d = spark.createDataFrame([("a", 0.9, 1.0), ("a", 0.1, 0.0), ("b", 0.5, 1.0), ("b", 0.4, 1.0), ("c", 0.2, 1.0), ("c", 0.3, 0.0), ("c", 0.1, 0.0)],
                              "g string, score double, label double")
    r = C.group_auc(d, "g").first()
    assert r.gauc == pytest.approx((1.0 * 2 + 0.5 * 3) / 5) and r.avg_auc == pytest.approx(0.75)
    assert (r.gauc_valid_groups, r.gauc_valid_samples) == (2, 5)


def test_slice_with_one_class_has_auc_zero(spark):
    d = spark.createDataFrame([("a", 0.9, 1.0), (None, 0.2, 1.0), (None, 0.1, 0.0)], "f string, score double, label double")
    got = {r.f: r for r in C.slice_metrics(d, "f").collect()}
    assert got["a"].auc == 0.0 and got[None].auc == 1.0 and got[None].ratio == pytest.approx(200 / 3)


def test_metric_names_are_parsed_not_evaluated():
    assert C.resolve_metric("NDCG(3)") == ("NDCG", 3)
    assert C.resolve_metric("NDCG@5") == ("NDCG", 5)
    assert C.resolve_metric("NDCG") == ("NDCG", 1)
    for bad in ("NDCG(0)", "NDCG(__import__('os'))", "eval", "NDCG@", None):
        with pytest.raises(NotImplementedError):
            C.resolve_metric(bad)


def test_diversity_counts_pairs(spark):
    d = spark.createDataFrame([(1, i, 1.0 - i / 10, 0.0, c, b) for i, (c, b) in enumerate([("x", 1.0), ("x", 2.0), ("y", 2.0), ("x", float("nan"))])],
                              "request_id long, item_id long, score double, label double, c string, b double")
    r = D.list_diversity(d, ["c", "b"], [2, 3, 9]).first()
    assert r.diversity_2 == pytest.approx(1 - 1 / 2)
    assert r.diversity_3 == pytest.approx(1 - (1 + 1) / (2 * 3))
    assert r.diversity_9 == pytest.approx(1 - (3 + 1) / (2 * 6))


def test_list_quality_uses_probabilities(spark):
    d = spark.createDataFrame([(1, i, 0.0, [1.0 if j == i else 0.0 for j in range(3)]) for i in range(3)], "g long, item_id long, score double, embedding array<double>")
    r = D.list_quality(d, "g", 3, theta=1.0).first()
    assert r.quality == pytest.approx(0.5)                      # sigmoid of a zero logit
    assert D.list_quality(d, "g", 3, theta=1.0, scores_are_logits=False).first().quality == pytest.approx(0.0)
    assert D.list_quality(d, "g", 3, theta=0.0, eps=0.0).first().quality == pytest.approx(math.log(0.25 ** 3) / 3)
    assert D.list_quality(d, "g", 3, theta=0.0, eps=0.0, kernel="rbf").first().logdet < 0


def test_list_quality_singular_is_zero(spark):
    d = spark.createDataFrame([(1, i, 0.3, [1.0, 0.0]) for i in range(3)], "g long, item_id long, score double, embedding array<double>")
    assert D.list_quality(d, "g", 3, theta=0.0, eps=0.0, kernel="cosine").first().logdet == 0.0


def test_losses_stay_finite(spark):
    p = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 900.0), (2, -900.0, 0.0)], "a long, pos_score double, neg_score double")
    r = L.pairwise_losses(p, "a").first()
    assert r.bpr == pytest.approx((math.log1p(math.exp(-1)) + 898 + 900) / 3)
    assert r.softmax_ce == pytest.approx((898 + 900) / 2)
    assert r.hinge == pytest.approx((0 + 899 + 901) / 3)


def test_agreement_losses(spark):
    d = spark.createDataFrame([(1.0, 1.0), (-2.0, -2.0)], "s double, t double")
    r = L.agreement_losses(d, "s", "t").first()
    assert (r.mse, r.kl) == (0, 0) and r.cosine_distance == pytest.approx(0)
    with pytest.raises(ValueError):
        L.agreement_losses(d, "s", "t", 0)


def test_multitask_mean(spark):
    d = spark.createDataFrame([(1.0, 0.9, 0.0, 0.6), (0.0, 0.2, 1.0, 0.3)], "y1 double, s1 double, y2 double, s2 double")
    got = {r.task: r.auc for r in C.multitask(d, {"a": ("y1", "s1"), "b": ("y2", "s2")}).collect()}
    assert got == {"a": 1.0, "b": 0.0, "all": 0.5}
