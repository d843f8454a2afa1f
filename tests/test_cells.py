"""Work that is reduced inside a task: batch losses, distances by cells, stacked determinants; and ids of texts."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumirank.functions import numeric as N
from lumirank.operators import diversity as D, ordering as O, sampling as SA, vocab as VO


@pytest.mark.parametrize("n, batch", [(50, 16), (33, 32), (5, 100)])
def test_in_batch_losses_equal_all_pairs(spark, n, batch):
    rng = np.random.default_rng(n)
    u, v = rng.normal(size=(n, 4)), rng.normal(size=(n, 4)) * 20
    df = spark.createDataFrame([(int(i), int(n - i), u[i].tolist(), v[i].tolist()) for i in range(n)], "k long, o long, u array<double>, v array<double>").repartition(3)
    got = {r.k: r for r in SA.in_batch_losses(df, ["o"], "k", batch, "u", "v", gap=2.0, temperature=0.5).collect()}
    assert len(got) == n
    for i in range(n):
        place = n - 1 - i                                    # order is by n - i
        others = [n - 1 - p for p in range(place // batch * batch, min(place // batch * batch + batch, n)) if p != place]
        r = got[i]
        assert r.n_neg == len(others)
        if not others:
            assert r.bpr is None and r.softmax_ce is None
            continue
        lead = np.array([u[i] @ v[j] - u[i] @ v[i] for j in others]) / 0.5
        assert r.bpr == pytest.approx(np.logaddexp(0, lead).mean()) and r.hinge == pytest.approx(np.maximum(2 + lead, 0).mean())
        top = max(0.0, lead.max())
        assert r.softmax_ce == pytest.approx(top + np.log(np.exp(-top) + np.exp(lead - top).sum()))


def test_distances_by_cells(spark, monkeypatch):
    monkeypatch.setattr(SA, "DISTANCE_BLOCK", 13)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 5))
    x[50:60] = x[:10]                                        # equal vectors
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, e array<double>").repartition(4)
    got = SA.pair_distance(df, "k", "e", 10_000).first()
    d = [np.linalg.norm(x[i] - x[j]) for i in range(70) for j in range(i)]
    assert got.pairs == len(d) and got.mean_distance == pytest.approx(np.mean(d))
    assert SA.pair_distance(df, "k", "e", 100).first().pairs == 100
    assert SA.pair_distance(df.limit(1), "k", "e", 100).first().pairs == 0


def test_all_distances_without_a_cap(spark, monkeypatch):
    monkeypatch.setattr(SA, "DISTANCE_BLOCK", 11)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5)) + 1e4                       # far from the origin and close together: squares cancel out
    x[30:] = x[:10] + 1e-6
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, e array<double>").repartition(3)
    got = SA.pair_distance(df, "k", "e").first()
    d = [np.linalg.norm(x[i] - x[j]) for i in range(40) for j in range(i)]
    assert got.pairs == len(d) and got.mean_distance == pytest.approx(np.mean(d), abs=1e-9)


@pytest.mark.parametrize("kernel", ["gram", "rbf", "cosine"])
def test_lists_of_all_lengths_are_stacked(spark, kernel):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(rng.normal()), rng.normal(size=6).tolist()) for g in range(30) for i in range(1 + g % 5)]
    rows += [(99, i, 0.5, [1.0] * 6) for i in range(3)]      # equal vectors
    df = spark.createDataFrame(rows, "g long, item_id long, score double, embedding array<double>").repartition(3)
    got = {r.g: r for r in D.list_quality(df, "g", 4, 0.6, 1e-3, kernel, 0.5).collect()}
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:4]
        x, s = np.array([r[3] for r in best]), np.array([r[2] for r in best])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        w, cos = 1 / (1 + np.exp(-s)), x @ x.T
        k = {"gram": np.outer(w, w) * cos, "rbf": np.exp(-0.5 * (2 - 2 * cos)), "cosine": (1 + cos) / 2}[kernel]
        det = np.linalg.slogdet(k + 1e-3 * np.eye(len(s)))[1] / len(s)
        assert (got[g].n, got[g].mean_score, got[g].logdet, got[g].quality) == pytest.approx((len(s), w.mean(), det, 0.6 * w.mean() + 0.4 * det))


def test_blake_ids(spark):
    texts = ["a", "b", "a", "", None, "日本", "a" * 9000]
    got = [r.i for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(N.blake_id(F.col("t")).alias("i")).collect()]
    want = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") & (2**63 - 1) if t else -1 for t in texts]
    assert got == want


def test_lists_are_recoded_in_place(spark):
    vocab = spark.createDataFrame([("x", 1), ("y", 2)], "token string, idx long")
    df = spark.createDataFrame([(1, "x^y^x"), (2, "z^x"), (3, None), (4, "x^y^x"), (5, "")], "k long, v string")
    assert {r.k: r.v for r in VO.recode_lists(df, "v", vocab).collect()} == {1: "1^2^1", 2: "0^1", 3: None, 4: "1^2^1", 5: "0"}


def test_segmented_prefix(spark):
    rows = [(s, i % 7, i) for s, n in (("a", 500), ("b", 1), ("c", 90)) for i in range(n)]
    got, totals = O.with_segmented_prefix(spark.createDataFrame(rows, "s string, o long, v long").repartition(5), "s", ["o", "v"], {"before": F.lit(1).cast("long"), "sum": F.col("v")})
    want = set()
    for s in "abc":
        run = 0
        for k, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: r[1:])):
            want.add((*r, k, run))
            run += r[2]
    assert set(map(tuple, got.select("s", "o", "v", "before", "sum").collect())) == want
    assert totals == {"a": {"before": 500, "sum": 124750}, "b": {"before": 1, "sum": 0}, "c": {"before": 90, "sum": 4005}}


def test_log_conversion(spark):
    from lumirank.plans import jobs as J
    from lumirank.sources import clicklog as CL
    kind = CL.read_skeleton.__globals__["triples"]
    def text(*cells):
        return CL.BETWEEN.join(f"{f}{CL.AFTER_FIELD}{i}{CL.AFTER_ID}{v}" for f, i, v in cells)
    def frame(rows, cols):
        return spark.createDataFrame(rows, cols)
    sk = frame([("1", 1, 0, "b1", text(("101", "7", "1.0"), ("508", "q", "2.5"))), ("2", 0, 1, "b1", text(("101", "9", "1.0"))),       # dropped: a purchase without a click
                ("3", 1, 1, "b2", text(("101", "5", "1.0"), ("101", "7", "1.0"))), ("4", 0, 0, "b2", text(("101", "zz", "1.0")))], "sample string, click int, purchase int, bundle string, t string")
    bundles = frame([("b1", text(("121", "u1", "1.0"))), ("b2", text(("121", "5", "1.0")))], "bundle string, t string").select("bundle", kind(F.col("t")).alias("shared"))
    sk = sk.withColumn("own", kind(F.col("t"))).drop("t")
    logs = {"train": (sk.filter("sample IN (1, 2, 3)"), bundles), "test": (sk.filter("sample = 4").union(sk.filter("sample = 4").withColumn("sample", F.lit("5"))), bundles)}
    got = J.convert_logs(logs, ["101", "121"], ["508"], {"121": "101"})
    rows = {n: sorted(map(tuple, d.select("sample", "click", "purchase", "101", "121", "D508").collect())) for n, d in got["tables"].items()}
    # one vocabulary: 5, 7, u1 of train, then zz of test
    assert rows["train"] == [("1", 1, 0, "2", "3", 2.5), ("3", 1, 1, "1^2", "1", 0.0)]
    assert sorted(rows["valid"] + rows["test"]) == [("4", 0, 0, "4", "1", 0.0), ("5", 0, 0, "4", "1", 0.0)] and len(rows["valid"]) == len(rows["test"]) == 1
    assert dict(got["tables"]["valid"].dtypes)["click"] == "tinyint"
