"""All-items candidates: lists, places, metrics and the global AUC against every pair worked out in numpy."""

import math

import numpy as np
import pytest

from lumirank.operators import lazy as L, ranking_metrics as R, retrieve, scoring

N_REQ, N_ITEM, DIM = 40, 150, 6


def world(spark, seed=0, clusters=0, n_items=N_ITEM, ties=True):
    rng = np.random.default_rng(seed)
    if clusters:
        mid = rng.normal(size=(clusters, DIM)) * 5
        u = mid[rng.integers(0, clusters, N_REQ)] + rng.normal(size=(N_REQ, DIM)) * 0.1
        x = mid[rng.integers(0, clusters, n_items)] + rng.normal(size=(n_items, DIM)) * 0.1
    else:
        u, x = rng.normal(size=(N_REQ, DIM)), rng.normal(size=(n_items, DIM))
    if ties:
        x[n_items // 2:n_items // 2 + 20] = x[:20]                   # items with equal vectors
    pop = rng.integers(0, 9, n_items)
    cat = rng.integers(0, 4, (n_items, 2))
    labels = rng.random((N_REQ, n_items)) < 0.04
    labels[::5] = False                                              # requests without a positive
    req = spark.createDataFrame([(int(r), v.tolist()) for r, v in enumerate(u)], "request_id long, embedding array<double>")
    pool = spark.createDataFrame([(int(i) * 3 + 1, x[i].tolist(), int(cat[i, 0]), int(cat[i, 1])) for i in range(n_items)],
                                 "item_id long, embedding array<double>, c0 int, c1 int")
    pos = spark.createDataFrame([(int(r), int(i) * 3 + 1) for r, i in zip(*np.nonzero(labels))], "request_id long, item_id long")
    popularity = spark.createDataFrame([(int(i) * 3 + 1, int(p)) for i, p in enumerate(pop) if p], "item_id long, popularity long")
    rel = L.with_priors(L.LazyCandidates(req, pool, pos), popularity)
    z = np.log1p(pop.astype(float))
    prior = (z - z.mean()) / z.std()
    return rel, u, x, labels, pop, prior, cat


def auc(pos, neg):
    if not len(pos) or not len(neg):
        return 0.0
    return float(np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])))


def by_hand(scores, labels, ks, k, order=None):
    """Mean metrics over requests with a positive; ties: positives last, or a fixed order of the items."""
    out = {}
    for s, y in zip(scores, labels):
        if not y.any():
            continue
        o = order if order is not None else np.lexsort((np.arange(len(s)), y, -s))
        ys, ss = y[o], s[o]
        first = int(np.flatnonzero(ys)[0]) + 1
        m = {"mrr": 1 / first, "gauc": auc(ss[ys], ss[~ys])}
        for n in ks:
            ideal = sum(1 / math.log2(i + 2) for i in range(min(int(y.sum()), n)))
            m[f"recall_{n}"] = ys[:n].sum() / y.sum()
            m[f"ndcg_{n}"] = sum(1 / math.log2(i + 2) for i in np.flatnonzero(ys[:n])) / ideal
        if ys[:k].any():
            m[f"mrr_at_{k}"], m[f"gauc_at_{k}"] = 1 / first, auc(ss[:k][ys[:k]], ss[:k][~ys[:k]])
        for name, v in m.items():
            out.setdefault(name, []).append(v)
    return {n: float(np.mean(v)) for n, v in out.items()}


def values(long):
    return {r.metric: r.value for r in long.collect()}


@pytest.mark.parametrize("clusters, weight, bias", [(0, 0.7, 0.0), (6, -0.4, 0.2)])
def test_report_equals_all_pairs(spark, monkeypatch, clusters, weight, bias):
    monkeypatch.setattr(L, "NEIGHBOURS", 12)                         # many blocks
    monkeypatch.setattr(L, "CHUNK", 2)                               # a request's positives in several rows
    rel, u, x, labels, pop, prior, cat = world(spark, 1 + clusters, clusters)
    got = L.lazy_report(rel, scoring.VectorScorer(), [1, 5, 20], 20, weight, bias, ["c0", "c1"], global_auc=True, pool_diversity=True)
    base = np.round(np.round(u @ x.T, 9) + bias * prior, 9)
    want = by_hand(base, labels, [1, 5, 20], 20)
    want |= {f"popularity_blend_{n}": v for n, v in by_hand(np.round(np.round(u @ x.T, 9) + (bias + weight) * prior, 9), labels, [1, 5, 20], 20).items()}
    order = np.lexsort((np.arange(len(pop)), -pop))
    want |= {f"popularity_{n}": v for n, v in by_hand(np.tile(pop.astype(float), (N_REQ, 1)), labels, [1, 5, 20], 20, order).items()}
    want["auc"] = auc(base[labels], base[~labels])
    tops = np.array([np.lexsort((np.arange(len(s)), -s))[:20] for s in base])
    for n in (5, 20):
        per = [1 - np.mean([(cat[a] == cat[b]).mean() for i, a in enumerate(t[:n]) for j, b in enumerate(t[:n]) if i != j]) for t, y in zip(tops, labels) if y.any()]
        want[f"diversity_{n}"] = float(np.mean(per))
    held = [r for r in range(N_REQ) if labels[r][tops[r]].any()]
    s, y = (np.concatenate([m[r][tops[r]] for r in held]) for m in (base, labels))
    want["auc_at_20"] = auc(s[y], s[~y])
    m = values(got["metrics"])
    assert m["requests"] == N_REQ and m["requests_with_positive"] == labels.any(axis=1).sum()
    assert {n for n in m if n not in want} == {"requests", "requests_with_positive", "pool_diversity"}
    for n, v in want.items():
        assert m[n] == pytest.approx(v, abs=1e-9), n
    lists = {}
    for r in got["top"].collect():
        lists.setdefault(r.request_id, []).append((r["rank"], r.item_id, r.label))
    for r in range(N_REQ):
        assert [(i, y) for _, i, y in sorted(lists[r])] == [(t * 3 + 1, int(labels[r, t])) for t in tops[r]]


def test_bounds_leave_cells_out(spark, monkeypatch):
    monkeypatch.setattr(L, "NEIGHBOURS", 12)
    rel, u, x, labels, *_ = world(spark, 3, clusters=6, ties=False)
    cells = N_REQ * math.ceil(N_ITEM / 12)
    got = L.rank_all(rel, scoring.VectorScorer(), 5)
    assert sum(got.visits) < 0.8 * cells                             # lists, and a place for every positive wherever it scores
    lists = L.rank_all(L.LazyCandidates(rel.requests, rel.pool, rel.positives.limit(0)), scoring.VectorScorer(), 5)
    assert sum(lists.visits) < 0.5 * cells
    assert sorted(map(tuple, lists.top.collect())) == sorted(map(tuple, got.top.collect()))


def test_edges_in_several_passes(spark, monkeypatch):
    rel, u, x, labels, *_ = world(spark, 4)
    monkeypatch.setattr(L, "EDGES", 37)
    base = np.round(u @ x.T, 9)
    assert L.rank_all(rel, scoring.VectorScorer(), 3, global_auc=True).auc == pytest.approx(auc(base[labels], base[~labels]), abs=1e-12)
    monkeypatch.setattr(L, "NEIGHBOURS", 12)
    assert L.rank_all(rel, scoring.VectorScorer(), 3, global_auc=True).auc == pytest.approx(auc(base[labels], base[~labels]), abs=1e-12)


def test_pair_models_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_BLOCK", 30)
    monkeypatch.setattr(L, "USER_BLOCK", 9)
    rng = np.random.default_rng(5)
    a, b, v = rng.integers(0, 9, N_REQ), rng.integers(0, 9, 100), rng.integers(0, 3, (100, 2))
    labels = rng.random((N_REQ, 100)) < 0.05
    req = spark.createDataFrame([(i, int(x)) for i, x in enumerate(a)], "request_id long, a int")
    pool = spark.createDataFrame([(i, int(x), [float(y) for y in z]) for i, (x, z) in enumerate(zip(b, v))], "item_id long, b int, v array<double>")
    pos = spark.createDataFrame([(int(r), int(i)) for r, i in zip(*np.nonzero(labels))], "request_id long, item_id long")

    def pair_model():
        return lambda f: (f["a"] * f["b"] % 7 + f["v"][:, 0]).astype(float)

    s = (a[:, None] * b[None] % 7 + v[None, :, 0]).astype(float)
    got = L.lazy_report(L.LazyCandidates(req, pool, pos), scoring.PairScorer(pair_model, ["a"], ["b", "v"], max_rows=64), [3, 10], 10, global_auc=True)
    m, want = values(got["metrics"]), by_hand(s, labels, [3, 10], 10)
    for n, x in want.items():
        assert m[n] == pytest.approx(x, abs=1e-9), n
    assert m["auc"] == pytest.approx(auc(s[labels], s[~labels]), abs=1e-12)
    assert [r.item_id for r in got["top"].filter("request_id = 7").orderBy("rank").collect()] == np.lexsort((np.arange(100), -s[7]))[:10].tolist()


def test_lists_of_equal_requests_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_BLOCK", 30)
    visits = []
    run = L.rank_all
    monkeypatch.setattr(L, "rank_all", lambda *a, **k: (lambda r: visits.extend(r.visits) or r)(run(*a, **k)))
    rng = np.random.default_rng(8)
    a, b = [int(x) if x else None for x in rng.integers(0, 4, N_REQ)], rng.integers(0, 9, 100)
    req = spark.createDataFrame(list(enumerate(a)), "request_id long, a int").repartition(3)
    pool = spark.createDataFrame([(i, int(x)) for i, x in enumerate(b)], "item_id long, b int")
    pos = spark.createDataFrame([(1, 2), (1, 3), (5, 7), (5, 7)], "request_id long, item_id long")

    def pair_model():
        return lambda f: np.nan_to_num(f["a"].astype(float), nan=5.0) * f["b"] % 7

    rel = L.LazyCandidates(req, pool, pos)
    got = L.top_lists(rel, scoring.PairScorer(pair_model, ["a"], ["b"]), 8)
    cells = sum(visits)
    whole = L.lazy_report(rel, scoring.PairScorer(pair_model, ["a"], ["b"]), [8], 8)["top"]
    assert got.columns == whole.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert cells == len(set(a)) * 4 and sum(visits) - cells >= N_REQ * 4     # four blocks of items
    vectors, *_ = world(spark, 9)
    assert sorted(map(tuple, L.top_lists(vectors, scoring.VectorScorer(), 5).collect())) == sorted(map(tuple, L.lazy_report(vectors, scoring.VectorScorer(), [5], 5)["top"].collect()))


def test_bootstrap_of_a_log(spark):
    log = spark.createDataFrame([(1, 10, 0.0, 1, 5), (1, 11, 1.0, 2, 6), (2, 10, 0.0, 3, 7), (3, 99, 2.0, 4, 8), (4, 12, 1.0, 5, 9), (4, 12, 1.0, 6, 1)],
                                "imp long, item long, y double, at long, f int")
    pool = spark.createDataFrame([(10,), (11,), (12,), (12,), (None,)], "item_id long")
    rel = L.all_items_candidates(log, "imp", "item", "y", ["at"], pool, ["f"])
    assert sorted(map(tuple, rel.requests.collect())) == [(1, 6 - 1), (3, 8), (4, 9)]
    assert sorted(map(tuple, rel.positives.collect())) == [(1, 11), (4, 12)]
    assert rel.metadata == {"strategy": "all_items", "requests": 3, "items": 3, "estimated_candidates": 9, "positives": 2,
                            "ignored_positives": 1, "positive_requests_only": True}
    assert L.all_items_candidates(log, "imp", "item", "y", ["at"], pool, positive_requests_only=False).metadata["requests"] == 4
    assert [r.request_id for r in L.all_items_candidates(log, "imp", "item", "y", ["at"], pool, max_candidate_rows=6).requests.orderBy("request_id").collect()] == [1, 3]
    assert L.all_items_candidates(log, "imp", "item", "y", ["at"], pool, max_requests=1).metadata["requests"] == 1


def test_empty_relations(spark):
    rel, *_ = world(spark, 6)
    none = L.LazyCandidates(rel.requests.limit(0), rel.pool, rel.positives.limit(0))
    assert L.rank_all(none, scoring.VectorScorer(), 3).top.count() == 0
    no_pool = L.LazyCandidates(rel.requests, rel.pool.limit(0), rel.positives.limit(0))
    assert L.rank_all(no_pool, scoring.VectorScorer(), 3, global_auc=True).auc is None
    no_pos = L.lazy_report(L.LazyCandidates(rel.requests, rel.pool, rel.positives.limit(0)), scoring.VectorScorer(), [5], 5, global_auc=True)
    m = values(no_pos["metrics"])
    assert m["requests_with_positive"] == 0 and m["mrr"] == 0 and m["auc"] is None and no_pos["top"].count() == N_REQ * 5
    with pytest.raises(ValueError):
        L.rank_all(L.LazyCandidates(rel.requests, rel.pool.drop("prior"), rel.positives), scoring.VectorScorer(), 3, [0.5])


# ---------------------------------------------------------------- batched scorers

def test_batch_scorer_caps_rows_and_loads_once(spark):
    loads, rows = spark.sparkContext.accumulator(0), []

    def load():
        import os
        loads.add(1)
        # a score that names the process and how many rows the call had
        return lambda f: np.full(len(f["x"]), os.getpid() * 1000.0 + len(f["x"]))

    got = scoring.BatchScorer(load, ["x"], max_rows=64)(spark.range(1000).selectExpr("id", "id * 2 AS x", "'old' AS score").repartition(3))
    for _ in range(4):                                               # later tasks find the model of their worker
        rows += [r.score for r in got.collect()]
    assert got.columns == ["id", "x", "score"] and max(s % 1000 for s in rows) == 64
    assert loads.value == len({s // 1000 for s in rows})


def test_batch_scorer_refuses_wrong_sizes(spark):
    scorer = scoring.BatchScorer(lambda: lambda f: f["x"][:1], ["x"])
    with pytest.raises(Exception, match="scores for"):
        scorer(spark.range(5).selectExpr("id AS x")).collect()
    with pytest.raises(ValueError):
        scoring.BatchScorer(lambda: None, ["y"])(spark.range(5))


def test_model_is_loaded_once_for_many_calls():
    loads = []

    def load():
        loads.append(1)
        return lambda f: f["x"] * 2.0
    scorer = scoring.BatchScorer(load, ["x"], max_rows=3)
    for _ in range(5):                                               # tasks and retries of one process
        assert scorer.score_arrays({"x": np.arange(10.0)}, 10).tolist() == (np.arange(10.0) * 2).tolist()
    assert len(loads) == 1


def test_pair_scorer_bounds_both_sides():
    sizes = []

    def load():
        def run(f):
            sizes.append(len(f["a"]))
            return f["a"] * 10.0 + f["b"]
        return run
    p = scoring.PairScorer(load, ["a"], ["b"], max_rows=7)
    got = p.matrix({"a": np.arange(4.0)}, {"b": np.arange(9.0)}, 4, 9)
    assert np.array_equal(got, np.arange(4.0)[:, None] * 10 + np.arange(9.0)) and max(sizes) <= 7
    p.matrix({"a": np.arange(5.0)}, {"b": np.arange(3.0)}, 5, 3)
    assert max(sizes) <= 7
