"""The tiles of a cell against every score worked out in numpy, and what is sent to the cells."""

import numpy as np
import pytest

from lumirank.operators import cells as CE, lazy as L, retrieve as RT, scoring


@pytest.mark.parametrize("copies, temperature, prior", [(False, 1.0, False), (True, 0.05, False), (True, 1.0, True)])
def test_tiles_equal_all_pairs(copies, temperature, prior):
    rng = np.random.default_rng(3)
    n, m, k = 2_600, 300, 9
    u, x = rng.normal(size=(m, 8)).astype(np.float32).astype(float), rng.normal(size=(n, 8)).astype(np.float32).astype(float)
    if copies:
        x[900:] = x[:1_700]
        x[:1_200] = x[0]                                             # one very common vector
    order, z, weights = rng.permutation(n), rng.normal(size=n), [0.3, 1.1] if prior else [0.0]
    s = np.round(u @ x.T / temperature, 9)
    views = [np.round(s + w * z, 9) if w else s for w in weights]
    per = rng.integers(0, 4, m)
    row, col = np.repeat(np.arange(m), per), rng.integers(0, n, per.sum())
    own = np.stack([v[row, col] for v in views], axis=1)
    blocks = [(a, min(a + 700, n)) for a in range(0, n, 700)]
    edges, weight = np.unique(own[:, 0], return_counts=True)
    score = CE.Dots(u, x, temperature, 9, single=not prior)
    tally = CE.Tally(edges, weight, 9, float(np.abs(views[0]).max()), 10_000)
    scan = CE.Scan(score, blocks, np.ones((m, len(blocks)), bool), order, z, weights)
    got, higher, tied, before = scan.run(k, per=per, own=own, column=col, before=order[col], tally=tally if prior else None)
    by = np.argsort(order)
    assert (got[1].reshape(m, k)[np.argsort(got[0].reshape(m, k)[:, 0])] == by[CE.best(views[0][:, by], k)]).all()
    for v, y in enumerate(views):
        y = y[row].copy()
        y[np.arange(len(row)), col] = np.nan
        assert (higher[:, v] == (y > own[:, v, None]).sum(axis=1)).all()
        assert (tied[:, v] == (y == own[:, v, None]).sum(axis=1)).all()
        assert (before[:, v] == ((y == own[:, v, None]) & (order < order[col][:, None])).sum(axis=1)).all()
    if not prior:                                                    # single precision can't tell edges apart
        with pytest.raises(ValueError):
            scan.run(k, tally=tally)
        return
    flat = np.sort(views[0].ravel())
    assert tally.flush() == (weight * (2 * flat.size - np.searchsorted(flat, edges) - np.searchsorted(flat, edges, "right"))).sum()


def test_sums_in_double_precision_leave_the_rest_in_single():
    """Scores of double precision are counted as they are, lists and places are told apart in single precision, also 1e-9 apart."""
    rng = np.random.default_rng(6)
    n, m, k = 3_000, 40, 7
    x, u = np.zeros((n, 3)), np.zeros((m, 3))
    x[:, 0], x[:, 1], u[:, 0], u[:, 1] = 1.0, rng.integers(-40, 40, n) * 1e-9, 1.0, 1.0
    z = rng.integers(-3, 3, n) * 1e-9
    s = np.round(u @ x.T, 9)
    views = [s, np.round(s + z, 9)]
    col = rng.integers(0, n, m)
    own, order = np.stack([v[np.arange(m), col] for v in views], axis=1), rng.permutation(n)
    edges, weight = np.unique(own[:, 0], return_counts=True)
    tally = CE.Tally(edges, weight, 9, 1.1, n * m)
    scan = CE.Scan(CE.Dots(u, x, 1.0, 9, single=False), [(0, n)], np.ones((m, 1), bool), order, z, [0.0, 1.0])
    assert scan.kind is np.float32 and scan.score.kind is np.float64
    got, higher, tied, _ = scan.run(k, per=np.ones(m, np.int64), own=own, column=col, tally=tally)
    by = np.argsort(order)
    assert (got[1].reshape(m, k)[np.argsort(got[0].reshape(m, k)[:, 0])] == by[CE.best(s[:, by], k)]).all()
    for v, y in enumerate(views):
        assert (higher[:, v] == (y > own[:, v, None]).sum(axis=1)).all() and (tied[:, v] == (y == own[:, v, None]).sum(axis=1) - 1).all()
    flat = np.sort(s.ravel())
    assert tally.flush() == (weight * (2 * flat.size - np.searchsorted(flat, edges) - np.searchsorted(flat, edges, "right"))).sum()


def test_a_group_gets_one_copy_of_a_row(spark, monkeypatch):
    """Vectors without neighbourhoods leave every block in reach; a row is not copied for each of them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 12))
    mk = lambda k: spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], f"{k} long, embedding array<float>")
    monkeypatch.setattr(RT, "NEIGHBOURS", 5)                          # 40 blocks
    routed, route = [], RT._route
    monkeypatch.setattr(RT, "_route", lambda *a: routed.append(route(*a)) or routed[-1])
    s = np.round(x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T, 9)
    top = RT.exact_top_k(mk("request_id"), mk("item_id"), 3)
    assert sorted((r.request_id, r.item_id) for r in top.collect()) == sorted((r, c) for r in range(200) for c in np.argsort(-s[r], kind="stable")[:3].tolist())
    p = spark.createDataFrame([(r, (r * 7 + d) % 200) for r in range(200) for d in range(3)], "request_id long, item_id long")
    places = {(r.request_id, r.item_id): r.higher for r in RT.positive_places(mk("request_id"), p, mk("item_id")).collect()}
    assert places == {(r, c): int((s[r] > s[r, c]).sum()) for r in range(200) for c in ((r * 7 + d) % 200 for d in range(3))}
    assert [x.count() for x in routed] == [200, 200, 400]              # places: one more row for what is counted as a whole


def test_cells_send_one_sum_for_the_auc(spark, monkeypatch):
    """A cell used to send a count for each score of a positive that it met."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 5)), rng.random((60, 60)) < 0.1
    mk = lambda k: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{k} long, embedding array<double>")
    pos = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(y))], "request_id long, item_id long")
    found, visit = [], L._visit
    monkeypatch.setattr(L, "_visit", lambda *a: found.append(visit(*a)) or found[-1])
    s = np.round(x @ x.T, 9)
    got = L.rank_all(L.LazyCandidates(mk("request_id"), mk("item_id"), pos), scoring.VectorScorer(), 3, global_auc=True)
    a, b = s[y], s[~y]
    assert got.auc == pytest.approx(float(np.mean((a[:, None] > b) + 0.5 * (a[:, None] == b))), abs=1e-12)
    assert found[0].filter("kind = 2").count() < len(np.unique(a)) / 4     # one a cell, and one a partition for what is counted as a whole
