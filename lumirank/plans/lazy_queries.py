"""Queries that rank whole pools for every request, and models that score in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumirank.operators import lazy as L, scoring
from lumirank.operators.stats import item_popularity
from lumirank.plans import views as V
from lumirank.plans.registry import query, rounded

_FIRST = ["line_no", "item_id", "supp_id", "quantity"]

_USERS = """u AS (SELECT request_id, quantity FROM (SELECT request_id, quantity, max(label) OVER (PARTITION BY request_id) AS any_pos,
    row_number() OVER (PARTITION BY request_id ORDER BY line_no, item_id, supp_id, quantity) AS n FROM lines) WHERE n = 1 AND any_pos > 0),
  pos AS (SELECT DISTINCT request_id, item_id, 1 AS label FROM lines WHERE label > 0)"""
_MODEL = "round(0.02::DOUBLE*size - 0.0005::DOUBLE*retail + 0.001::DOUBLE*size*quantity - 0.01::DOUBLE*abs(size-quantity), 9)"


def _load_model():
    """A model of a user's and an item's columns."""
    import numpy as np

    def model(f):
        size, quantity = f["size"].astype(np.float64), f["quantity"]
        return 0.02 * size - 0.0005 * f["retail"] + 0.001 * size * quantity - 0.01 * np.abs(size - quantity)

    return model


def _bootstrap(spark, sf, pool, **limits):
    src = V.lines(spark, sf).select("request_id", "item_id", "label", "line_no", "supp_id", F.col("quantity").cast("double").alias("quantity"))
    return L.all_items_candidates(src, "request_id", "item_id", "label", _FIRST, pool, ["quantity"], **limits)


@query("c8_all_items", f"""WITH {V.LINES}, {V.ITEMS}, {_USERS}, s AS (SELECT request_id, item_id, {_MODEL} AS score FROM u CROSS JOIN items),
  r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rank FROM s)
  SELECT r.request_id, r.item_id, score, coalesce(label, 0)::INTEGER AS label, rank::INTEGER AS rank FROM r LEFT JOIN pos USING (request_id, item_id) WHERE rank <= 10""")
def _(spark, sf):
    rel = _bootstrap(spark, sf, V.items(spark, sf).select("item_id", "size", "retail"))
    return rounded(L.top_lists(rel, scoring.PairScorer(_load_model, ["quantity"], ["size", "retail"]), 10), 9)


@query("c8_all_items_counts", f"""WITH {V.LINES}, {V.ITEMS}, {_USERS}, pool AS (SELECT item_id FROM items WHERE size < 40), n AS (SELECT count(*) AS n_items FROM pool),
  f AS (SELECT request_id, row_number() OVER (ORDER BY first_line, request_id) AS k FROM (SELECT request_id, min(line_no) AS first_line FROM lines WHERE request_id IN (SELECT request_id FROM u) GROUP BY 1)),
  kept AS (SELECT request_id FROM f WHERE k <= greatest(1, 200000 // (SELECT n_items FROM n))), p AS (SELECT pos.*, pool.item_id AS there FROM pos JOIN kept USING (request_id) LEFT JOIN pool ON pool.item_id = pos.item_id)
  SELECT (SELECT count(*) FROM kept) AS requests, n_items AS items, (SELECT count(*) FROM kept) * n_items AS estimated_candidates,
  (SELECT count(there) FROM p) AS positives, (SELECT count(*) - count(there) FROM p) AS ignored_positives FROM n""")
def _(spark, sf):
    rel = _bootstrap(spark, sf, V.items(spark, sf).filter("size < 40").select("item_id"), max_candidate_rows=200_000)
    names = ["requests", "items", "estimated_candidates", "positives", "ignored_positives"]
    return spark.createDataFrame([tuple(rel.metadata[n] for n in names)], ", ".join(f"{n} long" for n in names))


# ---------------------------------------------------------------- every metric over all items

_KS, _K, _WEIGHT = (5, 10, 20), 20, 0.8


def _view(name: str, scores: str, order: str) -> str:
    """Per-request metrics of all pairs as the table m_<name>, and their means as a_<name>."""
    cols = []
    for k in _KS:
        cols.append(f"sum(label) FILTER (WHERE rank <= {k}) AS h_{k}, sum(label / log2(rank + 1.0)) FILTER (WHERE rank <= {k}) AS d_{k}")
    per = []
    for k in _KS:
        ideal = f"(SELECT sum(1 / log2(i + 1.0)) FROM range(1, {k} + 1) t(i) WHERE i <= g.p)"
        per.append(f"coalesce(h_{k}, 0) / p AS recall_{k}, coalesce(d_{k}, 0) / {ideal} AS ndcg_{k}")
    means = [f"avg({m}) AS {m}" for m in ("mrr", "gauc", *[f"{m}_{k}" for m in ("recall", "ndcg") for k in _KS], f"mrr_at_{_K}", f"gauc_at_{_K}")]
    lost = "sum(p * (above + 0.5 * n))"
    return f""", r_{name} AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {order}) AS rank FROM ({scores})),
  t_{name} AS (SELECT *, coalesce(sum(n) OVER w, 0) AS above, coalesce(sum(ni) OVER w, 0) AS above_in FROM (
    SELECT request_id, score, sum(label) AS p, sum(1 - label) AS n, sum(label) FILTER (WHERE rank <= {_K}) AS pi, sum(1 - label) FILTER (WHERE rank <= {_K}) AS ni FROM r_{name} GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY request_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  l_{name} AS (SELECT request_id, sum(p) AS p, sum(n) AS n, {lost} AS lost, sum(pi) AS pi, sum(ni) AS ni, sum(pi * (above_in + 0.5 * ni)) AS lost_in FROM t_{name} GROUP BY 1),
  h_{name} AS (SELECT request_id, min(rank) FILTER (WHERE label = 1) AS first, {", ".join(cols)} FROM r_{name} GROUP BY 1),
  m_{name} AS (SELECT request_id, 1.0 / first AS mrr, CASE WHEN n > 0 THEN (p * n - lost) / (p * n) ELSE 0 END AS gauc, {", ".join(per)},
    CASE WHEN pi > 0 THEN 1.0 / first END AS mrr_at_{_K}, CASE WHEN pi > 0 THEN CASE WHEN ni > 0 THEN (pi * ni - lost_in) / (pi * ni) ELSE 0 END END AS gauc_at_{_K}
    FROM l_{name} g JOIN h_{name} USING (request_id) WHERE p > 0),
  a_{name} AS (SELECT {", ".join(means)} FROM m_{name})"""


def _long(name: str, prefix: str) -> str:
    names = ["mrr", "gauc", *[f"{m}_{k}" for m in ("recall", "ndcg") for k in _KS], f"mrr_at_{_K}", f"gauc_at_{_K}"]
    return " UNION ALL ".join(f"SELECT '{prefix}{m}' AS metric, round({m}::DOUBLE, 6) AS value FROM a_{name}" for m in names)


_PAIRS = f"""WITH {V.DOTS}, {V.VECPOS}, pool AS (SELECT vec_id AS item_id, label % 5 AS kind, vec_id % 7 AS shelf, coalesce(c, 0) AS popularity FROM embeddings
    LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = vec_id),
  st AS (SELECT avg(ln(1.0 + popularity)) AS m, stddev_pop(ln(1.0 + popularity)) AS s FROM pool),
  cands AS (SELECT d.request_id, d.item_id, d.score, CASE WHEN vp.item_id IS NULL THEN 0 ELSE 1 END AS label, popularity::DOUBLE AS popularity, (ln(1.0 + popularity) - m) / s AS prior
    FROM dots d JOIN pool USING (item_id) CROSS JOIN st LEFT JOIN vp ON d.request_id = vp.request_id AND d.item_id = vp.item_id)"""

_DIV = f"""SELECT request_id, avg(CASE WHEN n > 1 THEN 1 - matches / (2.0 * n * (n - 1)) ELSE 0 END) AS d FROM (
    SELECT request_id, max(n) AS n, sum(c * (c - 1)) AS matches FROM (
      SELECT request_id, f, v, count(*) AS c, {{k}} AS n FROM (
        SELECT request_id, unnest([1, 2]) AS f, unnest([kind, shelf]) AS v FROM r_list JOIN pool USING (item_id) WHERE rank <= {{k}}) GROUP BY ALL) GROUP BY 1) GROUP BY 1"""


@query("j9_all_items_report", _PAIRS
       + _view("base", "SELECT request_id, item_id, score, label FROM cands", "score DESC, label, item_id")
       + _view("pop", "SELECT request_id, item_id, popularity AS score, label FROM cands", "score DESC, item_id")
       + _view("blend", f"SELECT request_id, item_id, round(score + {_WEIGHT}::DOUBLE * prior, 9) AS score, label FROM cands", "score DESC, label, item_id")
       + f""", r_list AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rank FROM cands) WHERE rank <= {_K}),
  ok AS (SELECT request_id FROM cands GROUP BY 1 HAVING sum(label) > 0), hold AS (SELECT request_id FROM r_list GROUP BY 1 HAVING sum(label) > 0),
  s_all AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM cands GROUP BY 1),
  g_all AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM s_all),
  s_top AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM r_list JOIN hold USING (request_id) GROUP BY 1),
  g_top AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM s_top)
  SELECT 'requests' AS metric, count(DISTINCT request_id)::DOUBLE AS value FROM cands
  UNION ALL SELECT 'requests_with_positive', count(*)::DOUBLE FROM ok UNION ALL """ + _long("base", "")
       + " UNION ALL " + _long("pop", "popularity_") + " UNION ALL " + _long("blend", "popularity_blend_") + " UNION ALL "
       + " UNION ALL ".join(f"SELECT 'diversity_{k}', round(avg(d), 6) FROM ({_DIV.format(k=k)}) JOIN ok USING (request_id)" for k in _KS)
       + f""" UNION ALL SELECT 'auc', round(1 - sum(p * (above + 0.5 * n)) / (sum(p) * sum(n)), 6) FROM g_all
  UNION ALL SELECT 'auc_at_{_K}', round(1 - sum(p * (above + 0.5 * n)) / (sum(p) * sum(n)), 6) FROM g_top
  UNION ALL SELECT 'pool_diversity', round(1 - sum(c * (c - 1)) / (2.0 * (SELECT count(*) * (count(*) - 1) FROM pool)), 6) FROM (
    SELECT f, v, count(*) AS c FROM (SELECT unnest([1, 2]) AS f, unnest([kind, shelf]) AS v FROM pool) GROUP BY ALL)""")
def _(spark, sf):
    pool = V.vectors(spark, sf).select("item_id", "embedding", (F.col("kind") % 5).alias("kind"), (F.col("item_id") % 7).alias("shelf"))
    rel = L.LazyCandidates(V.vectors(spark, sf, "request_id").select("request_id", "embedding"), pool, V.vector_positives(spark, sf))
    rel = L.with_priors(rel, item_popularity(V.lines(spark, sf), "item_id", "label"))
    got = L.lazy_report(rel, scoring.VectorScorer(), list(_KS), _K, _WEIGHT, 0.0, ["kind", "shelf"], global_auc=True, pool_diversity=True)
    return rounded(got["metrics"])


@query("x5_batched_scorer", f"WITH {V.LINES}, {V.ITEMS} SELECT request_id, item_id, line_no, {_MODEL} AS score FROM lines JOIN items USING (item_id)")
def _(spark, sf):
    d = V.with_features(spark, sf, V.lines(spark, sf)).select("request_id", "item_id", "line_no", "size", "retail", F.col("quantity").cast("double").alias("quantity"))
    scored = scoring.BatchScorer(_load_model, ["size", "retail", "quantity"], max_rows=50_000)(d)
    return rounded(scored.select("request_id", "item_id", "line_no", "score"), 9)
