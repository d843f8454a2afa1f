"""Queries over ranking, classification and diversity metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumirank.functions.numeric import blend_logit, popularity_prior, popularity_stats, safe_logit, sigmoid
from lumirank.operators import classification as C, diversity as D, losses as L, ranking_metrics as R
from lumirank.operators.ordering import top_k, with_row_number
from lumirank.operators.rank import attach_popularity, flag_members, top_report
from lumirank.operators.retrieve import popularity_recall
from lumirank.operators.stats import best_run, item_popularity
from lumirank.plans import views as V
from lumirank.plans.registry import query, rounded

KS = [1, 2, 3, 5]
TOPK = 3


def _metrics_sql(base: str, score: str = "score", ks=KS, top=None, rank_src: str | None = None) -> str:
    """CTE `pr`: one row per request, by brute force over pairs for the AUC."""
    rank_src = rank_src or "ranked"
    cols = []
    for k in ks:
        cols.append(f"CASE WHEN sum(pos)=0 THEN 0 ELSE sum(CASE WHEN pos=1 AND rank<={k} THEN 1.0 ELSE 0 END)/sum(pos) END AS recall_{k}")
        cols.append(f"CASE WHEN sum(pos)=0 THEN 0 ELSE sum(CASE WHEN pos=1 AND rank<={k} THEN 1/log2(rank+1.0) ELSE 0 END)"
                    f"/(SELECT sum(1/log2(i+1.0)) FROM range(1,{k}+1) t(i) WHERE i<=max(r.npos)) END AS ndcg_{k}")
    out = f""", rr AS (SELECT *, CASE WHEN label>0 THEN 1 ELSE 0 END AS pos,
      sum(CASE WHEN label>0 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS npos FROM {rank_src}),
    auc AS (SELECT p.request_id, avg(CASE WHEN p.{score}>n.{score} THEN 1.0 WHEN p.{score}=n.{score} THEN 0.5 ELSE 0.0 END) AS a
      FROM rr p JOIN rr n ON p.request_id=n.request_id WHERE p.pos=1 AND n.pos=0 GROUP BY 1),
    base AS (SELECT request_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS n_pos,
      coalesce(1.0/min(CASE WHEN pos=1 THEN rank END),0) AS mrr, {", ".join(cols)} FROM rr r GROUP BY request_id),
    pr AS (SELECT base.*, coalesce(auc.a,0) AS gauc FROM base LEFT JOIN auc USING (request_id))"""
    return "WITH " + base + out


@query("w2_pessimistic_rank", f"WITH {V.RANKED} SELECT request_id, item_id, score, label, rank FROM ranked")
def _(spark, sf):
    c = V.candidates(spark, sf).select("request_id", "item_id", "score", "label")
    return with_row_number(c, ["request_id"], R.pessimistic_order(), "rank", upper=V.lines(spark, sf))


@query("w1_seeded_tie_rank", f"""WITH {V.CANDS} SELECT request_id, item_id,
  row_number() OVER (PARTITION BY request_id ORDER BY score DESC, (request_id*7919+item_id*104729)%1000003, item_id) AS rank FROM cands""")
def _(spark, sf):
    c = V.candidates(spark, sf).select("request_id", "item_id", "score")
    tie = (F.col("request_id") * 7919 + F.col("item_id") * 104729) % 1000003
    return with_row_number(c, ["request_id"], [F.col("score").desc(), tie.asc(), F.col("item_id").asc()], "rank").drop("score")


@query("w3_popularity_rank", f"""WITH {V.CANDS}, pop AS (SELECT item_id, count(*) AS popularity FROM lines WHERE label>0 GROUP BY 1),
  c AS (SELECT request_id, item_id, coalesce(popularity,0) AS popularity FROM cands LEFT JOIN pop USING (item_id))
  SELECT request_id, item_id, popularity, row_number() OVER (PARTITION BY request_id ORDER BY popularity DESC, item_id) AS rank FROM c""")
def _(spark, sf):
    pop = item_popularity(V.lines(spark, sf), "item_id", "label")
    c = attach_popularity(V.candidates(spark, sf).select("request_id", "item_id"), pop)
    return with_row_number(c, ["request_id"], [F.col("popularity").desc(), F.col("item_id").asc()], "rank")


@query("w5_group_midrank", f"""WITH {V.CANDS} SELECT request_id, item_id,
  rank() OVER (PARTITION BY request_id ORDER BY score) + (count(*) OVER (PARTITION BY request_id, score) - 1)/2.0::DOUBLE AS midrank FROM cands""")
def _(spark, sf):
    from lumirank.operators.ordering import with_prefix
    c = V.candidates(spark, sf).select("request_id", "item_id", "score")
    ties = c.groupBy("request_id", "score").agg(F.count("*").alias("ties"))
    below = with_prefix(ties, ["request_id"], ["score"], {"below": F.col("ties")})
    mid = below.select("request_id", "score", (F.col("below") + 1 + (F.col("ties") - 1) / 2.0).alias("midrank"))
    return c.join(mid, ["request_id", "score"]).select("request_id", "item_id", "midrank")


@query("w7_cumulative_confusion", f"""WITH {V.CANDS}, g AS (SELECT score, CAST(sum(CASE WHEN label>0 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
  CAST(sum(CASE WHEN label>0 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM cands GROUP BY score)
  SELECT round(score,6) AS score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM g""")
def _(spark, sf):
    from lumirank.operators.ordering import with_global_prefix
    pos = (F.col("label") > 0).cast("long")
    g = V.candidates(spark, sf).groupBy("score").agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    p, _ = with_global_prefix(g, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    return rounded(p.select("score", (F.col("tp") + F.col("pos")).alias("tp"), (F.col("fp") + F.col("neg")).alias("fp")))


@query("t1_request_top_k", f"WITH {V.RANKED} SELECT request_id, item_id, rank FROM ranked WHERE rank <= {TOPK}")
def _(spark, sf):
    c = V.candidates(spark, sf).select("request_id", "item_id", "score", "label")
    return top_k(c, ["request_id"], R.pessimistic_order(), TOPK).select("request_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("t5_top_report", f"""WITH {V.RANKED} SELECT request_id,
  max(CASE WHEN rank=1 THEN item_id END) AS top1_item, round(max(CASE WHEN rank=1 THEN score END),6) AS top1_score,
  CAST(max(CASE WHEN rank=1 THEN CASE WHEN label>0 THEN 1 ELSE 0 END END) AS INTEGER) AS hit_at_1,
  '[' || string_agg(CASE WHEN rank<=10 THEN item_id END, ',' ORDER BY rank) || ']' AS top_items,
  max_by(item_id, -rank) FILTER (WHERE label>0) AS positive_item, round(max_by(score, -rank) FILTER (WHERE label>0),6) AS positive_score
  FROM ranked GROUP BY request_id""")
def _(spark, sf):
    return rounded(top_report(V.candidates(spark, sf)))


@query("a25_ranking_metrics", _metrics_sql(V.RANKED) + " SELECT request_id, n, n_pos, round(mrr,6) AS mrr, round(gauc,6) AS gauc, " +
       ", ".join(f"round(recall_{k},6) AS recall_{k}, round(ndcg_{k},6) AS ndcg_{k}" for k in KS) + " FROM pr")
def _(spark, sf):
    return rounded(R.per_request(V.candidates(spark, sf), KS, upper=V.lines(spark, sf)))


def _avg_sql(denom: str) -> str:
    d = "count(*)" if denom == "all" else "count(*) FILTER (WHERE n_pos>0)"
    ms = ["mrr", "gauc", *[f"{m}_{k}" for m in ("recall", "ndcg") for k in KS]]
    return (" SELECT count(*) AS requests, count(*) FILTER (WHERE n_pos>0) AS requests_with_positive, " +
            ", ".join(f"round(sum(CASE WHEN n_pos>0 THEN {m} ELSE 0 END)/{d},6) AS {m}" for m in ms) + " FROM pr")


@query("a28_metric_means_all", _metrics_sql(V.RANKED) + _avg_sql("all"))
def _(spark, sf):
    return rounded(R.averages(R.per_request(V.candidates(spark, sf), KS, upper=V.lines(spark, sf)), KS, "all"))


@query("a28_metric_means_with_positive", _metrics_sql(V.RANKED) + _avg_sql("with_positive"))
def _(spark, sf):
    return rounded(R.averages(R.per_request(V.candidates(spark, sf), KS, upper=V.lines(spark, sf)), KS, "with_positive"))


@query("a25_top_k_metrics", f"""WITH {V.RANKED}, rr AS (SELECT *, CASE WHEN label>0 THEN 1 ELSE 0 END AS pos, count(*) OVER (PARTITION BY request_id) AS n FROM ranked),
  t AS (SELECT * FROM rr WHERE rank<={TOPK}),
  auc AS (SELECT p.request_id, avg(CASE WHEN p.score>n.score THEN 1.0 WHEN p.score=n.score THEN 0.5 ELSE 0.0 END) AS a
    FROM t p JOIN t n ON p.request_id=n.request_id WHERE p.pos=1 AND n.pos=0 GROUP BY 1),
  g AS (SELECT request_id, max(n) AS n, sum(pos) AS p, min(CASE WHEN pos=1 THEN rank END) AS first FROM t GROUP BY 1)
  SELECT request_id, CAST(p AS BIGINT) AS pos_in_top, round(CASE WHEN n>={TOPK} AND p>0 THEN 1.0/first END,6) AS mrr_at_{TOPK},
  round(CASE WHEN n>={TOPK} AND p>0 THEN coalesce(a,0) END,6) AS gauc_at_{TOPK} FROM g LEFT JOIN auc USING (request_id)""")
def _(spark, sf):
    m = R.per_request(V.candidates(spark, sf), [], top_k=TOPK, upper=V.lines(spark, sf))
    return rounded(m.select("request_id", "pos_in_top", f"mrr_at_{TOPK}", f"gauc_at_{TOPK}"))


@query("j8_restricted_ranking", _metrics_sql(V.CANDS + f""", tr AS (SELECT request_id, item_id FROM (SELECT *, row_number() OVER
    (PARTITION BY request_id ORDER BY teacher DESC, label, item_id) AS r FROM cands) WHERE r<={TOPK}),
  f AS (SELECT cands.*, tr.item_id IS NOT NULL AS kept FROM cands LEFT JOIN tr ON cands.request_id=tr.request_id AND cands.item_id=tr.item_id),
  ranked AS (SELECT *, CASE WHEN kept THEN row_number() OVER (PARTITION BY request_id, kept ORDER BY score DESC, label, item_id) ELSE NULL END AS rank,
    row_number() OVER (PARTITION BY request_id ORDER BY score DESC, label, item_id) AS full_rank FROM f)""", ks=[1, 2]).replace(
        "1.0/min(CASE WHEN pos=1 THEN rank END)", "1.0/min(CASE WHEN pos=1 THEN full_rank END)") +
       " SELECT request_id, n, n_pos, round(mrr,6) AS mrr, round(gauc,6) AS gauc, " +
       ", ".join(f"round(recall_{k},6) AS recall_{k}, round(ndcg_{k},6) AS ndcg_{k}" for k in [1, 2]) + " FROM pr")
def _(spark, sf):
    c = V.candidates(spark, sf)
    pre = top_k(c, ["request_id"], R.pessimistic_order("teacher"), TOPK)
    return rounded(R.per_request(flag_members(c, pre, "kept"), [1, 2], restrict="kept", upper=V.lines(spark, sf)))


@query("a32_popularity_baseline", _metrics_sql(V.CANDS + """, pop AS (SELECT item_id, count(*) AS c FROM lines WHERE label>0 GROUP BY 1),
  cp AS (SELECT request_id, item_id, label, coalesce(c,0)::DOUBLE AS score FROM cands LEFT JOIN pop USING (item_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, label, item_id) AS rank FROM cp)""") + _avg_sql("with_positive"))
def _(spark, sf):
    pop = item_popularity(V.lines(spark, sf), "item_id", "label")
    c = attach_popularity(V.candidates(spark, sf).select("request_id", "item_id", "label"), pop)
    m = R.per_request(c.withColumn("score", F.col("popularity").cast("double")), KS, upper=V.lines(spark, sf))
    return rounded(R.averages(m, KS, "with_positive"))


_BLEND = """pop AS (SELECT item_id, count(*) AS c FROM lines WHERE label>0 GROUP BY 1),
  st AS (SELECT avg(ln(1+c)) AS m, stddev_pop(ln(1+c)) AS s FROM pop),
  bl AS (SELECT request_id, item_id, label, round(ln(score/(1-score)) + 0.3*((ln(1+coalesce(c,0))-m)/s),9) AS score FROM cands LEFT JOIN pop USING (item_id), st)"""


def _blended(spark, sf):
    pop = item_popularity(V.lines(spark, sf), "item_id", "label")
    stats = popularity_stats(pop, "popularity")
    c = attach_popularity(V.candidates(spark, sf).select("request_id", "item_id", "label", "score"), pop)
    prior = popularity_prior(F.col("popularity"), stats)
    return c.withColumn("score", F.round(blend_logit(safe_logit(F.col("score")), prior, 0.3), 9)).drop("popularity")


@query("a32_popularity_blend", _metrics_sql(V.CANDS + ", " + _BLEND + """,
  ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, label, item_id) AS rank FROM bl)""") + _avg_sql("with_positive"))
def _(spark, sf):
    return rounded(R.averages(R.per_request(_blended(spark, sf), KS, upper=V.lines(spark, sf)), KS, "with_positive"))


@query("f16_popularity_blend_scores", f"WITH {V.CANDS}, {_BLEND} SELECT request_id, item_id, score AS blend_logit, round(1/(1+exp(-score)),6) AS blend_prob FROM bl")
def _(spark, sf):
    b = _blended(spark, sf)
    return rounded(b.select("request_id", "item_id", F.col("score").alias("blend_logit"), F.round(sigmoid(F.col("score")), 6).alias("blend_prob")), 9)


@query("a26_list_diversity", f"""WITH {V.RANKED}, {V.ITEMS}, t AS (SELECT request_id, rank, brand, ptype, size FROM ranked JOIN items USING (item_id)),
  ks AS (SELECT unnest([2,5]) AS k),
  pairs AS (SELECT a.request_id, k, sum((CASE WHEN a.brand=b.brand THEN 1 ELSE 0 END)+(CASE WHEN a.ptype=b.ptype THEN 1 ELSE 0 END)+(CASE WHEN a.size=b.size THEN 1 ELSE 0 END))/3.0 AS s,
    count(*) AS c FROM t a JOIN t b ON a.request_id=b.request_id AND a.rank<b.rank, ks WHERE b.rank<=k GROUP BY 1,2),
  n AS (SELECT request_id, count(*) AS n FROM ranked GROUP BY 1)
  SELECT n.request_id, round(coalesce(max(CASE WHEN k=2 THEN 1-s/c END),0),6) AS diversity_2, round(coalesce(max(CASE WHEN k=5 THEN 1-s/c END),0),6) AS diversity_5
  FROM n LEFT JOIN pairs USING (request_id) GROUP BY 1""")
def _(spark, sf):
    return rounded(D.list_diversity(V.with_features(spark, sf, V.candidates(spark, sf)), ["brand", "ptype", "size"], [2, 5]))


@query("a27_pool_diversity", f"""WITH {V.ITEMS}, m AS (SELECT sum(c*(c-1)) AS m FROM (SELECT count(*) AS c FROM items GROUP BY brand UNION ALL
  SELECT count(*) FROM items GROUP BY ptype UNION ALL SELECT count(*) FROM items GROUP BY size))
  SELECT count(*) AS n, round(1 - max(m)/(3.0*count(*)*(count(*)-1)),6) AS diversity FROM items, m""")
def _(spark, sf):
    return rounded(D.pool_diversity(V.items(spark, sf), ["brand", "ptype", "size"]))


@query("a27_request_pool_diversity", f"""WITH {V.CANDS}, {V.ITEMS}, t AS (SELECT request_id, item_id, brand, ptype FROM cands JOIN items USING (item_id)),
  p AS (SELECT a.request_id, avg(((CASE WHEN a.brand=b.brand THEN 1 ELSE 0 END)+(CASE WHEN a.ptype=b.ptype THEN 1 ELSE 0 END))/2.0) AS s
    FROM t a JOIN t b ON a.request_id=b.request_id AND a.item_id<b.item_id GROUP BY 1)
  SELECT request_id, count(*) AS n, round(coalesce(1-max(s),0),6) AS diversity FROM t LEFT JOIN p USING (request_id) GROUP BY 1""")
def _(spark, sf):
    return rounded(D.pool_diversity(V.with_features(spark, sf, V.candidates(spark, sf)), ["brand", "ptype"], ["request_id"]))


_POINT = f"""WITH {V.CANDS}, s AS (SELECT score, sum(CASE WHEN label>0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label>0 THEN 0 ELSE 1 END) AS n FROM cands GROUP BY 1),
  c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM s WINDOW w AS (ORDER BY score DESC)),
  auc AS (SELECT sum(p*((SELECT sum(n) FROM s)-cn+0.5*n))/(sum(p)*sum(n))::DOUBLE AS auc, sum(p*(cp/(cp+cn)::DOUBLE))/sum(p) AS ap FROM c)"""
_LL = "-(label*ln(score)+(1-label)*ln(1-score))"


@query("a17_auc_and_average_precision", _POINT + """ SELECT (SELECT count(*) FROM cands) AS n, (SELECT count(*) FROM cands WHERE label>0) AS n_pos,
  round(auc,6) AS auc, round(ap,6) AS average_precision FROM auc""")
def _(spark, sf):
    return rounded(C.auc(V.candidates(spark, sf)))


@query("a17_prediction_spread", f"""WITH {V.CANDS} SELECT count(*) AS n, round(avg(label),6) AS positive_ratio, round(min(score),6) AS pred_min, round(avg(score),6) AS pred_mean,
  round(max(score),6) AS pred_max, round(quantile_cont(score,0.01),6) AS p01, round(quantile_cont(score,0.5),6) AS p50, round(quantile_cont(score,0.99),6) AS p99,
  round(avg({_LL}),6) AS logloss FROM cands""")
def _(spark, sf):
    from lumirank.operators.ordering import exact_quantiles
    c = V.candidates(spark, sf)
    q = exact_quantiles(c, "score", [0.01, 0.5, 0.99])
    return rounded(c.agg(F.count("*").alias("n"), F.avg("label").alias("positive_ratio"), F.min("score").alias("pred_min"),
                         F.avg("score").alias("pred_mean"), F.max("score").alias("pred_max"), F.lit(q[0.01]).alias("p01"),
                         F.lit(q[0.5]).alias("p50"), F.lit(q[0.99]).alias("p99"),
                         F.avg(C.logloss_expr(F.col("label"), F.col("score"))).alias("logloss")))


@query("a18_calibration", f"WITH {V.CANDS} SELECT round(sum(score),6) AS sum_pred, round(sum(label),6) AS sum_label, round(sum(score)/sum(label),6) AS pcoc, round(sum(label)/sum(score),6) AS copc FROM cands")
def _(spark, sf):
    return rounded(C.calibration(V.candidates(spark, sf)))


def _gauc_sql(group: str, src: str) -> str:
    return f"""WITH {src}, a AS (SELECT p.{group} AS g, avg(CASE WHEN p.score>n.score THEN 1.0 WHEN p.score=n.score THEN 0.5 ELSE 0.0 END) AS a
      FROM d p JOIN d n ON p.{group}=n.{group} WHERE p.label>0 AND n.label<=0 GROUP BY 1), c AS (SELECT {group} AS g, count(*) AS n FROM d GROUP BY 1)
      SELECT round(sum(a*n)/sum(n),6) AS gauc, round(avg(a),6) AS avg_auc, count(*) AS gauc_valid_groups, CAST(sum(n) AS BIGINT) AS gauc_valid_samples FROM a JOIN c USING (g)"""


@query("a19_weighted_group_auc", _gauc_sql("user_id", f"{V.CANDS}, {V.SPLITS}, d AS (SELECT * FROM cands JOIN splits USING (request_id))"))
def _(spark, sf):
    return rounded(C.group_auc(V.candidates(spark, sf).join(V.splits(spark, sf), "request_id"), "user_id"))


@query("a20_mean_group_auc", _gauc_sql("request_id", f"{V.CANDS}, d AS (SELECT * FROM cands)"))
def _(spark, sf):
    return rounded(C.group_auc(V.candidates(spark, sf), "request_id"))


@query("a21_group_mrr", f"""WITH {V.RANKED}, g AS (SELECT request_id, sum(label/rank)/(sum(label)+1e-12) AS mrr FROM ranked GROUP BY 1)
  SELECT count(*) AS groups, round(avg(mrr),6) AS mrr FROM g""")
def _(spark, sf):
    return rounded(R.group_mrr_all(V.candidates(spark, sf), "request_id"))


_GRADE = "grade AS (SELECT request_id, item_id, score, (CASE flag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END)::DOUBLE AS label, line_no, quantity FROM lines)"


@query("a22_graded_ndcg", f"""WITH {V.LINES}, {_GRADE}, gg AS (SELECT request_id, item_id, max(score) AS score, max(label) AS label FROM grade GROUP BY 1,2),
  r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, label, item_id) AS rp,
    row_number() OVER (PARTITION BY request_id ORDER BY label DESC, item_id) AS ri FROM gg),
  g AS (SELECT request_id, sum(CASE WHEN rp<=3 THEN (2**label-1)/log2(rp+1.0) ELSE 0 END) AS d, sum(CASE WHEN ri<=3 THEN (2**label-1)/log2(ri+1.0) ELSE 0 END) AS i FROM r GROUP BY 1)
  SELECT count(*) AS groups, round(avg(d/(i+1e-12)),6) AS ndcg FROM g""")
def _(spark, sf):
    g = V.lines(spark, sf).withColumn("label", F.when(F.col("flag") == "R", 2.0).when(F.col("flag") == "A", 1.0).otherwise(0.0))
    g = g.groupBy("request_id", "item_id").agg(F.max("score").alias("score"), F.max("label").alias("label"))
    return rounded(R.group_ndcg(g, "request_id", 3))


@query("a23_metric_dispatch", _POINT.replace("auc AS (", "auc0 AS (") + f""", pa AS (SELECT p.request_id, avg(CASE WHEN p.score>n.score THEN 1.0 WHEN p.score=n.score THEN 0.5 ELSE 0.0 END) AS a
  FROM cands p JOIN cands n ON p.request_id=n.request_id WHERE p.label>0 AND n.label<=0 GROUP BY 1), pc AS (SELECT request_id, count(*) AS n FROM cands GROUP BY 1),
  rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, label, item_id) AS rp, row_number() OVER (PARTITION BY request_id ORDER BY label DESC, item_id) AS ri FROM cands),
  gr AS (SELECT request_id, sum(label/rp)/(sum(label)+1e-12) AS mrr, sum(CASE WHEN rp<=2 THEN (2**label-1)/log2(rp+1.0) ELSE 0 END)/(sum(CASE WHEN ri<=2 THEN (2**label-1)/log2(ri+1.0) ELSE 0 END)+1e-12) AS nd FROM rk GROUP BY 1)
  SELECT 'AUC' AS metric, round(auc,6) AS value FROM auc0 UNION ALL SELECT 'logloss', round(avg({_LL}),6) FROM cands
  UNION ALL SELECT 'gAUC', round(sum(a*n)/sum(n),6) FROM pa JOIN pc USING (request_id) UNION ALL SELECT 'avgAUC', round(avg(a),6) FROM pa
  UNION ALL SELECT 'MRR', round(avg(mrr),6) FROM gr UNION ALL SELECT 'NDCG@2', round(avg(nd),6) FROM gr""")
def _(spark, sf):
    return rounded(C.evaluate(V.candidates(spark, sf), ["AUC", "logloss", "gAUC", "avgAUC", "MRR", "NDCG@2"], "request_id"))


@query("x4_metric_names", f"""WITH {V.RANKED}, g AS (SELECT request_id, sum(CASE WHEN rank=1 THEN label ELSE 0 END)/(max(label)+1e-12) AS v FROM ranked GROUP BY 1)
  SELECT 'NDCG(1)' AS metric, round(avg(v),6) AS value FROM g""")
def _(spark, sf):
    return rounded(C.evaluate(V.candidates(spark, sf), ["NDCG(1)"], "request_id"))


_SLICE = f"""WITH {V.CANDS}, {V.ITEMS}, d AS (SELECT ptype, score, label FROM cands JOIN items USING (item_id)),
  s AS (SELECT ptype, score, sum(CASE WHEN label>0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label>0 THEN 0 ELSE 1 END) AS n FROM d GROUP BY 1,2),
  c AS (SELECT *, sum(n) OVER (PARTITION BY ptype ORDER BY score DESC) AS cn, sum(n) OVER (PARTITION BY ptype) AS tn, sum(p) OVER (PARTITION BY ptype) AS tp FROM s),
  a AS (SELECT ptype, sum(p*(tn-cn+0.5*n))/(max(tp)*max(tn))::DOUBLE AS auc FROM c GROUP BY 1)"""


@query("a24_slice_metrics", _SLICE + f""" SELECT ptype, count(*) AS count, round(count(*)*100.0/(SELECT count(*) FROM d),6) AS ratio, round(max(auc),6) AS auc,
  round(avg({_LL}),6) AS logloss FROM d JOIN a USING (ptype) GROUP BY 1""")
def _(spark, sf):
    return rounded(C.slice_metrics(V.with_features(spark, sf, V.candidates(spark, sf)), "ptype"))


@query("a29_global_auc_at_k", f"""WITH {V.RANKED}, t AS (SELECT * FROM ranked WHERE rank<={TOPK}), ok AS (SELECT request_id FROM t GROUP BY 1 HAVING max(label)>0),
  d AS (SELECT t.* FROM t JOIN ok USING (request_id)), s AS (SELECT score, sum(CASE WHEN label>0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label>0 THEN 0 ELSE 1 END) AS n FROM d GROUP BY 1),
  c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM s WINDOW w AS (ORDER BY score DESC))
  SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM d WHERE label>0) AS n_pos,
  round(sum(p*((SELECT sum(n) FROM s)-cn+0.5*n))/(sum(p)*sum(n)),6) AS auc, round(sum(p*(cp/(cp+cn)::DOUBLE))/sum(p),6) AS average_precision FROM c""")
def _(spark, sf):
    return rounded(C.global_auc_at_k(V.candidates(spark, sf), TOPK))


@query("a30_hit_rate", f"""WITH {V.RANKED}, h AS (SELECT request_id, min(CASE WHEN label>0 THEN rank END) AS best FROM ranked GROUP BY 1)
  SELECT count(*) AS requests, round(count(*) FILTER (WHERE best<=1)/count(*)::DOUBLE,6) AS hit_rate_1, round(count(*) FILTER (WHERE best<=3)/count(*)::DOUBLE,6) AS hit_rate_3 FROM h""")
def _(spark, sf):
    c = V.candidates(spark, sf)
    top = top_k(c, ["request_id"], R.pessimistic_order(), 3)
    return rounded(R.hit_rate(top, [1, 3], c.select("request_id").distinct()))


@query("a31_popularity_recall", f"""WITH {V.CANDS}, pop AS (SELECT item_id, count(*) AS c FROM lines WHERE label>0 GROUP BY 1),
  r AS (SELECT request_id, label, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(c,0) DESC, item_id) AS rank FROM cands LEFT JOIN pop USING (item_id)),
  h AS (SELECT request_id, min(CASE WHEN label>0 THEN rank END) AS best FROM r GROUP BY 1)
  SELECT count(*) AS requests, round(count(*) FILTER (WHERE best<=1)/count(*)::DOUBLE,6) AS popularity_recall_1, round(count(*) FILTER (WHERE best<=3)/count(*)::DOUBLE,6) AS popularity_recall_3 FROM h""")
def _(spark, sf):
    c = V.candidates(spark, sf)
    pop = item_popularity(V.lines(spark, sf), "item_id", "label")
    return rounded(popularity_recall(c, pop, [1, 3], c.select("request_id")))


def _task_sql(y, s):
    return f"""SELECT sum(p*(tn-cn+0.5*n))/(max(tp)*max(tn))::DOUBLE AS auc FROM (SELECT *, sum(n) OVER (ORDER BY s DESC) AS cn, sum(n) OVER () AS tn, sum(p) OVER () AS tp
      FROM (SELECT {s} AS s, sum(CASE WHEN {y}>0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN {y}>0 THEN 0 ELSE 1 END) AS n FROM t GROUP BY 1))"""


@query("a33_multitask_metrics", f"""WITH {V.LINES}, t AS (SELECT label AS y1, score AS s1, CASE WHEN status='F' THEN 1.0 ELSE 0.0 END AS y2, teacher AS s2 FROM lines),
  m AS (SELECT 'returned' AS task, ({_task_sql('y1', 's1')}) AS auc, (SELECT avg(-(y1*ln(s1)+(1-y1)*ln(1-s1))) FROM t) AS logloss
  UNION ALL SELECT 'filled', ({_task_sql('y2', 's2')}), (SELECT avg(-(y2*ln(s2)+(1-y2)*ln(1-s2))) FROM t))
  SELECT task, round(auc,6) AS auc, round(logloss,6) AS logloss FROM m UNION ALL SELECT 'all', round(avg(auc),6), round(avg(logloss),6) FROM m""")
def _(spark, sf):
    t = V.lines(spark, sf).withColumn("filled", (F.col("status") == "F").cast("double"))
    return rounded(C.multitask(t, {"returned": ("label", "score"), "filled": ("filled", "teacher")}))


@query("a34_best_run", f"""WITH {V.CANDS}, {V.ITEMS}, m AS (SELECT ptype AS run, avg(label) AS a, avg(score) AS b FROM cands JOIN items USING (item_id) GROUP BY 1),
  w AS (SELECT run, a, b, 0.7*a+0.3*b AS monitor FROM m)
  SELECT run, round(a,6) AS label_mean, round(b,6) AS score_mean, round(monitor,6) AS monitor, CASE WHEN row_number() OVER (ORDER BY monitor DESC, run)=1 THEN 1 ELSE 0 END::INTEGER AS is_best FROM w""")
def _(spark, sf):
    d = V.with_features(spark, sf, V.candidates(spark, sf)).groupBy(F.col("ptype").alias("run")).agg(
        F.avg("label").alias("label_mean"), F.avg("score").alias("score_mean"))
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("label_mean", "score_mean")])
    long = d.select("run", F.explode(cells).alias("m")).select("run", "m.metric", "m.value")
    return rounded(best_run(long, "run", "metric", {"label_mean": 0.7, "score_mean": 0.3}))


@query("a35_pairwise_losses", f"""WITH {V.LINES}, a AS (SELECT row_number() OVER () AS anchor, score AS pos_score, teacher AS n1, discount*8 AS n2, tax*9 AS n3 FROM lines WHERE label>0),
  p AS (SELECT anchor, pos_score, unnest([n1,n2,n3]) AS neg_score FROM a),
  g AS (SELECT anchor, ln(1+sum(exp(neg_score-pos_score))) AS ce FROM p GROUP BY 1)
  SELECT count(*) AS pairs, (SELECT count(*) FROM g) AS anchors, round(avg(ln(1+exp(neg_score-pos_score))),6) AS bpr,
  round(avg(greatest(0,1-pos_score+neg_score)),6) AS hinge, (SELECT round(avg(ce),6) FROM g) AS softmax_ce FROM p""")
def _(spark, sf):
    a = V.lines(spark, sf).filter("label > 0").withColumn("anchor", F.struct("request_id", "item_id", "line_no", "supp_id", "quantity", "shipdate"))
    p = a.select("anchor", F.col("score").alias("pos_score"), F.explode(F.array("teacher", F.col("discount") * 8, F.col("tax") * 9)).alias("neg_score"))
    return rounded(L.pairwise_losses(p, "anchor"))


@query("a36_agreement_losses", f"""WITH {V.CANDS}, z AS (SELECT ln(score/(1-score)) AS s, ln(teacher/(1-teacher)) AS t FROM cands), q AS (SELECT s, t, 1/(1+exp(-t/2)) AS q FROM z)
  SELECT round(avg((s-t)*(s-t)),6) AS mse, round(avg(greatest(0,(ln(1+exp(s/2))-q*s/2)-(ln(1+exp(t/2))-q*t/2))*4),6) AS kl,
  round(1-sum(s*t)/(sqrt(sum(s*s))*sqrt(sum(t*t))),6) AS cosine_distance FROM q""")
def _(spark, sf):
    c = V.candidates(spark, sf).select(safe_logit(F.col("score")).alias("s"), safe_logit(F.col("teacher")).alias("t"))
    return rounded(L.agreement_losses(c, "s", "t", 2.0))


@query("a37_short_list_quality", """WITH v AS (SELECT label AS kind, vec_id, embedding[1]::DOUBLE AS s, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY embedding[1]::DOUBLE DESC, vec_id) AS r FROM embeddings),
  t AS (SELECT kind, r, 1/(1+exp(-s)) AS w, e FROM v WHERE r<=3), p AS (SELECT a.kind, a.r AS i, b.r AS j, a.w*b.w*list_cosine_similarity(a.e,b.e)+CASE WHEN a.r=b.r THEN 1e-6 ELSE 0 END AS k FROM t a JOIN t b ON a.kind=b.kind),
  m AS (SELECT kind, sum(CASE WHEN i=1 AND j=1 THEN k END) AS a, sum(CASE WHEN i=2 AND j=2 THEN k END) AS b, sum(CASE WHEN i=3 AND j=3 THEN k END) AS c, sum(CASE WHEN i=1 AND j=2 THEN k END) AS d, sum(CASE WHEN i=1 AND j=3 THEN k END) AS e, sum(CASE WHEN i=2 AND j=3 THEN k END) AS f FROM p GROUP BY 1),
  q AS (SELECT kind, ln(a*(b*c-f*f)-d*(d*c-f*e)+e*(d*f-b*e))/3 AS logdet FROM m), n AS (SELECT kind, count(*) AS n, avg(w) AS mean_score FROM t GROUP BY 1)
  SELECT kind, n, round(mean_score,4) AS mean_score, round(logdet,4) AS logdet, round(0.7*mean_score+0.3*logdet,4) AS quality FROM q JOIN n USING (kind) WHERE n=3""")
def _(spark, sf):
    v = V.vectors(spark, sf).withColumn("score", F.element_at("embedding", 1).cast("double"))
    return rounded(D.list_quality(v, "kind", 3).filter("n = 3"), 4)


# the determinant by elimination: after step k the rows and columns past k are left, and (k, k) was the pivot
@query("a37_list_quality", """WITH RECURSIVE v AS (SELECT label AS kind, vec_id, embedding[1]::DOUBLE AS s, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY embedding[1]::DOUBLE DESC, vec_id) AS r FROM embeddings),
  t AS (SELECT kind, r, 1/(1+exp(-s)) AS w, e FROM v WHERE r<=8),
  p AS (SELECT a.kind, a.r AS i, b.r AS j, a.w*b.w*list_cosine_similarity(a.e,b.e)+CASE WHEN a.r=b.r THEN 1e-6 ELSE 0 END AS a FROM t a JOIN t b ON a.kind=b.kind),
  el AS (SELECT kind, 1 AS k, i, j, a FROM p UNION ALL
    SELECT x.kind, x.k+1, x.i, x.j, x.a-r.a*c.a/q.a FROM el x JOIN el r ON r.kind=x.kind AND r.k=x.k AND r.i=x.i AND r.j=x.k JOIN el c ON c.kind=x.kind AND c.k=x.k AND c.i=x.k AND c.j=x.j
      JOIN el q ON q.kind=x.kind AND q.k=x.k AND q.i=x.k AND q.j=x.k WHERE x.i>x.k AND x.j>x.k),
  g AS (SELECT kind, sum(ln(a)) AS logdet FROM el WHERE i=k AND j=k GROUP BY 1), n AS (SELECT kind, count(*) AS n, avg(w) AS mean_score FROM t GROUP BY 1)
  SELECT kind, n, round(mean_score,4) AS mean_score, round(logdet/n,4) AS logdet, round(0.7*mean_score+0.3*logdet/n,4) AS quality FROM g JOIN n USING (kind)""")
def _(spark, sf):
    v = V.vectors(spark, sf).withColumn("score", F.element_at("embedding", 1).cast("double"))
    return rounded(D.list_quality(v, "kind", 8), 4)


@query("a39_class_weighted_logloss", f"WITH {V.CANDS} SELECT round(avg(-(3.0*label*ln(score)+0.5*(1-label)*ln(1-score))),6) AS weighted_logloss FROM cands")
def _(spark, sf):
    return rounded(V.candidates(spark, sf).agg(F.avg(C.logloss_expr(F.col("label"), F.col("score"), 0.5, 3.0)).alias("weighted_logloss")))


@query("c14_pointwise_report", _POINT + f""", ga AS (SELECT p.request_id, avg(CASE WHEN p.score>n.score THEN 1.0 WHEN p.score=n.score THEN 0.5 ELSE 0.0 END) AS a
  FROM cands p JOIN cands n ON p.request_id=n.request_id WHERE p.label>0 AND n.label<=0 GROUP BY 1), gc AS (SELECT request_id, count(*) AS n FROM cands GROUP BY 1),
  gg AS (SELECT sum(a*n)/sum(n) AS gauc, count(*) AS g, CAST(sum(n) AS BIGINT) AS s FROM ga JOIN gc USING (request_id))
  SELECT count(*) AS sample_count, round(avg(label),6) AS positive_ratio, round(min(score),6) AS pred_min, round(avg(score),6) AS pred_mean, round(max(score),6) AS pred_max,
  round(avg({_LL}),6) AS logloss, round(sum(score)/sum(label),6) AS pcoc, round(sum(label)/sum(score),6) AS copc, round((SELECT auc FROM auc),6) AS auc, round((SELECT ap FROM auc),6) AS prauc,
  round(quantile_cont(score,0.01),6) AS pred_p01, round(quantile_cont(score,0.5),6) AS pred_p50, round(quantile_cont(score,0.99),6) AS pred_p99,
  round((SELECT gauc FROM gg),6) AS gauc, (SELECT g FROM gg) AS gauc_valid_groups, (SELECT s FROM gg) AS gauc_valid_samples FROM cands""")
def _(spark, sf):
    return rounded(C.pointwise_report(V.candidates(spark, sf), group="request_id"))
