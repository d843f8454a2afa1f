"""Queries over sources, sinks and composite jobs: each writes what it derives from the tables and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumirank.functions import text as TX
from lumirank.operators import classification as C, ranking_metrics as R, remap as RM, vocab as VO
from lumirank.operators.ordering import top_k
from lumirank.operators.stats import item_popularity
from lumirank.plans import jobs as J, views as V
from lumirank.plans.prep_queries import _DOCTOK, _LD, _PROF, _SIDE, _VOC, _doc_vocab
from lumirank.plans.ranking_queries import _BLEND, KS, TOPK, _avg_sql, _metrics_sql
from lumirank.plans.registry import SQL, query, rounded
from lumirank.plans.stage_queries import _AI, _ASM, _MAP, _used
from lumirank.schema import FeatureSpec
from lumirank.session import shared_dir
from lumirank.sources import clicklog as CL, increments as INC, relations as RL, tabular as TB, tfrecord as TF


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_csv_scan", "SELECT l_orderkey AS request_id, l_partkey AS item_id, l_quantity AS quantity, l_returnflag AS flag FROM lineitem")
def _(spark, sf):
    path = _place(spark, "csv")
    V.lines(spark, sf).select("item_id", "flag", "request_id", "quantity", "tax").write.csv(path, header=True, sep=";")
    schema = TB.csv_schema([FeatureSpec("quantity", "numeric", "float"), FeatureSpec("flag")], {"request_id": "int64", "item_id": "int64"})
    return TB.read_csv(spark, path, schema, sep=";")


@query("s5_counted_part_files", f"WITH {V.IMPS} SELECT split, count(*) AS rows FROM imps GROUP BY 1")
def _(spark, sf):
    path = _place(spark, "parts")
    V.impressions(spark, sf).select("split", "item_id").write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("rows"))


@query("s6_split_by_convention", f"WITH {V.IMPS} SELECT request_id, item_id, line_no, label FROM imps WHERE split='valid'")
def _(spark, sf):
    root = _place(spark, "root")
    V.impressions(spark, sf).filter("split = 'valid'").select("request_id", "item_id", "line_no", "label", "tax").write.parquet(f"{root}/valid.parquet")
    return TB.read_split(spark, root, "valid", "parquet", ["request_id", "item_id", "line_no", "label"])


_TFSCHEMA = "request_id long, label float, status string, item_seq array<long>"


def _write_tf(spark, sf) -> str:
    path = _place(spark, "tfrecord")
    d = V.coded(spark, sf).join(V.lines(spark, sf).select("request_id", (F.col("item_id") * 3 + 2).alias("item_code"), (F.col("supp_id") * 2 + 1).alias("supp_code"), "line_no", "label", "status", "quantity"),
                                ["request_id", "item_code", "supp_code", "line_no"])
    TF.write_tfrecord(d.select("request_id", F.col("label").cast("float").alias("label"), "status", "item_seq"), path, {"item_seq": 4})
    return path


_TFSRC = "SELECT a.l_orderkey AS request_id, CASE WHEN b.l_returnflag='R' THEN 1.0 ELSE 0.0 END::DOUBLE AS label, b.l_linestatus AS status, array_to_string([a.l_partkey*3+2, a.l_suppkey*3+2, 0, 0],'^') AS seq FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_partkey=b.l_partkey AND a.l_suppkey=b.l_suppkey AND a.l_linenumber=b.l_linenumber"


def _tf_view(d):
    return d.select("request_id", F.col("label").cast("double").alias("label"), "status", TX.join_tokens(F.col("item_seq")).alias("seq"))


@query("s7_tfrecord_scan", _TFSRC)
def _(spark, sf):
    return _tf_view(TF.read_tfrecord(spark, _write_tf(spark, sf), _TFSCHEMA, defaults={"request_id": -1}))


@query("s8_tfrecord_sink", "SELECT label, status, count(*) AS rows, CAST(sum(request_id) AS BIGINT) AS total FROM (" + _TFSRC + ") GROUP BY 1,2")
def _(spark, sf):
    d = _tf_view(TF.read_tfrecord(spark, _write_tf(spark, sf), _TFSCHEMA, verify=True))
    return d.groupBy("label", "status").agg(F.count("*").alias("rows"), F.sum("request_id").alias("total"))


@query("s9_positive_tfrecords", "SELECT * FROM (" + _TFSRC + ") WHERE label>0")
def _(spark, sf):
    src, dst = _write_tf(spark, sf), _place(spark, "positive")
    TF.positive_records(spark, src, dst, _TFSCHEMA)
    return _tf_view(TF.read_tfrecord(spark, dst, _TFSCHEMA))


@query("s10_checked_split_sink", f"WITH {V.IMPS} SELECT request_id, item_id, line_no, label FROM imps WHERE split='train'")
def _(spark, sf):
    path = _place(spark, "split")
    TB.write_split(V.impressions(spark, sf).filter("split = 'train'").select("request_id", "item_id", "line_no", "label"), path)
    return TB.read_model_inputs(spark, path, ["line_no"], ["label"], "request_id", "item_id").select("request_id", "item_id", "line_no", "label")


_STAGE = f"WITH {V.RANKED} SELECT request_id, item_id, round(score::FLOAT::DOUBLE,4) AS score, label::TINYINT AS label FROM ranked WHERE rank<={TOPK}"


def _stage(spark, sf):
    c = V.candidates(spark, sf)
    top = top_k(c, ["request_id"], R.pessimistic_order(), TOPK)
    return RL.StageRelation("preranking", top, V.splits(spark, sf).select("request_id", "user_id"), {"k": TOPK}, {"split": "valid"})


@query("s11_stage_relation", _STAGE)
def _(spark, sf):
    path = _place(spark, "stage")
    _stage(spark, sf).save(path)
    got = RL.StageRelation.load(spark, path)
    return got.candidates.withColumn("score", F.round(F.col("score").cast("double"), 4))


@query("s12_named_stage_relations", _STAGE)
def _(spark, sf):
    root = _place(spark, "stages")
    _stage(spark, sf).save(RL.stage_path(root, "preranking", "valid"))
    got = RL.load_stages(spark, root, "preranking", test=False)["valid"]
    return got.candidates.withColumn("score", F.round(F.col("score").cast("double"), 4))


@query("s13_cached_item_pool", f"WITH {V.IMPS}, r AS (SELECT item_id, supp_id, row_number() OVER (PARTITION BY item_id ORDER BY request_id, line_no, supp_id) AS n FROM imps WHERE split='train') SELECT item_id, supp_id FROM r WHERE n=1")
def _(spark, sf):
    root = _place(spark, "pools")
    i = V.impressions(spark, sf).select("item_id", "supp_id", "request_id", "line_no", "split")
    paths = {}
    for s in ("train",):
        paths[s] = f"{root}/{s}.parquet"
        i.filter(F.col("split") == s).drop("split").write.parquet(paths[s])
    J.item_pools(spark, paths, root, "item_id", ["supp_id"], ["request_id", "line_no"], ["train"])
    return J.item_pools(spark, paths, root, "item_id", ["supp_id"], ["request_id", "line_no"], ["train"])["train"]    # second call reads the table


@query("c4_item_pools", f"""WITH {V.IMPS}, r AS (SELECT item_id, supp_id, row_number() OVER (PARTITION BY item_id ORDER BY CASE split WHEN 'valid' THEN 0 ELSE 1 END, request_id, line_no, supp_id) AS n FROM imps WHERE split<>'train') SELECT item_id, supp_id FROM r WHERE n=1""")
def _(spark, sf):
    root = _place(spark, "pools")
    i = V.impressions(spark, sf).select("item_id", "supp_id", "request_id", "line_no", "split")
    paths = {s: f"{root}/{s}.parquet" for s in ("valid", "test")}
    for s, p in paths.items():
        i.filter(F.col("split") == s).drop("split").write.parquet(p)
    return J.item_pools(spark, paths, root, "item_id", ["supp_id"], ["request_id", "line_no"], ["evaluation"])["evaluation"]


@query("s14_sample_sink", "SELECT least(count(*), 100) AS rows FROM lineitem")
def _(spark, sf):
    path = _place(spark, "sample")
    TB.write_sample(V.table(spark, sf, "lineitem"), path, 100)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"))


@query("s16_pretrained_vectors", "SELECT vec_id::VARCHAR AS key, generate_subscripts(embedding,1)::INTEGER AS d, unnest([round(x::DOUBLE,6)+0.0 for x in embedding]) AS x FROM embeddings")
def _(spark, sf):
    path = _place(spark, "vectors")
    V.vectors(spark, sf, "key").select(F.col("key").cast("string").alias("key"), F.col("embedding").alias("value")).write.parquet(path)
    d = TB.read_parquet(spark, path, ["key", "value"])
    return rounded(d.select("key", F.posexplode(F.col("value").cast("array<double>")).alias("d", "x")).withColumn("d", F.col("d") + 1))


@query("s17_vocabulary_sink", f"WITH {_DOCTOK}, {_VOC} SELECT 'text' AS feature, token, idx FROM voc UNION ALL SELECT 'text', '__PAD__', 0 UNION ALL SELECT 'text', '__OOV__', (SELECT coalesce(max(idx),0)+1 FROM voc)")
def _(spark, sf):
    path = _place(spark, "vocab")
    RL.write_vocab(_doc_vocab(spark, sf).withColumn("feature", F.lit("text")), path)
    return spark.read.parquet(path)


@query("s17_vocabulary_json", f"WITH {_DOCTOK}, {_VOC} SELECT 'text' AS feature, token, idx FROM voc UNION ALL SELECT 'text', '__PAD__', 0 UNION ALL SELECT 'text', '__OOV__', (SELECT coalesce(max(idx),0)+1 FROM voc)")
def _(spark, sf):
    path = _place(spark, "vocab-json")
    v = _doc_vocab(spark, sf).withColumn("feature", F.lit("text"))
    RL.write_vocab_json(v.unionByName(v.withColumn("feature", F.lit("shared"))), path, ["shared"])
    return spark.read.schema("feature string, token string, idx long").json(path)


@query("s18_remap_sink", f"WITH {_MAP} SELECT feature, old_id, new_id FROM m")
def _(spark, sf):
    path = _place(spark, "remap")
    RL.write_remap(RM.remap_table(_used(spark, sf)), path)
    return RL.read_remap(spark, path)


_LONG = "".join(f" UNION ALL SELECT 'ranking', 'valid', '{m}', {m} FROM w" for m in ["mrr", "gauc", *[f"{a}_{k}" for a in ("recall", "ndcg") for k in KS]])


@query("s21_metric_sink", _metrics_sql(V.RANKED) + ", w AS (" + _avg_sql("all") + ") SELECT 'ranking' AS stage, 'valid' AS split, 'requests' AS metric, requests::DOUBLE AS value FROM w UNION ALL SELECT 'ranking', 'valid', 'requests_with_positive', requests_with_positive FROM w" + _LONG)
def _(spark, sf):
    root = _place(spark, "metrics")
    wide = rounded(R.averages(R.per_request(V.candidates(spark, sf), KS), KS, "all"))
    RL.write_metrics(spark, RL.metrics_long(wide, "ranking", "valid"), root)
    return TB.read_csv(spark, f"{root}/eval_metrics", "stage string, split string, metric string, value double")


@query("s22_score_sink", f"WITH {V.CANDS} SELECT request_id, label, round(score,6) AS label_predict, round(teacher,6) AS label_predict_popularity_blend FROM cands")
def _(spark, sf):
    path = _place(spark, "scores")
    RL.write_scores(V.candidates(spark, sf), path, "request_id", "label", "score", "teacher")
    return rounded(TB.read_csv(spark, path, "request_id long, label double, label_predict double, label_predict_popularity_blend double"))


@query("s23_prediction_archive", f"WITH {V.CANDS} SELECT request_id, item_id, label, round(score,6) AS score FROM cands")
def _(spark, sf):
    c = V.candidates(spark, sf).select("request_id", "item_id", "label", "score")
    path = RL.write_predictions(spark, c, _place(spark, "pred"), {"AUC": float(C.auc(c).first()["auc"])})
    return rounded(spark.read.parquet(path))


@query("s24_result_rows", f"""WITH {V.CANDS}, {V.ITEMS}, d AS (SELECT ptype, score, label FROM cands JOIN items USING (item_id)), g AS (SELECT ptype AS grp, count(*) AS n FROM d GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM d),
  dd AS (SELECT * FROM d UNION ALL SELECT 'all', score, label FROM d), q AS (SELECT ptype AS grp, avg(-(label*ln(score)+(1-label)*ln(1-score))) AS ll FROM dd GROUP BY 1),
  sc AS (SELECT ptype AS grp, score, sum(CASE WHEN label>0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label>0 THEN 0 ELSE 1 END) AS m FROM dd GROUP BY 1,2), cu AS (SELECT *, sum(m) OVER (PARTITION BY grp ORDER BY score DESC) AS cm, sum(m) OVER (PARTITION BY grp) AS tm FROM sc),
  z AS (SELECT grp, CASE WHEN sum(p)*sum(m)>0 THEN sum(p*(tm-cm+0.5*m))/(sum(p)*sum(m))::DOUBLE ELSE 0 END AS a FROM cu GROUP BY 1)
  SELECT 'run-1' AS experiment, grp AS "group", printf('%.2f%%', n*100.0/(SELECT count(*) FROM d)) AS ratio, printf('%.4f', coalesce(a,0)) AS auc, printf('%.4f', ll) AS logloss FROM g JOIN q USING (grp) LEFT JOIN z USING (grp)""")
def _(spark, sf):
    path = _place(spark, "results")
    d = V.with_features(spark, sf, V.candidates(spark, sf)).withColumn("all", F.lit("all"))
    per = C.slice_metrics(d, "ptype").withColumnRenamed("ptype", "group")
    tot = C.slice_metrics(d, "all").withColumnRenamed("all", "group")
    RL.append_results(per, tot, "run-1", path)
    return TB.read_csv(spark, path, "experiment string, group string, ratio string, auc string, logloss string")


@query("s25_statistics_cache", f"WITH {V.IMPS} SELECT split, {_PROF} FROM imps GROUP BY 1")
def _(spark, sf):
    root = _place(spark, "stats")
    def build():
        p = J.statistics(V.impressions(spark, sf), "label", {"item": "item_id", "user": "user_id"})["profile"]
        return {"profile": [r.asDict() for r in rounded(p).collect()]}            # one row per split
    RL.statistics_cache(spark, f"{root}/stats.json", "v1", "prefer", build, ["profile"])
    got = RL.statistics_cache(spark, f"{root}/stats.json", "v1", "strict", build, ["profile"])
    rows = [tuple(r[c] for c in ("split", "rows", "positive_rows", "positive_rate", "missing_item_id", "missing_user_id")) for r in got["profile"]]
    return spark.createDataFrame(rows, "split string, rows long, positive_rows long, positive_rate double, missing_item_id long, missing_user_id long").filter("split <> 'all'")


# ---------------------------------------------------------------- nested-delimiter logs

_A, _B, _C = CL.BETWEEN, CL.AFTER_FIELD, CL.AFTER_ID


def _logs(spark, sf):
    """Log text made of lines (samples) and orders (bundles)."""
    root = _place(spark, "log")
    def feat(field, ident, value="1.0"):
        return F.concat(F.lit(field + _B), F.col(ident).cast("string") if isinstance(ident, str) else ident, F.lit(_C), F.lit(value) if isinstance(value, str) else value)
    l = V.table(spark, sf, "lineitem")
    own = F.concat_ws(_A, feat("101", "l_partkey"), feat("102", "l_suppkey"), feat("102", "l_linenumber"), feat("109", F.lit("x")), feat("508", F.lit("7"), F.col("l_quantity").cast("string")))
    l.select(F.concat_ws(",", "l_orderkey", (F.col("l_returnflag") == "R").cast("int").cast("string"), (F.col("l_linestatus") == "F").cast("int").cast("string"),
                         F.col("l_orderkey").cast("string"), F.lit("5"), own)).write.text(f"{root}/skeleton")
    o = V.table(spark, sf, "orders")
    shared = F.concat_ws(_A, feat("121", "o_custkey"), F.when(F.col("o_orderstatus") == "F", feat("109", F.lit("bundle"))))
    o.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.lit("2"), shared)).write.text(f"{root}/bundles")
    return CL.read_skeleton(spark, f"{root}/skeleton"), CL.read_bundles(spark, f"{root}/bundles")


_CLICKS = """SELECT l_orderkey::VARCHAR AS sample, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END::INTEGER AS click, CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END::INTEGER AS purchase,
  l_partkey::VARCHAR AS "101", l_suppkey::VARCHAR||'^'||l_linenumber::VARCHAR AS "102", CASE WHEN o_orderstatus='F' THEN 'bundle' ELSE 'x' END AS "109", o_custkey::VARCHAR AS "121", '0' AS "999", printf('%.1f',l_quantity) AS "D508"
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE NOT (l_returnflag<>'R' AND l_linestatus='F')"""


@query("s15_nested_log_scan", """SELECT l_orderkey::VARCHAR AS sample, 5::INTEGER AS features, l_partkey::VARCHAR AS first_id, printf('%.1f',l_quantity) AS last_value FROM lineitem""")
def _(spark, sf):
    sk, _b = _logs(spark, sf)
    return sk.select("sample", F.size("own").alias("features"), F.element_at("own", 1)["id"].alias("first_id"), F.element_at("own", -1)["value"].alias("last_value"))


@query("j14_joined_feature_bundles", _CLICKS)
def _(spark, sf):
    return CL.convert(*_logs(spark, sf), ["101", "102", "109", "121", "999"], ["508"])


@query("f13_capped_multi_values", f"WITH {V.HISTORY} SELECT user_id, array_to_string(seq[1:31],'^') AS vals FROM hist")
def _(spark, sf):
    return V.histories(spark, sf).select("user_id", F.array_join(TX.append_capped(F.col("seq")), "^").alias("vals"))


@query("c12_log_conversion", f"""WITH c AS ({_CLICKS}), s AS (SELECT *, CASE WHEN sample::BIGINT % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM c),
  cells AS (SELECT split, '101' AS voc, "101" AS token FROM s UNION ALL SELECT split, '102', unnest(string_split("102", '^')) FROM s UNION ALL SELECT split, '121', "109" FROM s UNION ALL SELECT split, '121', "121" FROM s),
  known AS (SELECT voc, token, min(CASE WHEN split='train' THEN 0 ELSE 1 END) AS late FROM cells WHERE token <> '0' GROUP BY 1, 2),
  v AS (SELECT voc, token, row_number() OVER (PARTITION BY voc ORDER BY late, token) AS idx FROM known),
  e AS (SELECT split, sample, click, purchase, coalesce(a.idx, 0)::VARCHAR AS f101, (SELECT string_agg(coalesce(b.idx, 0)::VARCHAR, '^' ORDER BY i) FROM (SELECT unnest(string_split(s."102", '^')) AS tk, generate_subscripts(string_split(s."102", '^'), 1) AS i) LEFT JOIN v b ON b.voc='102' AND b.token=tk) AS f102,
    coalesce(x.idx, 0)::VARCHAR AS f109, coalesce(y.idx, 0)::VARCHAR AS f121, "D508"::DOUBLE AS d508 FROM s LEFT JOIN v a ON a.voc='101' AND a.token="101" LEFT JOIN v x ON x.voc='121' AND x.token="109" LEFT JOIN v y ON y.voc='121' AND y.token="121"),
  h AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY (sample::BIGINT * 7919 + f101::BIGINT * 31) % 10007, sample, f101, f102, f109, f121, click, purchase, d508) AS n, count(*) OVER (PARTITION BY split) AS total FROM e)
  SELECT CASE WHEN split='train' THEN 'train' WHEN n <= total // 2 THEN 'test' ELSE 'valid' END AS split, sample, click::INTEGER AS click, purchase::INTEGER AS purchase, f101, f102, f109, f121, round(d508, 3) AS d508 FROM h""")
def _(spark, sf):
    skeleton, bundles = _logs(spark, sf)
    late = F.col("sample").cast("long") % 5 == 0
    logs = {"train": (skeleton.filter(~late), bundles), "test": (skeleton.filter(late), bundles)}
    mix = (F.col("sample").cast("long") * 7919 + F.col("101").cast("long") * 31) % 10007
    got = J.convert_logs(logs, ["101", "102", "109", "121"], ["508"], {"109": "121"}, hash_expr=mix)
    assert dict(got["tables"]["train"].dtypes)["click"] == "tinyint" and dict(got["tables"]["test"].dtypes)["D508"] == "float"
    parts = [d.select(F.lit(n).alias("split"), "sample", F.col("click").cast("int").alias("click"), F.col("purchase").cast("int").alias("purchase"), F.col("101").alias("f101"), F.col("102").alias("f102"),
                      F.col("109").alias("f109"), F.col("121").alias("f121"), F.col("D508").cast("double").alias("d508")) for n, d in got["tables"].items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 3)


# ---------------------------------------------------------------- composite jobs

_ORD = f"""{V.HISTORY}, o AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus='F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, o_orderpriority AS priority, c_mktsegment AS segment, o_totalprice AS amount, coalesce(array_to_string(seq,'^'),'') AS hist,
  CASE WHEN year(o_orderdate)<2000 THEN 'train' WHEN year(o_orderdate)<2001 THEN 'valid' ELSE 'test' END AS split FROM orders JOIN customer ON o_custkey=c_custkey LEFT JOIN hist ON o_custkey=user_id)"""
_FIT = """pv AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) AS idx FROM (SELECT priority AS token, count(*) AS c FROM o WHERE split='train' GROUP BY 1)),
  sg AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) AS idx FROM (SELECT segment AS token, count(*) AS c FROM o WHERE split='train' GROUP BY 1)),
  hv AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) AS idx FROM (SELECT token, count(*) AS c FROM (SELECT unnest(string_split(hist,'^')) AS token FROM o WHERE split='train') GROUP BY 1 HAVING count(*)>=200) WHERE token<>''),
  sc AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM o WHERE split='train')"""
_SPECS = [FeatureSpec("priority"), FeatureSpec("segment"), FeatureSpec("amount", "numeric", "float", normalizer="StandardScaler"),
          FeatureSpec("hist", "sequence", max_len=12, padding="pre", min_count=200, sequence_length=True)]


def _orders(spark, sf):
    o, c, y = V.table(spark, sf, "orders"), V.table(spark, sf, "customer"), F.year("o_orderdate")
    hist = V.histories(spark, sf).select(F.col("user_id").alias("o_custkey"), F.array_join("seq", "^").alias("hist"))     # joined once a document, not once an order
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(hist, "o_custkey", "left").select(
        F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"), F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"), F.col("o_totalprice").alias("amount"), F.coalesce("hist", F.lit("")).alias("hist"),
        F.when(y < 2000, "train").when(y < 2001, "valid").otherwise("test").alias("split"))
    return {s: d.filter(F.col("split") == s) for s in ("train", "valid", "test")}


_ENCODED = f"""WITH {_ORD}, {_FIT}, e AS (SELECT request_id, pos, CASE WHEN tk='' THEN 0 ELSE coalesce(idx,(SELECT coalesce(max(idx),0)+1 FROM hv)) END AS code FROM (SELECT request_id, unnest(string_split(hist,'^')) AS tk, generate_subscripts(string_split(hist,'^'),1) AS pos FROM o) LEFT JOIN hv ON tk=token),
  s AS (SELECT request_id, list(code ORDER BY pos) AS a FROM e GROUP BY 1)
  SELECT request_id, label, coalesce(pv.idx,(SELECT coalesce(max(idx),0)+1 FROM pv)) AS priority, coalesce(sg.idx,(SELECT coalesce(max(idx),0)+1 FROM sg)) AS segment, round((amount-m)/s,6)+0.0 AS amount,
  array_to_string(list_concat(list_resize([]::BIGINT[], greatest(12-len(a),0), 0), a[greatest(len(a)-11,1):]),'^') AS hist,
  coalesce(list_max([CASE WHEN trim(string_split(hist,'^')[i])<>'0' THEN i ELSE 0 END for i in range(1,len(string_split(hist,'^'))+1)]),0)::INTEGER AS hist_len
  FROM o JOIN s USING (request_id) LEFT JOIN pv ON priority=pv.token LEFT JOIN sg ON segment=sg.token, sc WHERE """


def _flat(d):
    return rounded(d.select("request_id", "label", "priority", "segment", "amount", TX.join_tokens(F.col("hist")).alias("hist"), "hist_len"))


@query("c1_prepared_holdout", _ENCODED.replace("list_max([CASE WHEN trim(string_split(hist", "list_max([CASE WHEN trim(string_split(o.hist").replace("len(string_split(hist,'^'))+1", "len(string_split(o.hist,'^'))+1") + "split='valid' AND label=1")
def _(spark, sf):
    tables, enc = J.prepare(_orders(spark, sf), _SPECS, "label", "request_id", "priority")
    return _flat(tables["valid"])


@query("c1_written_splits", _ENCODED.replace("SELECT request_id, label, coalesce(pv", "SELECT split, request_id, label, coalesce(pv").replace("list_max([CASE WHEN trim(string_split(hist", "list_max([CASE WHEN trim(string_split(o.hist").replace("len(string_split(hist,'^'))+1", "len(string_split(o.hist,'^'))+1") + "split='train' OR label=1")
def _(spark, sf):
    tables, enc = J.prepare(_orders(spark, sf), _SPECS, "label", "request_id", "priority")
    root = _place(spark, "prepared")
    fm = J.write_prepared(tables, enc, root, "orders", "label")
    assert {"priority", "segment", "amount", "hist", "hist_len"} <= set(fm.features)
    parts = [_flat(spark.read.parquet(f"{root}/{s}.parquet")).withColumn("split", F.lit(s)) for s in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a9_meta_ids_by_split", """WITH s AS (SELECT o_orderkey::VARCHAR AS token, CASE WHEN year(o_orderdate)<2000 THEN 0 WHEN year(o_orderdate)<2001 THEN 1 ELSE 2 END AS k FROM orders),
  t AS (SELECT token, row_number() OVER (ORDER BY token) AS idx FROM s WHERE k=0), n AS (SELECT (SELECT count(*) FROM t) AS a, (SELECT count(*) FROM s WHERE k=1) AS b)
  SELECT token, idx FROM t UNION ALL SELECT token, row_number() OVER (ORDER BY token)+a FROM s, n WHERE k=1 UNION ALL SELECT token, row_number() OVER (ORDER BY token)+a+b FROM s, n WHERE k=2""")
def _(spark, sf):
    o = _orders(spark, sf)
    specs = [FeatureSpec("request_id", "meta")]
    enc = J.fit(o["train"].select("request_id"), specs)
    out = [J.transform(o[s].select("request_id", F.col("request_id").cast("string").alias("token")), enc) for s in ("train", "valid", "test")]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("token", F.col("request_id").alias("idx"))


@query("c2_fitted_feature_map", f"""WITH {_ORD}, {_FIT} SELECT 'priority' AS feature, (SELECT coalesce(max(idx),0)+2 FROM pv) AS vocab_size, 0::BIGINT AS max_len UNION ALL SELECT 'segment', (SELECT coalesce(max(idx),0)+2 FROM sg), 0 UNION ALL SELECT 'hist', (SELECT coalesce(max(idx),0)+2 FROM hv), 12""")
def _(spark, sf):
    enc = J.fit(_orders(spark, sf)["train"], _SPECS)
    fm = enc.feature_map("orders", ["label"])
    rows = [(n, int(s["vocab_size"]), int(s.get("max_len", 0))) for n, s in fm.features.items() if "vocab_size" in s]
    return spark.createDataFrame(rows, "feature string, vocab_size long, max_len long")


@query("c3_encoded_columns", _ENCODED.replace("list_max([CASE WHEN trim(string_split(hist", "list_max([CASE WHEN trim(string_split(o.hist").replace("len(string_split(hist,'^'))+1", "len(string_split(o.hist,'^'))+1") + "true")
def _(spark, sf):
    parts = _orders(spark, sf)
    enc = J.fit(parts["train"], _SPECS)
    return _flat(J.transform(parts["train"].unionByName(parts["valid"]).unionByName(parts["test"]), enc))


@query("c6_rank_stage", _metrics_sql(V.CANDS + f""", {V.ITEMS}, sc AS (SELECT request_id, item_id, label, cands.score*0.5+size/100.0 AS score FROM cands JOIN items USING (item_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, label, item_id) AS rank FROM sc)""") + _avg_sql("all"))
def _(spark, sf):
    out = J.rank_stage(V.candidates(spark, sf), V.items(spark, sf), V.splits(spark, sf), F.col("score") * 0.5 + F.col("size") / 100.0, ["size"], ["user_id"], KS, TOPK)
    return rounded(out["metrics"])


_DIAG = V.CANDS + f""", {V.ITEMS}, pool AS (SELECT * FROM items WHERE size<40), sc AS (SELECT request_id, item_id, label, cands.score*0.5+size/100.0 AS score, brand, ptype FROM cands JOIN pool USING (item_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, label, item_id) AS rank, count(*) OVER (PARTITION BY request_id) AS width FROM sc)"""


def _auc_sql(name, src):
    return f""", {name}_s AS (SELECT score, sum(CASE WHEN label>0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label>0 THEN 0 ELSE 1 END) AS n FROM {src} GROUP BY 1),
  {name}_c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM {name}_s WINDOW w AS (ORDER BY score DESC)),
  {name} AS (SELECT sum(p*((SELECT sum(n) FROM {name}_s)-cn+0.5*n))/(sum(p)*sum(n))::DOUBLE AS auc, sum(p*(cp/(cp+cn)::DOUBLE))/sum(p) AS ap FROM {name}_c)"""


def _diag_sql():
    means = ["mrr", "gauc", *[f"{m}_{k}" for m in ("recall", "ndcg") for k in KS]]
    same = "((CASE WHEN a.brand=b.brand THEN 1 ELSE 0 END)+(CASE WHEN a.ptype=b.ptype THEN 1 ELSE 0 END))/2.0"
    sql = _metrics_sql(_DIAG) + f""", t AS (SELECT * FROM rr WHERE rank<={TOPK}),
  ta AS (SELECT p.request_id, avg(CASE WHEN p.score>n.score THEN 1.0 WHEN p.score=n.score THEN 0.5 ELSE 0.0 END) AS a FROM t p JOIN t n ON p.request_id=n.request_id WHERE p.pos=1 AND n.pos=0 GROUP BY 1),
  tk AS (SELECT request_id, max(width) AS n, sum(pos) AS p, min(CASE WHEN pos=1 THEN rank END) AS first FROM t GROUP BY 1),
  atk AS (SELECT sum(CASE WHEN n>={TOPK} AND p>0 THEN 1.0/first ELSE 0 END)/count(*) FILTER (WHERE p>0) AS mrr, sum(CASE WHEN n>={TOPK} AND p>0 THEN coalesce(a,0) ELSE 0 END)/count(*) FILTER (WHERE p>0) AS gauc FROM tk LEFT JOIN ta USING (request_id)),
  dl AS (SELECT avg(coalesce(s,0)) AS d FROM (SELECT DISTINCT request_id FROM ranked) LEFT JOIN (SELECT a.request_id, 1-avg({same}) AS s FROM t a JOIN t b ON a.request_id=b.request_id AND a.rank<b.rank GROUP BY 1) USING (request_id)),
  dc AS (SELECT avg(coalesce(s,0)) AS d FROM (SELECT DISTINCT request_id FROM ranked) LEFT JOIN (SELECT a.request_id, 1-avg({same}) AS s FROM ranked a JOIN ranked b ON a.request_id=b.request_id AND a.rank<b.rank GROUP BY 1) USING (request_id)),
  good AS (SELECT * FROM t WHERE request_id IN (SELECT request_id FROM t WHERE pos=1))""" + _auc_sql("ga", "ranked") + _auc_sql("gk", "good")
    rows = ["SELECT 'requests' AS metric, count(*)::DOUBLE AS value FROM pr", "SELECT 'requests_with_positive', count(*) FILTER (WHERE n_pos>0) FROM pr"]
    rows += [f"SELECT '{m}', sum(CASE WHEN n_pos>0 THEN {m} ELSE 0 END)/count(*) FROM pr" for m in means]
    rows += [f"SELECT 'mrr_at_{TOPK}', mrr FROM atk", f"SELECT 'gauc_at_{TOPK}', gauc FROM atk", f"SELECT 'diversity_{TOPK}', d FROM dl", "SELECT 'candidate_diversity', d FROM dc",
             "SELECT 'auc', auc FROM ga", "SELECT 'average_precision', ap FROM ga", f"SELECT 'auc_at_{TOPK}', auc FROM gk",
             "SELECT 'kept', count(pool.item_id) FROM cands LEFT JOIN pool USING (item_id)", "SELECT 'dropped', count(*)-count(pool.item_id) FROM cands LEFT JOIN pool USING (item_id)",
             "SELECT 'dropped_positives', count(*) FILTER (WHERE pool.item_id IS NULL AND label>0) FROM cands LEFT JOIN pool USING (item_id)"]
    return sql + " SELECT metric, round(value,6) AS value FROM (" + " UNION ALL ".join(rows) + ")"


def _diagnosed(spark, sf):
    c, pool = V.candidates(spark, sf), V.items(spark, sf).filter("size < 40")
    out = J.rank_stage(c, pool, None, F.col("score") * 0.5 + F.col("size") / 100.0, ["size"], ks=KS, k=TOPK)
    return J.stage_diagnostics(c, out["scored"], pool, KS, TOPK, ["brand", "ptype"])


@query("c6_rank_stage_diagnostics", _diag_sql())
def _(spark, sf):
    return rounded(_diagnosed(spark, sf)["metrics"])


@query("c6_rank_stage_report", f"""WITH {_DIAG} SELECT request_id, max(CASE WHEN rank=1 THEN item_id END) AS top1_item, round(max(CASE WHEN rank=1 THEN score END),6) AS top1_score,
  CAST(max(CASE WHEN rank=1 THEN CASE WHEN label>0 THEN 1 ELSE 0 END END) AS INTEGER) AS hit_at_1, '[' || string_agg(CASE WHEN rank<={TOPK} THEN item_id END, ',' ORDER BY rank) || ']' AS top_items,
  max_by(item_id, -rank) FILTER (WHERE label>0) AS positive_item, round(max_by(score, -rank) FILTER (WHERE label>0),6) AS positive_score FROM ranked GROUP BY request_id""")
def _(spark, sf):
    return rounded(_diagnosed(spark, sf)["report"])


@query("c7_rerank_stage", _metrics_sql(V.CANDS + f""", {V.ITEMS}, tr AS (SELECT request_id, item_id, teacher AS ts FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY teacher DESC, label, item_id) AS r FROM cands) WHERE r<={TOPK}),
  f AS (SELECT c.request_id, c.item_id, label, c.score+0.25*coalesce(ts,0)+size/1000.0 AS score, ts IS NOT NULL AS kept FROM cands c JOIN items USING (item_id) LEFT JOIN tr ON c.request_id=tr.request_id AND c.item_id=tr.item_id),
  ranked AS (SELECT *, CASE WHEN kept THEN row_number() OVER (PARTITION BY request_id, kept ORDER BY score DESC, label, item_id) ELSE NULL END AS rank,
    row_number() OVER (PARTITION BY request_id ORDER BY score DESC, label, item_id) AS full_rank FROM f)""").replace("1.0/min(CASE WHEN pos=1 THEN rank END)", "1.0/min(CASE WHEN pos=1 THEN full_rank END)") + _avg_sql("all"))
def _(spark, sf):
    c = V.candidates(spark, sf)
    pre = top_k(c, ["request_id"], R.pessimistic_order("teacher"), TOPK).select("request_id", "item_id", F.col("teacher").alias("score"))
    out = J.rerank_stage(c, pre, V.items(spark, sf), F.col("score") + F.col("size") / 1000.0, ["size"], KS, TOPK, 0.25)
    return rounded(out["metrics"])


@query("c8_observed_candidates", f"""WITH {V.IMPS}, f AS (SELECT request_id FROM (SELECT request_id, min(shipdate) AS d FROM imps GROUP BY 1) ORDER BY d, request_id LIMIT 500)
  SELECT request_id, item_id, max(CASE WHEN label>0 THEN 1 ELSE 0 END)::INTEGER AS label, 0.0::DOUBLE AS score FROM imps WHERE request_id IN (SELECT request_id FROM f) GROUP BY 1,2""")
def _(spark, sf):
    i = V.impressions(spark, sf).select("request_id", "item_id", "label", "shipdate", "user_id", "line_no")
    return J.observed_candidates(i, "request_id", "item_id", "label", ["shipdate", "line_no", "item_id"], 500)[0]


@query("c8_observed_users", f"""WITH {V.IMPS}, f AS (SELECT request_id FROM (SELECT request_id, min(shipdate) AS d FROM imps GROUP BY 1) ORDER BY d, request_id LIMIT 500),
  n AS (SELECT request_id, item_id, label, shipdate, user_id, line_no, row_number() OVER (PARTITION BY request_id ORDER BY shipdate, line_no, item_id, label, user_id) AS n FROM imps WHERE request_id IN (SELECT request_id FROM f)) SELECT * EXCLUDE (n) FROM n WHERE n=1""")
def _(spark, sf):
    i = V.impressions(spark, sf).select("request_id", "item_id", "label", "shipdate", "user_id", "line_no")
    return J.observed_candidates(i, "request_id", "item_id", "label", ["shipdate", "line_no", "item_id"], 500)[1]


_SPL = _SIDE + """, sp AS (SELECT split, 'item' AS side, item_id::VARCHAR AS id, count(*) AS n FROM imps GROUP BY 1,3 UNION ALL SELECT split, 'user', user_id::VARCHAR, count(*) FROM imps GROUP BY 1,3), al AS (SELECT * FROM sp UNION ALL SELECT 'all', side, id, n FROM f WHERE side<>'request')"""


@query("c10_dataset_statistics", _SPL + """, o AS (SELECT *, row_number() OVER (PARTITION BY split, side ORDER BY n)-1 AS i, count(*) OVER (PARTITION BY split, side) AS t FROM al)
  SELECT split, side, count(*) AS unique_ids, CAST(sum(n) AS BIGINT) AS total_events, min(n) AS min, max(n) AS max, round(avg(n),6) AS mean, """ +
       ", ".join(f"max(CASE WHEN i=CAST(round_even((t-1)*{q}::DOUBLE,0) AS BIGINT) THEN n END) AS p{int(q*100)}" for q in (0.5, 0.9, 0.99)) + " FROM o GROUP BY 1,2")
def _(spark, sf):
    return rounded(J.statistics(V.impressions(spark, sf), "label", {"item": "item_id", "user": "user_id"})["sides"])


@query("s25_incremental_statistics", SQL["c10_dataset_statistics"])
def _(spark, sf):
    """The statistics of a table whose last file came after the others were counted: only that file is read for them."""
    root, i = _place(spark, "growing"), V.impressions(spark, sf)
    part = F.pmod(F.col("request_id"), F.lit(3))
    partials = INC.dataset_partials("label", {"item": "item_id", "user": "user_id"})
    for k in range(3):
        i.filter(part == k).write.mode("append").parquet(f"{root}/table")
        if k:
            parts = INC.refresh(spark, f"{root}/table", f"{root}/stats", partials)
    return rounded(INC.merged_statistics(parts)["sides"])


def _written_statistics(spark, sf, part):
    root = _place(spark, "statistics")
    tables = J.statistics(V.impressions(spark, sf), "label", {"item": "item_id", "user": "user_id"})
    RL.write_statistics({part: tables[part]}, root)
    return spark.read.schema(tables[part].schema).json(f"{root}/{part}")


@query("c10_written_profile", f"WITH {V.IMPS} SELECT CASE WHEN grouping(split)=1 THEN 'all' ELSE split END AS split, {_PROF} FROM imps GROUP BY ROLLUP(split)")
def _(spark, sf):
    return rounded(_written_statistics(spark, sf, "profile"))


@query("c10_written_labels", f"WITH {V.IMPS}, d AS (SELECT split, label::VARCHAR AS raw, label AS v FROM imps) SELECT split, {_LD} FROM d GROUP BY 1")
def _(spark, sf):
    return rounded(_written_statistics(spark, sf, "labels"))


@query("c10_written_top_ids", _SPL + ", r AS (SELECT *, row_number() OVER (PARTITION BY split, side ORDER BY n DESC, id) AS rank FROM al) SELECT split, side, id, n, rank::INTEGER AS rank FROM r WHERE rank<=10")
def _(spark, sf):
    return _written_statistics(spark, sf, "top")


_GOT = f"""{_AI.replace('ranked AS', 'ranked0 AS')}, {_ASM}, mx AS (SELECT max(np) AS m FROM np),
  got AS (SELECT request_id, item_id, CASE WHEN place<=20+(SELECT m FROM mx) THEN score ELSE 0 END AS score, 1 AS label FROM pl WHERE label=1 UNION ALL SELECT request_id, item_id, score, 0 FROM neg JOIN np USING (request_id) WHERE nn<=20-np)"""
_FUNNEL_MEANS = ["mrr", "gauc", "recall_1", "recall_5", "ndcg_1", "ndcg_5"]


def _stage_rows(stage):
    rows = [f"SELECT '{stage}' AS stage, 'valid' AS split, 'requests' AS metric, count(*)::DOUBLE AS value FROM pr", f"SELECT '{stage}', 'valid', 'requests_with_positive', count(*) FILTER (WHERE n_pos>0) FROM pr"]
    return rows + [f"SELECT '{stage}', 'valid', '{m}', round(sum(CASE WHEN n_pos>0 THEN {m} ELSE 0 END)/count(*),6) FROM pr" for m in _FUNNEL_MEANS]


def _funnel(spark, sf):
    return J.three_stages(V.vectors(spark, sf, "request_id"), V.vector_positives(spark, sf), V.vectors(spark, sf), F.col("score") + F.col("kind") / 100.0,
                          F.col("score") + F.col("kind") / 50.0, ["kind"], (20, 10, 5), [1, 5], popularity=item_popularity(V.lines(spark, sf), "item_id", "label"))


@query("c13_three_stage_run", _metrics_sql(f"""{_GOT}, pop AS (SELECT l_partkey AS item_id, count(*) AS c FROM lineitem WHERE l_returnflag='R' GROUP BY 1),
  ranked AS (SELECT g.request_id, g.item_id, g.label, g.score+e.label/100.0 AS score, row_number() OVER (PARTITION BY g.request_id ORDER BY g.score+e.label/100.0 DESC, g.label, g.item_id) AS rank FROM got g JOIN embeddings e ON e.vec_id=g.item_id)""", ks=[1, 5]) +
       """, hr AS (SELECT vec_id, min(CASE WHEN g.label>0 THEN rk END) AS best FROM embeddings LEFT JOIN (SELECT request_id, got.label, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, got.label, item_id) AS rk FROM got) g ON request_id=vec_id GROUP BY 1),
  po AS (SELECT vec_id, min(CASE WHEN g.label>0 THEN rk END) AS best FROM embeddings LEFT JOIN (SELECT request_id, got.label, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(c,0) DESC, item_id) AS rk FROM got LEFT JOIN pop USING (item_id)) g ON request_id=vec_id GROUP BY 1)
  """ + " UNION ALL ".join(_stage_rows("preranking") + [f"SELECT 'retrieval', 'valid', '{n}_{k}', round(count(*) FILTER (WHERE best<={k})/count(*)::DOUBLE,6) FROM {t}" for n, t in (("hit_rate", "hr"), ("popularity_recall", "po")) for k in (1, 5)]))
def _(spark, sf):
    return rounded(_funnel(spark, sf)["metrics"].filter("stage <> 'reranking'"))


@query("c13_reranking_metrics", _metrics_sql(f"""{_GOT}, tr AS (SELECT request_id, item_id FROM (SELECT g.request_id, g.item_id, row_number() OVER (PARTITION BY g.request_id ORDER BY g.score+e.label/100.0 DESC, g.label, g.item_id) AS r FROM got g JOIN embeddings e ON e.vec_id=g.item_id) WHERE r<=10),
  f AS (SELECT g.request_id, g.item_id, g.label, g.score+e.label/50.0 AS score, tr.item_id IS NOT NULL AS kept FROM got g JOIN embeddings e ON e.vec_id=g.item_id LEFT JOIN tr ON tr.request_id=g.request_id AND tr.item_id=g.item_id),
  ranked AS (SELECT *, CASE WHEN kept THEN row_number() OVER (PARTITION BY request_id, kept ORDER BY score DESC, label, item_id) ELSE NULL END AS rank, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, label, item_id) AS full_rank FROM f)""", ks=[1, 5])
       .replace("1.0/min(CASE WHEN pos=1 THEN rank END)", "1.0/min(CASE WHEN pos=1 THEN full_rank END)") + " " + " UNION ALL ".join(_stage_rows("reranking")))
def _(spark, sf):
    return rounded(_funnel(spark, sf)["metrics"].filter("stage = 'reranking'"))


@query("c13_three_stage_lists", f"""WITH {_AI.replace('ranked AS', 'ranked0 AS')}, {_ASM}, mx AS (SELECT max(np) AS m FROM np),
  got AS (SELECT request_id, item_id, CASE WHEN place<=20+(SELECT m FROM mx) THEN score ELSE 0 END AS score, 1 AS label FROM pl WHERE label=1 UNION ALL SELECT request_id, item_id, score, 0 FROM neg JOIN np USING (request_id) WHERE nn<=20-np),
  r AS (SELECT request_id, item_id, g.score+e.label/50.0 AS score, row_number() OVER (PARTITION BY request_id ORDER BY g.score+e.label/50.0 DESC, g.label, item_id) AS rank FROM got g JOIN embeddings e ON e.vec_id=g.item_id)
  SELECT request_id, item_id, round(score,6) AS score, rank::INTEGER AS rank FROM r WHERE rank<=5""")
def _(spark, sf):
    it = V.vectors(spark, sf)
    out = J.three_stages(V.vectors(spark, sf, "request_id"), V.vector_positives(spark, sf), it, F.col("score") + F.col("kind") / 100.0,
                         F.col("score") + F.col("kind") / 50.0, ["kind"], (20, 10, 5), [1, 5])
    return rounded(out["reranked"].select("request_id", "item_id", "score", "rank"))


def _report_sql(src, prefix):
    """Every column of the pointwise report of (request_id, label, p) rows."""
    t = f"{prefix}t"
    cte = f""", {t}s AS (SELECT p, sum(CASE WHEN label>0 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label>0 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY 1),
  {t}c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn FROM {t}s),
  {t}a AS (SELECT sum(pos*((SELECT sum(neg) FROM {t}s)-cn+0.5*neg))/(sum(pos)*sum(neg))::DOUBLE AS auc, sum(pos*(cp/(cp+cn)::DOUBLE))/sum(pos) AS ap FROM {t}c),
  {t}g AS (SELECT x.request_id, avg(CASE WHEN x.p>y.p THEN 1.0 WHEN x.p=y.p THEN 0.5 ELSE 0.0 END) AS a FROM {src} x JOIN {src} y ON x.request_id=y.request_id WHERE x.label>0 AND y.label<=0 GROUP BY 1),
  {t}n AS (SELECT request_id, count(*) AS n FROM {src} GROUP BY 1), {t}w AS (SELECT sum(a*n)/sum(n) AS gauc, count(*) AS g, CAST(sum(n) AS BIGINT) AS s FROM {t}g JOIN {t}n USING (request_id)),
  {t}r AS (SELECT count(*) AS {prefix}sample_count, round(avg(label),6) AS {prefix}positive_ratio, round(min(p),6) AS {prefix}pred_min, round(avg(p),6) AS {prefix}pred_mean, round(max(p),6) AS {prefix}pred_max,
    round(avg(-(label*ln(p)+(1-label)*ln(1-p))),6) AS {prefix}logloss, round(sum(p)/sum(label),6) AS {prefix}pcoc, round(sum(label)/sum(p),6) AS {prefix}copc, round((SELECT auc FROM {t}a),6) AS {prefix}auc,
    round((SELECT ap FROM {t}a),6) AS {prefix}prauc, round(quantile_cont(p,0.01),6) AS {prefix}pred_p01, round(quantile_cont(p,0.5),6) AS {prefix}pred_p50, round(quantile_cont(p,0.99),6) AS {prefix}pred_p99,
    round((SELECT gauc FROM {t}w),6) AS {prefix}gauc, (SELECT g FROM {t}w) AS {prefix}gauc_valid_groups, (SELECT s FROM {t}w) AS {prefix}gauc_valid_samples FROM {src})"""
    return cte


@query("c14_blended_report", f"WITH {V.CANDS}, {_BLEND}, one AS (SELECT request_id, label, score AS p FROM cands), two AS (SELECT request_id, label, 1/(1+exp(-score)) AS p FROM bl)"
       + _report_sql("one", "") + _report_sql("two", "blend_") + " SELECT tr.*, blend_tr.* FROM tr, blend_tr")
def _(spark, sf):
    pop = item_popularity(V.lines(spark, sf), "item_id", "label")
    return rounded(J.blended_report(V.candidates(spark, sf), pop, 0.3, "request_id"))


@query("c15_inferred_feature_map", f"WITH {V.CODED} SELECT 'item_code' AS feature, 'categorical' AS type, max(item_code)+1 AS vocab_size, 0::BIGINT AS max_len FROM coded UNION ALL SELECT 'item_seq', 'sequence', max(list_max(item_seq))+1, max(len(item_seq)) FROM coded")
def _(spark, sf):
    fm = J.infer_feature_map(V.coded(spark, sf), ["item_code", "item_seq"], "coded", ["label"])
    return spark.createDataFrame([(n, s["type"], int(s["vocab_size"]), int(s.get("max_len", 0))) for n, s in fm.features.items()],
                                 "feature string, type string, vocab_size long, max_len long")
