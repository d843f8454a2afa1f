"""Queries that drive declared specs, groups and configuration over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumirank import config as CF
from lumirank.functions import text as TX
from lumirank.operators import filters as FL
from lumirank.plans import views as V
from lumirank.plans.registry import query, rounded
from lumirank.schema import (FeatureGroups, FeatureMap, FeatureSpec, drop_unsafe_shares, expand_features, normal_type,
                             preprocess, project_groups, resolve_dtype)
from lumirank.session import shared_dir
from lumirank.sources import tabular as TB
from lumirank.sources.relations import write_json


def _sidecar(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


@query("p3_declared_types", "SELECT l_orderkey::BIGINT AS request_id, l_partkey::INTEGER AS item_id, l_quantity::DOUBLE AS quantity, l_linestatus AS status, l_linenumber::SMALLINT AS line_no FROM lineitem")
def _(spark, sf):
    types = {"request_id": "int", "item_id": "np.int32", "quantity": "float64", "status": "str", "line_no": "uint8"}
    return V.lines(spark, sf).select([F.col(c).cast(resolve_dtype(t, c)).alias(c) for c, t in types.items()])


@query("p6_training_rows", f"WITH {V.IMPS} SELECT 'pairwise' AS mode, request_id, item_id, line_no FROM imps WHERE split='train' AND label=1 UNION ALL SELECT 'hybrid', request_id, item_id, line_no FROM imps WHERE split='train'")
def _(spark, sf):
    train = V.impressions(spark, sf).filter("split = 'train'").select("request_id", "item_id", "line_no", "label")
    out = None
    for mode, params in (("pairwise", {"num_negatives": 2, "diversity_num_negatives": 4}), ("hybrid", {"num_negatives": 4, "hybrid": True})):
        c = CF.negative_config(params)
        part = FL.train_view(train, c["num_negatives"], c["hybrid"]).select(F.lit(mode).alias("mode"), "request_id", "item_id", "line_no")
        out = part if out is None else out.unionByName(part)
    return out


@query("p12_expanded_features", f"WITH {V.IMPS} SELECT label, request_id, coalesce(status,'') AS status, coalesce(flag,'') AS flag, quantity FROM imps")
def _(spark, sf):
    specs = expand_features([{"name": ["status", "flag"], "type": "sparse"}, {"name": "quantity", "type": "dense", "dtype": "float"},
                             {"name": "tax", "type": "dense", "dtype": "float", "feature_group": "drop"}], {"flag": "status"})
    return preprocess(V.impressions(spark, sf), specs, ["label"], ["request_id"])


@query("p13_configured_scan", f"WITH {V.IMPS} SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM imps WHERE split<>'train' GROUP BY 1")
def _(spark, sf):
    root = f"{shared_dir(spark)}/configured-{uuid.uuid4().hex}"
    i = V.impressions(spark, sf).select("request_id", "item_id", "label", "split")
    for s in ("valid", "test"):
        i.filter(F.col("split") == s).write.parquet(f"{root}/{s}.parquet")
    path = _sidecar(spark, "config.json")
    write_json(spark, path, {"seed": 7, "datasets": {"orders": {"processed_root": root, "label_col": "label", "item_id_col": "item_id",
                                                      "impression_id_col": "request_id", "feature_cols": [{"name": "split"}]}}})
    cfg = CF.validate_config(CF.load_config(spark, path, "orders"))
    paths = CF.split_paths(cfg, processed=True)
    d = TB.read_parquet(spark, [paths["valid"], paths["test"]], ["split", cfg["label_col"]])
    return d.groupBy("split").agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("positives"))


@query("p27_normalised_specs", f"WITH {V.LINES} SELECT request_id, quantity, price FROM lines")
def _(spark, sf):
    specs = {"quantity": "dense", "price": "float", "status": "sparse", "flag": "categorical"}
    numeric = [n for n, t in specs.items() if normal_type(t) == "numeric"]
    return V.lines(spark, sf).select("request_id", *numeric)


@query("p28_safe_shares", f"WITH {V.LINES} SELECT request_id, supp_id FROM lines")
def _(spark, sf):
    top = V.lines(spark, sf).agg(F.max("item_id").alias("item_id"), F.max("supp_id").alias("supp_id")).first()
    specs = {n: {"type": "categorical", "vocab_size": top[n] + 1} for n in ("item_id", "supp_id")}
    specs["supp_id"]["share_embedding"] = "item_id"            # smaller than its target: kept
    specs["item_id"]["share_embedding"] = "supp_id"            # larger than its target: dropped
    kept = [n for n, s in drop_unsafe_shares(specs).items() if "share_embedding" in s]
    return V.lines(spark, sf).select("request_id", *kept)


@query("s19_feature_map_file", f"WITH {V.IMPS} SELECT price, supp_id FROM imps")
def _(spark, sf):
    fm = FeatureMap("imps", ["label"], {"price": {"type": "numeric", "source": "item"}, "supp_id": {"type": "categorical", "source": "item"},
                                       "priority": {"type": "categorical", "source": "user"}, "request_id": {"type": "meta"}})
    path = _sidecar(spark, "feature_map.json")
    fm.save(spark, path)
    return V.impressions(spark, sf).select(*FeatureMap.load(spark, path).role(source="item"))


@query("s20_feature_group_file", f"WITH {V.IMPS} SELECT request_id, price, priority FROM imps")
def _(spark, sf):
    path = _sidecar(spark, "groups.csv")
    FeatureGroups({"price": "FG1", "priority": "FG2", "status": "FG3"}).save(spark, path)
    return project_groups(V.impressions(spark, sf), FeatureGroups.load(spark, path), ["FG1", "FG2"], ["request_id"])


@query("f22_json_values", f"""WITH {V.LINES} SELECT '{{"request_id":'||request_id||',"item_id":'||item_id||',"status":"'||status||'"}}' AS value FROM lines""")
def _(spark, sf):
    return V.lines(spark, sf).select(F.to_json(F.struct("request_id", "item_id", "status")).alias("value"))


@query("f23_safe_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM pages")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", TX.slug(F.col("url")).alias("name"))


@query("x6_loader_by_format", f"WITH {V.IMPS} SELECT request_id, round(score,6) AS score FROM imps WHERE split='test'")
def _(spark, sf):
    root = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    V.impressions(spark, sf).filter("split = 'test'").select("request_id", "score").write.csv(f"{root}/test.csv", header=True)
    schema = TB.csv_schema([FeatureSpec("score", "numeric", "float")], {"request_id": "int64"})
    return rounded(TB.read_split(spark, root, "test", "csv", schema=schema))
