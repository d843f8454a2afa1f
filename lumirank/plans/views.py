"""Recommendation views over the given tables, and the same views as SQL.

An order is a request, its lines are the impressions, parts are items, customers users.
Labels, scores and split follow from the line's and order's own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per impression, from the line table alone."""
    q, d = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    p, n, s = F.col("l_partkey"), F.col("l_linenumber").cast("long"), F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), p.alias("item_id"), n.alias("line_no"), s.alias("supp_id"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
        (((q * 37 + d * 101 + n * 13 + p * 7) % 97 + 1) / 98.0).alias("score"),
        (((q * 29 + d * 67 + n * 17 + s * 5) % 89 + 1) / 90.0).alias("teacher"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("shipdate"))


LINES = """lines AS (SELECT l_orderkey AS request_id, l_partkey AS item_id, CAST(l_linenumber AS BIGINT) AS line_no,
  l_suppkey AS supp_id, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
  ((CAST(l_quantity AS BIGINT)*37 + CAST(round(l_discount*100) AS BIGINT)*101 + l_linenumber*13 + l_partkey*7) % 97 + 1) / 98.0::DOUBLE AS score,
  ((CAST(l_quantity AS BIGINT)*29 + CAST(round(l_discount*100) AS BIGINT)*67 + l_linenumber*17 + l_suppkey*5) % 89 + 1) / 90.0::DOUBLE AS teacher,
  l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_linestatus AS status,
  l_returnflag AS flag, l_shipdate AS shipdate FROM lineitem)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (request, item)."""
    return lines(spark, sf).groupBy("request_id", "item_id").agg(
        F.max("label").alias("label"), F.max("score").alias("score"), F.max("teacher").alias("teacher"))


CANDS = LINES + """, cands AS (SELECT request_id, item_id, max(label) AS label, max(score) AS score, max(teacher) AS teacher
  FROM lines GROUP BY request_id, item_id)"""

RANKED = CANDS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, label, item_id) AS rank FROM cands)"""


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """Order id, user, position and split by order date."""
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("priority"),
        F.when(y < 2000, "train").when(y < 2001, "valid").otherwise("test").alias("split"))


SPLITS = """splits AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, o_orderpriority AS priority,
  CASE WHEN year(o_orderdate) < 2000 THEN 'train' WHEN year(o_orderdate) < 2001 THEN 'valid' ELSE 'test' END AS split FROM orders)"""


def impressions(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).join(splits(spark, sf), "request_id")


IMPS = LINES + ", " + SPLITS + ", imps AS (SELECT * FROM lines JOIN splits USING (request_id))"


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"),
        F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("retail"))


ITEMS = """items AS (SELECT p_partkey AS item_id, p_brand AS brand, p_type AS ptype, p_size AS size, p_name AS name,
  p_retailprice AS retail FROM part)"""


def with_features(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    return df.join(items(spark, sf), "item_id")


def histories(spark: SparkSession, sf: str) -> DataFrame:
    """A list of numbers per row, of any length: the word lengths of a document, keyed as a user's."""
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("user_id"),
                                                F.transform(words, lambda w: F.length(w).cast("string")).alias("seq"))


HISTORY = """hist AS (SELECT doc_id AS user_id, [length(w)::VARCHAR for w in string_split(coalesce(text,''),' ')] AS seq FROM documents)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event of a user and the item key it names."""
    return table(spark, sf, "events").select("user_id", F.regexp_extract("props", r"(\d+)", 1).alias("k"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def vectors(spark: SparkSession, sf: str, key: str = "item_id") -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias(key), "embedding", F.col("label").alias("kind"))


def vector_positives(spark: SparkSession, sf: str) -> DataFrame:
    """The next one to three vectors by id are the positives of a vector."""
    v = vectors(spark, sf, "request_id")
    ahead = v.select("request_id", F.explode(F.sequence(F.lit(1), F.col("kind") % 3 + 1)).alias("step"))
    ahead = ahead.select("request_id", (F.col("request_id") + F.col("step")).alias("item_id"))
    return ahead.join(vectors(spark, sf).select("item_id"), "item_id", "left_semi").select("request_id", "item_id")


VECPOS = """vp AS (SELECT e.vec_id AS request_id, e.vec_id + d AS item_id FROM embeddings e,
  unnest(generate_series(1, e.label % 3 + 1)) AS g(d) WHERE e.vec_id + d IN (SELECT vec_id FROM embeddings))"""

DOTS = """dots AS (SELECT u.vec_id AS request_id, i.vec_id AS item_id,
  round(list_inner_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS score FROM embeddings u CROSS JOIN embeddings i)"""


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """An encoded table with gaps in its ids: scalar codes and an array that shares the item ids."""
    item = F.col("l_partkey") * 3 + 2
    return table(spark, sf, "lineitem").select(
        F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate").alias("row_key"),
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").cast("long").alias("line_no"),
        item.alias("item_code"), (F.col("l_suppkey") * 2 + 1).alias("supp_code"),
        F.array(item, (F.col("l_suppkey") * 3 + 2), F.lit(0).cast("long")).alias("item_seq"))


CODED = """coded AS (SELECT l_orderkey AS request_id, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey*3+2 AS item_code,
  l_suppkey*2+1 AS supp_code, [l_partkey*3+2, l_suppkey*3+2, 0] AS item_seq,
  l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_shipdate FROM lineitem)"""
