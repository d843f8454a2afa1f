"""From raw documents to packed training sequences: filter, deduplicate, mask and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumirank.llm import jaccard, langid, packing, secrets, toxicity
from lumirank.session import configure, stable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.5              # documents go whose probability of any toxicity reaches this
LANGUAGE_FROM = 0.25          # documents go whose best language profile is less alike than this
WORDS, NUM, DEN = 5, 80, 100  # near-duplicates: five-word shingles, similarity of 0.8 or more
TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't find toxic; null and empty texts stay."""
    configure(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.severity(docs, model, keep=COLUMNS).filter(F.col("p_toxic") < TOXIC_FROM).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in one of the languages named in `lang`; a missing lang is filled in.

    Texts that are null, have no letter or resemble no profile go.
    """
    configure(spark)
    named = langid.predict(docs, langid.learn(docs), keep=COLUMNS)
    return (named.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_FROM))
            .withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each connected group, that of the smallest id (null ids last); texts without words stay.

    Rows are told apart by a key of their own, so repeated and null ids are rows like any other.
    """
    configure(spark)
    keyed = stable(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    groups = stable(jaccard.similar_groups(keyed.select("row", "text"), k=WORDS, num=NUM, den=DEN, id_col="row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    kept = (groups.filter("n_shingles > 0").select("row", "component_id").join(keyed.select("row", "doc_id"), "row")
            .groupBy("component_id").agg(first).select(F.col("first.row").alias("row")))
    kept = kept.unionByName(groups.filter("n_shingles = 0").select("row"))
    return keyed.join(kept, "row", "left_semi").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by the name of their kind; n_chars follows the text."""
    configure(spark)
    found = secrets.find_secrets(docs, keep=COLUMNS, words=secrets.learn_words(docs))
    hit = F.size("spans") > 0
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source",
                        F.when(hit, F.length("masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its training sequence and place in it."""
    import public_tokenizers

    configure(spark)
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("language ID", keep_known_languages), ("n-gram Jaccard join", drop_near_duplicates),
          ("secret scans", mask_secrets), ("best-fit packing", pack_sequences)]

# models, tokenizers and graph components are beyond SQL; tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again by the next."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
