"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumirank.llm import collocations, fingerprints, jaccard, langid, packing, periods, pieces, quality, search, secrets, sharding, token_counts, toxicity
from lumirank.llm.base import fold
from lumirank.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


TOXIC_FROM = 0.5              # P(grade >= 1) from which a document counts as toxic


@query("op1_toxicity_severity")
def _(spark, sf):
    """Expected severity, most likely grade and toxic flag of every document."""
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    out = toxicity.severity(docs, model, keep=["doc_id"])
    return out.withColumn("toxic", F.col("p_toxic") >= TOXIC_FROM)


@query("op2_language_profiles")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 5) == 0
    profiles = langid.learn(docs.filter(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), profiles, keep=["doc_id", "held_out"])


@query("op3_exact_fit_packing")
def _(spark, sf):
    return packing.pack(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


@query("op4_byte_cnn_quality")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held = fold("doc_id", 4) == 2
    model = quality.fit(docs, table(spark, sf, "labels").filter(~held))
    return quality.score(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


@query("op5_order_minhash")
def _(spark, sf):
    return fingerprints.fingerprint_with_edits(table(spark, sf, "documents").select("doc_id", "text"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op6_secret_scan")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = secrets.find_secrets(docs, keep=["doc_id"], words=secrets.learn_words(docs))
    base = F.filter("spans", lambda s: s["kind"] != "guess")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                        count("guess").alias("n_guess"))


@query("op8_cached_token_counts")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, tokenizer_path("word_bpe_49k.json"), token_counts.new_cache(spark))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op9_piece_codec")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("piece_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_ngram_jaccard_join")
def _(spark, sf):
    return jaccard.similar_groups(table(spark, sf, "documents").select("doc_id", "text"))


@query("op7_block_max_search")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return search.search(docs, docs.filter("doc_id % 20 = 0"), query_terms=None, k3=None)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document (crc32 of its id) goes on in a period from one of its words; others and null ids stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    n, a, g = F.col("n"), F.col("a"), F.floor(h / 10)
    counted = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    placed = counted.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    cycle = F.slice("words", a + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / F.col("p")).cast("int"))), 1, n - a)
    edited = F.array_join(F.concat(F.slice("words", 1, a), tail), " ")
    return placed.select("doc_id", F.when(n > 0, edited).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def _(spark, sf):
    """Periodic runs of every document, the longest of them, and digests of all runs and of the text without repeats."""
    docs = with_planted_periods(table(spark, sf, "documents").select("doc_id", "text"))
    found = periods.find_periodic_runs(docs, keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("top", longest)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.l").alias("length"),
                        (-F.col("top.p")).alias("period"), F.floor(1000 * F.col("top.l") / -F.col("top.p")).alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


SHARDS, SHARD_SEED = 24, 2024


@query("op13_feistel_shards")
def _(spark, sf):
    """Shard and slot of every document; counts differ by one at most."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.assign_shards(docs, SHARDS, SHARD_SEED, keep=["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


@query("op11_phrase_collocations", r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, ws FROM (
    SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda w: w <> '') AS ws FROM (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS p
      FROM documents)) WHERE len(ws) > 0),
grams AS (
  SELECT lang, list_aggregate(ws[i:i + m - 1], 'string_agg', ' ') AS phrase, m FROM (
    SELECT lang, ws, i, unnest(range(1, least(3, len(ws) - i + 1) + 1)) AS m FROM (
      SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces))),
f AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 10),
cuts AS (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
         FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM cand WHERE m = 3),
absorbed AS (SELECT lang, phrase, max(longer) AS longer FROM inner_pairs GROUP BY ALL),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, s.score
  FROM least_cut s LEFT JOIN absorbed b ON b.lang = s.lang AND b.phrase = s.phrase
  WHERE b.longer IS NULL OR 100 * b.longer < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def _(spark, sf):
    """The 2,000 best phrases of two and three words of each language."""
    return collocations.mine_collocations(table(spark, sf, "documents").select("lang", "text"))
