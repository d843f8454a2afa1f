"""Composite jobs built from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumirank.functions import text
from lumirank.functions.numeric import hash_bucket, quantile_bucket
from lumirank.operators import (audit, classification, diversity, filters, pools, rank, ranking_metrics, remap, retrieve,
                                scaling, stats, vocab)
from lumirank.operators.ordering import first_per_key, with_row_number
from lumirank.schema import FeatureGroups, FeatureMap, FeatureSpec, normal_type, preprocess
from lumirank.session import stable
from lumirank.sources import clicklog, relations, tabular


# ---------------------------------------------------------------- preprocess

@dataclass
class Encoder:
    """What `fit` learned from train rows: vocabularies, scalers, boundaries, sizes."""
    specs: list[FeatureSpec]
    vocabs: dict[str, DataFrame] = field(default_factory=dict)
    oov: dict[str, int] = field(default_factory=dict)
    scalers: dict[str, tuple[float, float]] = field(default_factory=dict)
    boundaries: dict[str, list[float]] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)

    def table(self, s: FeatureSpec) -> str:
        return s.share_embedding or s.name

    def feature_map(self, dataset: str, labels: list[str]) -> FeatureMap:
        fm = FeatureMap(dataset, labels)
        for s in self.specs:
            if not s.active:
                continue
            d = {"type": s.type, "source": s.source}
            if s.category_processor:
                d.update(category_processor=s.category_processor, vocab_size=s.num_buckets)
            elif s.type in ("categorical", "sequence"):
                oov = self.oov[self.table(s)]
                d.update(padding_idx=0, oov_idx=oov, vocab_size=oov + 1)
            if s.share_embedding:
                d["share_embedding"] = s.share_embedding
            if s.type == "sequence":
                d["max_len"] = self.lengths[s.name]
                if s.sequence_length:
                    fm.features[f"{s.name}_len"] = {"type": "numeric", "source": s.source, "derived_from": s.name}
            fm.features[s.name] = d
        return fm


def fit(train: DataFrame, specs: Sequence[FeatureSpec]) -> Encoder:
    """Learn every column from train rows: the tokens of all columns are counted in one scan and ranked in one sort.
    Shared vocabularies grow in spec order."""
    enc = Encoder(list(specs))
    active = [s for s in specs if s.active]
    for kind in ("StandardScaler", "MinMaxScaler"):
        cols = [s.name for s in active if s.type == "numeric" and s.normalizer == kind]
        if cols:
            enc.scalers.update(scaling.fit_scaler(train, cols, kind))
    seqs = [s for s in active if s.type == "sequence"]
    unset = [s for s in seqs if not s.max_len]
    enc.lengths = {s.name: s.max_len for s in seqs}
    if unset:
        row = train.agg(*[F.max(F.size(text.tokens(F.col(s.name), s.splitter))).alias(s.name) for s in unset]).first()
        enc.lengths.update({s.name: row[s.name] or 0 for s in unset})
    counted = {}
    for s in active:
        if s.category_processor == "quantile_bucket":
            enc.boundaries[s.name] = scaling.quantile_boundaries(train, s.name, s.num_buckets)
        elif s.category_processor == "hash_bucket" or s.type not in ("categorical", "sequence", "meta"):
            continue
        elif s.category_processor:
            raise NotImplementedError(f"category_processor={s.category_processor}")
        else:
            counted[s.name] = s
    if not counted:
        return enc
    counts = vocab.stacked_counts(train, {n: s.splitter if s.type == "sequence" else None for n, s in counted.items()})
    fitted = vocab.build_vocabs(counts, {n: {"max_features": s.max_features, "min_freq": s.min_count, "na_value": str(s.fill()), "remap": s.remap}
                                         for n, s in counted.items()})
    for n, s in counted.items():
        mine, oov = fitted[n]
        name = enc.table(s)
        if name in enc.vocabs:
            mine = vocab.merge_vocab(enc.vocabs[name], mine, s.remap)
            oov = vocab.oov_index(mine)
        enc.vocabs[name], enc.oov[name] = mine, oov
    return enc


def transform(df: DataFrame, enc: Encoder) -> DataFrame:
    """Encode all columns. Category joins need no shuffle while a vocabulary is small; of a
    sequence column the distinct values are encoded. Meta values that the encoder has not seen
    are added to its vocabulary first: ids of a holdout's requests or users stay distinct."""
    out = df
    for s in (s for s in enc.specs if s.active):
        if s.name in enc.scalers:
            a, b = enc.scalers[s.name]
            out = out.withColumn(s.name, (F.col(s.name) - F.lit(a)) / F.lit(b))
        elif s.category_processor == "quantile_bucket":
            out = out.withColumn(s.name, quantile_bucket(F.col(s.name), enc.boundaries[s.name]))
        elif s.category_processor == "hash_bucket":
            out = out.withColumn(s.name, hash_bucket(F.col(s.name), s.num_buckets))
        elif s.type in ("categorical", "meta"):
            name = enc.table(s)
            if s.type == "meta":
                enc.vocabs[name] = vocab.extend_vocab(enc.vocabs[name], df, s.name)
                enc.oov[name] = vocab.oov_index(enc.vocabs[name])
            out = vocab.encode_category(out, s.name, enc.vocabs[name], oov=enc.oov[name])
        elif s.type == "sequence":
            if s.sequence_length:
                out = out.withColumn(f"{s.name}_len", text.effective_length(text.tokens(F.col(s.name), s.splitter)))
            out = vocab.encode_sequence(out, s.name, enc.vocabs[enc.table(s)], enc.lengths[s.name], s.splitter,
                                        s.padding, str(s.fill()), oov=enc.oov[enc.table(s)])
    return out


def prepare(splits: dict[str, DataFrame], specs: Sequence[FeatureSpec], label: str, key: str, item: str,
            carry: Sequence[str] = (), min_item_count_eval: int = 0, train_head_count: int = 0,
            positive_holdout: bool = True) -> tuple[dict[str, DataFrame], Encoder]:
    """Filter, fit on train, encode every split in order. Item filters come from train rows alone.

    `min_item_count_eval` drops rows of items that train has fewer rows of, from the holdouts only;
    `train_head_count` keeps items with that many train positives in all splits; holdouts keep
    their positives unless told otherwise. Meta columns grow split by split.
    """
    splits = dict(splits)
    train = splits["train"]
    if train_head_count:
        keep = filters.frequent_items(train, item, train_head_count, label)
        splits = {s: filters.keep_items(d, keep, item) for s, d in splits.items()}
    if min_item_count_eval:
        keep = filters.frequent_items(train, item, min_item_count_eval)
        splits = {s: d if s == "train" else filters.keep_items(d, keep, item) for s, d in splits.items()}
    if positive_holdout:
        splits = {s: d if s == "train" else filters.positives(d, label) for s, d in splits.items()}
    ready = {s: preprocess(d, list(specs), [label], list(dict.fromkeys([key, *carry]))) for s, d in splits.items()}
    enc = fit(ready["train"], specs)
    return {s: transform(d, enc) for s, d in ready.items()}, enc


def write_prepared(tables: dict[str, DataFrame], enc: Encoder, root: str, dataset: str, label: str) -> FeatureMap:
    for s, d in tables.items():
        tabular.write_split(d, f"{root}/{s}.parquet")
    fm = enc.feature_map(dataset, [label])
    spark = next(iter(tables.values())).sparkSession
    fm.save(spark, f"{root}/feature_map.json")
    tagged = None
    for n, v in enc.vocabs.items():
        t = v.withColumn("feature", F.lit(n))
        tagged = t if tagged is None else tagged.unionByName(t)
    if tagged is not None:
        relations.write_vocab(tagged, f"{root}/vocab.parquet")
        relations.write_vocab_json(tagged, f"{root}/vocab.json")
    return fm


# ---------------------------------------------------------------- pools, statistics, compaction

def item_pools(spark: SparkSession, sources: dict[str, str], root: str, item: str, columns: Sequence[str],
               order: Sequence[str] = (), kinds: Sequence[str] = ("train", "evaluation", "full")) -> dict[str, DataFrame]:
    """Pools with fingerprinted tables: changed files or columns rebuild them."""
    want = [item, *columns, *order]
    out = {}
    for kind in kinds:
        paths = [sources[s] for s in pools.POOL_SOURCES[kind]]
        key = relations.fingerprint(spark, paths, want, kind)
        out[kind] = relations.cached_table(
            spark, f"{root}/item_pool_{kind}.parquet", key,
            lambda paths=paths: pools.build_pool([tabular.read_parquet(spark, p, list(dict.fromkeys(want))) for p in paths],
                                                 item, columns, order), [item, *columns])
    return out


def statistics(df: DataFrame, label: str, sides: dict[str, str], split: str = "split", top: int = 10) -> dict[str, DataFrame]:
    """Profiles per split and overall, label distribution, id frequency stats and top ids."""
    freq = stats.id_frequencies(df, sides, [split])
    total = freq.groupBy("side", "id").agg(F.sum("n").alias("n"))
    both = freq.select(split, "side", "id", "n").unionByName(total.select(F.lit("all").alias(split), "side", "id", "n"))
    return {"profile": stats.combined_profile(df, label, list(sides.values()), split),
            "labels": stats.label_distribution(df, label, [split]),
            "sides": stats.side_stats(both, [split, "side"]),
            "top": stats.top_ids(both, top, [split, "side"])}


def compact_dataset(tables: dict[str, DataFrame], columns: Sequence[str], sizes: dict[str, int],
                    share: dict[str, str] | None = None, min_vocab: int = 100, min_reduction: float = 0.3) -> dict:
    """Scan train ids, decide per feature, and remap every table. A declared size that train's ids have outgrown
    is raised to them, so none is cut off."""
    used = remap.used_ids(tables["train"], columns, share)
    largest = {r.feature: r.id for r in used.groupBy("feature").agg(F.max("id").alias("id")).collect()}   # one row per feature
    sizes = {f: max(n, largest.get(f, -1) + 1) for f, n in sizes.items()}
    decisions = remap.pruning_decisions(used, sizes, min_vocab, min_reduction)
    pruned = [r.feature for r in decisions.filter("prune = 1").select("feature").collect()]      # one row per feature
    table = remap.remap_table(used, sizes, pruned)
    share = share or {}
    todo = [c for c in columns if share.get(c, c) in pruned]
    return {"decisions": decisions, "map": table,
            "tables": {s: remap.remap_frame(d, todo, table, share) for s, d in tables.items()}}


# ---------------------------------------------------------------- stages

def observed_candidates(df: DataFrame, request: str, item: str, label: str, order: Sequence[str],
                        max_requests: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates and user rows straight from logged impressions, without a retrieval stage."""
    src = filters.cap_requests(df, request, order[0], max_requests, label=label) if max_requests else df
    c = src.groupBy(F.col(request).alias("request_id"), F.col(item).alias("item_id")).agg(
        F.max(filters.binarize(F.col(label))).alias("label")).withColumn("score", F.lit(0.0))
    users = first_per_key(src.withColumnRenamed(request, "request_id") if request != "request_id" else src,
                          ["request_id"], order)
    return c, users


def rank_stage(candidates: DataFrame, pool: DataFrame, users: DataFrame | None, scorer, item_columns: Sequence[str],
               user_columns: Sequence[str] = (), ks: Sequence[int] = (1, 5, 10), k: int = 10,
               restrict: DataFrame | None = None) -> dict[str, DataFrame]:
    """Join features, score, cut to the top K, and measure each request over its whole list."""
    rows = rank.with_item_features(candidates, pool, item_columns)
    if users is not None and user_columns:
        rows = rank.with_user_features(rows, users, user_columns)
    # a stage hands its scored rows on as a table; ranking, top K and metrics all read it
    scored = stable(rank.score_rows(rows, scorer).select("request_id", "item_id", "label", "score"))
    if restrict is not None:
        scored = rank.flag_members(scored, restrict, "kept")
        per = ranking_metrics.per_request(scored, ks, restrict="kept")
    else:
        per = ranking_metrics.per_request(scored, ks)
    return {"scored": scored, "top": rank.rank_top_k(scored.select("request_id", "item_id", "label", "score"), k), "per_request": per,
            "metrics": ranking_metrics.averages(per, ks)}


def stage_diagnostics(candidates: DataFrame, scored: DataFrame, pool: DataFrame, ks: Sequence[int], k: int,
                      diversity_columns: Sequence[str]) -> dict[str, DataFrame]:
    """What a ranking stage reports besides its lists: one long table of metrics, and the top-1 report.

    `metrics` has the cross-request means, MRR and gAUC within the top k, Diversity@k of the lists and of the
    candidates, the AUC over all rows and over the top-k lists, and the candidates the pool lacks.
    `scored` is the stage's written table; every metric reads it.
    """
    per = ranking_metrics.per_request(scored, ks, top_k=k)
    rows = rank.with_item_features(scored, pool, diversity_columns)
    parts = [
        ranking_metrics.averages(per, ks, top_k=k),
        diversity.list_diversity(rows, diversity_columns, [k]).agg(F.avg(f"diversity_{k}").alias(f"diversity_{k}")),
        diversity.pool_diversity(rows, diversity_columns, ["request_id"]).agg(F.avg("diversity").alias("candidate_diversity")),
        classification.auc(scored).select("auc", "average_precision"),
        classification.global_auc_at_k(scored, k).select(F.col("auc").alias(f"auc_at_{k}")),
        rank.dropped_candidates(candidates, pool),
    ]
    long = None
    for p in parts:
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in p.columns])
        part = p.select(F.explode(cells).alias("m")).select("m.metric", "m.value")
        long = part if long is None else long.unionByName(part)
    return {"metrics": long, "report": rank.top_report(scored, k)}


def rerank_stage(retrieved: DataFrame, preranked: DataFrame, pool: DataFrame, scorer, item_columns: Sequence[str],
                 ks: Sequence[int], k: int, teacher_weight: float = 0.0) -> dict[str, DataFrame]:
    """Score the retrieval list for gAUC and MRR; Recall and nDCG see the pre-ranked set only."""
    src = rank.inject_teacher(retrieved, preranked, weight=teacher_weight or None)
    return rank_stage(src, pool, None, scorer, item_columns, ks=ks, k=k, restrict=preranked)


def three_stages(requests: DataFrame, positives: DataFrame, items: DataFrame, pre_scorer, re_scorer,
                 item_columns: Sequence[str], depth: tuple[int, int, int], ks: Sequence[int],
                 vector: str = "embedding", popularity: DataFrame | None = None) -> dict[str, DataFrame]:
    """Retrieval, pre-ranking and re-ranking; all metrics as one long table.

    The retrieval stage reports its hit rates, and those of a ranking by popularity if one is given.
    """
    got = stable(retrieve.retrieve_candidates(requests, positives, items, depth[0], vector))
    best = rank.rank_top_k(got, max(ks))
    long = relations.metrics_long(ranking_metrics.hit_rate(best, ks, requests).drop("requests"), "retrieval", "valid")
    if popularity is not None:
        pop = retrieve.popularity_recall(got, popularity, ks, requests).drop("requests")
        long = long.unionByName(relations.metrics_long(pop, "retrieval", "valid"))
    pre = rank_stage(got, items, None, pre_scorer, item_columns, ks=ks, k=depth[1])
    re_ = rerank_stage(got, pre["top"].drop("rank"), items, re_scorer, item_columns, ks, depth[2])
    long = long.unionByName(relations.metrics_long(pre["metrics"], "preranking", "valid")).unionByName(
        relations.metrics_long(re_["metrics"], "reranking", "valid"))
    return {"retrieved": got, "preranked": pre["top"], "reranked": re_["top"], "metrics": long}


def convert_logs(logs: dict[str, tuple[DataFrame, DataFrame]], sparse: Sequence[str], dense: Sequence[str],
                 share: dict[str, str] | None = None, max_values: int | None = None, seed: int = 2022, hash_expr=None) -> dict:
    """Nested click logs {'train': (skeleton, bundles), 'test': ...} as encoded tables train, valid and test, and the vocabularies.

    Sparse ids become indices from 1 in value order, those of test that train lacks behind them (fields that `share` one
    vocabulary grow it together); 0 is an absent field, lists stay joined by `^`. Dense fields become numbers, all numbers
    get the narrowest type that holds their column in train, if it holds test too. The test log is halved by a seeded hash.
    """
    share = share or {}
    flat = {n: stable(clicklog.convert(*log, sparse, dense, max_values)) for n, log in logs.items()}
    vocabs = {}
    for name in dict.fromkeys(share.get(f, f) for f in sparse):
        fields = [f for f in sparse if share.get(f, f) == name]
        cells = {n: d.select(F.explode(F.flatten(F.array(*[text.tokens(F.col(f"`{f}`")) for f in fields]))).alias("token")) for n, d in flat.items()}
        seen = cells["train"].withColumn("late", F.lit(0)).unionByName(cells["test"].withColumn("late", F.lit(1)))
        seen = seen.filter(~F.col("token").isin("", clicklog.ABSENT)).groupBy("token").agg(F.min("late").alias("late"))
        vocabs[name] = stable(with_row_number(seen, [], ["late", "token"], "idx").select("token", "idx"))
    out = {}
    for n, d in flat.items():
        for f in sparse:
            d = vocab.recode_lists(d, f, vocabs[share.get(f, f)])
        out[n] = stable(d.withColumns({f"D{f}": F.expr(f"try_cast(`D{f}` AS double)") for f in dense}))
    numbers = ["click", "purchase", *[f"D{f}" for f in dense]]
    both = scaling.narrow_types(out["train"].unionByName(out["test"]), numbers)
    out = {n: d.withColumns({c: F.col(c).cast(both.schema[c].dataType) for c in numbers}) for n, d in out.items()}
    halves = filters.half_split(out["test"], ["sample", *sparse, *numbers], 0.5, seed, hash_expr)
    tables = {"train": out["train"], "valid": halves.filter("split = 'train'").drop("split"), "test": halves.filter("split = 'test'").drop("split")}
    return {"tables": tables, "vocabs": vocabs}


def _plain(value):
    """A number's shortest text, in digits from 0.0001 on; Spark's own cast writes an exponent below 0.001 and from 10 million on."""
    return None if value is None else repr(value)


def leakage_table(report: dict) -> DataFrame:
    """A leakage report as one table (part, name, value): conditioned columns, summary, examples."""
    s, text_of = report["summary"], F.udf(_plain, "string")              # three numbers
    cells = F.array(*[F.struct(F.lit(c).alias("name"), text_of(F.round(F.col(c).cast("double"), 6)).alias("value")) for c in s.columns])
    long = s.select(F.explode(cells).alias("c")).select(F.lit("summary").alias("part"), "c.name", "c.value")
    e = report["examples"].select(F.lit("example").alias("part"), F.concat_ws("|", "request_id", "sequence_column").alias("name"), F.col("positive_item").alias("value"))
    cols = s.sparkSession.createDataFrame([("conditioned", c, None) for c in report["conditioned_columns"]], "part string, name string, value string")
    return cols.unionByName(long).unionByName(e)


def leakage_report(checks: DataFrame, user_columns: Sequence[str], item_columns: Sequence[str], ids: Sequence[str],
                   labels: Sequence[str], groups: FeatureGroups | None = None) -> dict:
    """Conditioned columns by the schema, and the summary and first examples of a leakage check."""
    return {"conditioned_columns": audit.conditioned_columns(user_columns, item_columns, ids, labels, groups),
            "summary": audit.leakage_summary(checks), "examples": audit.leakage_examples(checks)}


def blended_report(df: DataFrame, popularity: DataFrame, weight: float, group: str | None = None) -> DataFrame:
    """Pointwise report of the score and of its popularity blend, side by side."""
    from lumirank.functions.numeric import blend_logit, popularity_prior, popularity_stats, safe_logit, sigmoid
    s = popularity_stats(popularity, "popularity")
    d = rank.attach_popularity(df, popularity)
    d = d.withColumn("blend", sigmoid(blend_logit(safe_logit(F.col("score")), popularity_prior(F.col("popularity"), s), weight)))
    a = classification.pointwise_report(d, "score", "label", group).first().asDict()
    b = classification.pointwise_report(d, "blend", "label", group, prefix="blend_").first().asDict()
    return df.sparkSession.createDataFrame([{**a, **b}])


def infer_feature_map(df: DataFrame, columns: Sequence[str], dataset: str, labels: list[str]) -> FeatureMap:
    """Feature map of an already encoded table, from one scan."""
    rows = stats.infer_encoded_schema(df, columns).collect()                 # one row per column
    fm = FeatureMap(dataset, labels)
    for r in rows:
        d = {"type": normal_type(r["type"]), "source": ""}
        if r.vocab_size is not None:
            d["vocab_size"] = r.vocab_size
        if d["type"] == "sequence":
            d["max_len"] = r.max_len
        fm.features[r.feature] = d
    return fm
