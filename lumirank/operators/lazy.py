"""Every request against every item of a pool, without a row for a pair.

A lazy candidate relation holds requests, pool and positives. Users and items are put into blocks; a visited
(users, block) cell is scored once, in one task, and gives back k rows per request, two counts per positive and
score view, and one sum over its scores of the positives' scores below them (for the AUC). For dot products a block's pivot and radius,
and the interval of its items' priors, bound all its scores: where the bounds settle everything, the block is
counted as a whole and not visited. What leaves the cells is requests x k rows, positives and sums.
Blocks go in groups, which get one copy of a request each (see `retrieve`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumirank.functions.numeric import popularity_prior, popularity_stats
from lumirank.operators import cells as CE, diversity, ranking_metrics
from lumirank.operators.filters import binarize, cap_requests
from lumirank.operators.ordering import first_per_key, top_k, with_global_prefix, with_prefix, with_row_number
from lumirank.operators.ranking_metrics import ITEM, REQ, ideal_dcg
from lumirank.operators.retrieve import CHUNK, ITEM_BLOCK, MAX_BLOCKS, NEIGHBOURS, USER_BLOCK, cell_blocks, cell_parts
from lumirank.operators.scoring import PairScorer, VectorScorer, to_numpy
from lumirank.session import stable

EDGES = 1 << 22               # distinct scores of positives that one pass counts between (held by every task)
LIST, PLACE, SUM = 0, 1, 2    # kinds of rows that leave a cell


# ---------------------------------------------------------------- the relation

@dataclass
class LazyCandidates:
    """Requests with their features, the pool with its features, the positives in the pool; pairs are implied."""
    requests: DataFrame
    pool: DataFrame
    positives: DataFrame
    metadata: dict = field(default_factory=dict)


def all_items_candidates(df: DataFrame, request: str, item: str, label: str, order: Sequence[str], pool: DataFrame,
                         user_columns: Sequence[str] = (), positive_requests_only: bool = True, max_requests: int | None = None,
                         max_candidate_rows: int | None = None) -> LazyCandidates:
    """Candidates of the requests of a log when no retrieval stage has run: every item of the pool.

    A request's features are those of its first row in `order`. By default only requests with a positive stay
    (also one whose item the pool lacks; such positives are counted and left out). `max_requests` and
    `max_candidate_rows` keep the first requests by their first row, at least one.
    """
    items = pool.filter(F.col(ITEM).isNotNull()).dropDuplicates([ITEM])
    n_items = items.count()
    src = df.withColumn("__y", binarize(F.col(label)))
    if positive_requests_only:
        src = src.join(src.filter("__y > 0").select(request).distinct(), request, "left_semi")
    if max_requests or max_candidate_rows:
        src = cap_requests(src, request, order[0], max_requests or 2**62, n_items, max_candidate_rows)
    named = src.withColumnRenamed(request, REQ) if request != REQ else src
    users = stable(first_per_key(named.select(REQ, *dict.fromkeys([*user_columns, *[o for o in order if o != REQ]])), [REQ], order)
                   .select(REQ, *user_columns))
    marked = named.filter("__y > 0").select(REQ, F.col(item).cast(items.schema[ITEM].dataType).alias(ITEM)).distinct()
    there = marked.join(items.select(ITEM, F.lit(1).alias("__in")), ITEM, "left")
    positives = stable(there.filter("__in = 1").select(REQ, ITEM))
    n, p, all_ = users.count(), positives.count(), marked.count()
    return LazyCandidates(users, items, positives, {
        "strategy": "all_items", "requests": n, "items": n_items, "estimated_candidates": n * n_items,
        "positives": p, "ignored_positives": all_ - p, "positive_requests_only": positive_requests_only})


def with_priors(lazy: LazyCandidates, popularity: DataFrame, transform: str = "log1p", normalize: str = "zscore") -> LazyCandidates:
    """Pool items get `popularity` (0 where unknown) and its normalised `prior`, by the statistics of the pool."""
    pop = popularity.groupBy(ITEM).agg(F.max("popularity").alias("popularity"))
    pool = lazy.pool.drop("popularity").join(pop, ITEM, "left").withColumn("popularity", F.coalesce("popularity", F.lit(0)))
    s = popularity_stats(pool, "popularity", transform)
    pool = stable(pool.withColumn("prior", popularity_prior(F.col("popularity"), s, transform, normalize).cast("double")))
    return LazyCandidates(lazy.requests, pool, lazy.positives, lazy.metadata)


# ---------------------------------------------------------------- blocks and their bounds

@dataclass
class _Index:
    count: np.ndarray         # items per block
    pivots: np.ndarray | None = None
    radius: np.ndarray | None = None
    prior: np.ndarray | None = None        # least and greatest prior per block

    def __post_init__(self):
        self.group, self.bit = CE.groups(self.count, ITEM_BLOCK)
        self.first = np.flatnonzero(self.bit == 0)           # of each group

    def bounds(self, scorer: VectorScorer, u: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each block can hold for each user, with room for rounding."""
        mid = u @ self.pivots.T
        reach = np.linalg.norm(u, axis=1, keepdims=True) * self.radius
        slack = 2.0 * 10.0 ** -scorer.decimals + 1e-9 * (np.abs(mid) + reach)
        low, high = np.sort(weight * self.prior, axis=0)
        return (mid - reach) / scorer.temperature - slack + low, (mid + reach) / scorer.temperature + slack + high


def _index(pool: DataFrame, scorer) -> tuple[DataFrame, _Index]:
    """Items (item_id, the scorer's item columns, __prior, __p), written once, and their blocks."""
    n = pool.count()
    prior = (F.col("prior") if "prior" in pool.columns else F.lit(0.0)).cast("double").alias("__prior")
    if not isinstance(scorer, VectorScorer):
        blocks = max(1, math.ceil(n / ITEM_BLOCK))
        placed = stable(pool.select(ITEM, *scorer.item_columns, prior, F.pmod(F.xxhash64(ITEM), F.lit(blocks)).cast("int").alias("__p")))
        count = np.zeros(blocks, np.int64)
        for r in placed.groupBy("__p").count().collect():                    # one row per block
            count[r["__p"]] = r["count"]
        return placed, _Index(count)
    src = pool.select(ITEM, F.col(scorer.item_vector).cast("array<double>").alias("__v"), prior)
    blocks = max(1, math.ceil(n / max(NEIGHBOURS, math.ceil(n / MAX_BLOCKS))))
    chosen = src.orderBy(F.xxhash64(ITEM), ITEM).limit(blocks).select("__v").collect()        # a bounded number of pivots
    pivots = scorer.ready(np.array([r["__v"] for r in chosen], np.float64)) if chosen else np.zeros((1, 1))
    schema = T.StructType([*src.schema.fields, T.StructField("__p", T.IntegerType()), T.StructField("__r", T.DoubleType())])

    def assign(batches):
        half = (pivots ** 2).sum(axis=1) / 2
        for batch in batches:
            if batch.num_rows:
                x = scorer.ready(to_numpy(batch.column(1)))
                p = np.concatenate([(x[i:i + 1024] @ pivots.T - half).argmax(axis=1) for i in range(0, len(x), 1024)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.int32()), pa.array(np.linalg.norm(x - pivots[p], axis=1))],
                                                 schema=to_arrow_schema(schema))

    placed = stable(src.mapInArrow(assign, schema))
    count, radius, priors = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros((2, len(pivots)))
    for r in placed.groupBy("__p").agg(F.count("*").alias("n"), F.max("__r").alias("r"), F.min("__prior").alias("a"), F.max("__prior").alias("b")).collect():
        count[r["__p"]], radius[r["__p"]], priors[:, r["__p"]] = r["n"], r["r"], (r["a"], r["b"])      # one row per block
    return placed.drop("__r"), _Index(count, pivots, radius, priors)


# ---------------------------------------------------------------- cells

def _left(lazy: LazyCandidates, scorer, weights: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Left rows (request, features, __lead, __pi, __ps) and the positives with their score in every view."""
    if isinstance(scorer, VectorScorer):
        users = lazy.requests.select(REQ, F.col(scorer.user_vector).cast("array<double>").alias("__u"))
        items = lazy.pool.select(ITEM, F.col(scorer.item_vector).cast("array<double>").alias("__v"), *(["prior"] if "prior" in lazy.pool.columns else []))
    else:
        users = lazy.requests.select(REQ, *scorer.user_columns)
        items = lazy.pool.select(ITEM, *scorer.item_columns, *(["prior"] if "prior" in lazy.pool.columns else []))
    prior = (F.col("prior") if "prior" in items.columns else F.lit(0.0)).cast("double")
    pairs = lazy.positives.select(REQ, ITEM).distinct().join(items, ITEM).join(users, REQ)
    ucols, icols = scorer.user_columns, scorer.item_columns
    pairs = pairs.select(REQ, ITEM, prior.alias("__prior"), *ucols, *icols)
    schema = T.StructType([pairs.schema[REQ], pairs.schema[ITEM], T.StructField("__s", T.ArrayType(T.DoubleType()))])

    def own(batches):
        for batch in batches:
            cols = {c: to_numpy(batch.column(3 + j)) for j, c in enumerate([*ucols, *icols])}
            base = scorer.rows({c: cols[c] for c in ucols}, {c: cols[c] for c in icols}, batch.num_rows)
            prior = to_numpy(batch.column(2))
            views = np.stack([np.round(base + w * prior, scorer.decimals) for w in weights], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(views.ravel()), len(weights)).cast(pa.list_(pa.float64()))],
                                             schema=to_arrow_schema(schema))

    scored = stable(pairs.mapInArrow(own, schema))
    many = scored.groupBy(REQ).count().select(REQ, F.ceil(F.col("count") / CHUNK).alias("__n"))
    chunk = F.pmod(F.xxhash64(ITEM, F.lit(5)), F.col("__n"))
    packed = (scored.join(many, REQ).groupBy(REQ, chunk.alias("__c"))
              .agg(F.collect_list(F.struct(F.col(ITEM).alias("i"), F.col("__s").alias("s"))).alias("p")))
    lead = users.join(packed.filter("__c = 0"), REQ, "left").withColumn("__lead", F.lit(True))
    more = users.join(packed.filter("__c > 0"), REQ).withColumn("__lead", F.lit(False))
    rows = lead.unionByName(more)
    return stable(rows.select(REQ, *ucols, "__lead", F.coalesce(F.col("p.i"), F.array().cast(T.ArrayType(scored.schema[ITEM].dataType))).alias("__pi"),
                              F.coalesce(F.flatten(F.col("p.s")), F.array().cast("array<double>")).alias("__ps"))), scored


class _Rows:
    """A batch of left rows as arrays: features, and the positives of all rows one after the other."""

    def __init__(self, batch, scorer, views: int):
        def col(c):
            x = batch.column(c)
            return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        self.n = batch.num_rows
        self.request = col(REQ)
        self.features = {c: to_numpy(col(c)) for c in scorer.user_columns}
        self.lead = to_numpy(col("__lead")).astype(bool)
        lists = col("__pi")
        self.item = lists.flatten()
        self.per = np.diff(lists.offsets.to_numpy()) if self.n else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(self.n), self.per)
        self.own = to_numpy(col("__ps").flatten()).astype(np.float64).reshape(-1, views)


class _Job:
    """What is wanted of the cells, and how a batch of left rows decides which blocks it must visit."""

    def __init__(self, index: _Index, scorer, weights, k: int, lists: bool, places: bool, edges: tuple[np.ndarray, np.ndarray] | None):
        self.index, self.scorer, self.weights, self.k = index, scorer, list(weights), k
        self.lists, self.places = lists, places
        self.edges, self.edge_weight = edges or (None, None)

    def settled(self, rows: _Rows, least: np.ndarray, seen: np.ndarray | None):
        """Per view the bounds, and the (row, block) cells whose scores must be computed."""
        n_blocks = len(self.index.count)
        need = np.zeros((rows.n, n_blocks), bool)
        u = self.scorer.ready(rows.features["__u"])
        bounds = [self.index.bounds(self.scorer, u, w) for w in self.weights]
        low, high = bounds[0]
        if self.lists:
            need |= rows.lead[:, None] & (high >= least[:, None])
        if self.places:
            for v, (a, b) in enumerate(bounds):
                doubt = (b[rows.row] >= rows.own[:, v, None]) & (a[rows.row] <= rows.own[:, v, None])
                np.logical_or.at(need, rows.row, doubt)
        if self.edges is not None:
            inside = np.searchsorted(self.edges, high, side="right") > np.searchsorted(self.edges, low, side="left")
            need |= rows.lead[:, None] & inside
        need &= self.index.count > 0
        if seen is not None:
            need &= np.arange(n_blocks) != seen[:, None]
        return need, bounds


def _schema(req: T.DataType, item: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("kind", T.IntegerType()), T.StructField(REQ, req), T.StructField(ITEM, item), T.StructField("view", T.IntegerType()),
                         T.StructField("score", T.DoubleType()), T.StructField("higher", T.LongType()), T.StructField("tied", T.LongType())])


def _table(schema, kind, request, item, view=None, score=None, higher=None, tied=None) -> pa.Table:
    arrow, n = to_arrow_schema(schema), len(higher if higher is not None else score)

    def col(x, t):
        return pa.nulls(n, t) if x is None else x.cast(t) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t)

    given = [np.full(n, kind, np.int32), request, item, view, score, higher, tied]
    return pa.table([col(x, t) for x, t in zip(given, arrow.types)], schema=arrow)


def _cell(job: _Job, schema: T.StructType):
    scorer, weights = job.scorer, job.weights

    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        empty = to_arrow_schema(schema).empty_table()
        if not lt.num_rows or not rt.num_rows:
            return empty
        rt = rt.sort_by([("__b", "ascending"), (ITEM, "ascending")])
        rows, ids = _Rows(lt, scorer, len(weights)), rt.column(ITEM).combine_chunks()
        feats = {c: to_numpy(rt.column(c)) for c in scorer.item_columns}
        prior, n = to_numpy(rt.column("__prior")).astype(np.float64), rt.num_rows
        blocks, need = cell_blocks(rt.column("__b").to_numpy(), job.index.bit, lt.column("__need").to_numpy())
        order = np.empty(n, np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(n)
        least = to_numpy(lt.column("__least")).astype(np.float64) if "__least" in lt.column_names else None
        bound = math.inf
        if isinstance(scorer, VectorScorer):
            score = CE.Dots(scorer.ready(rows.features["__u"]), scorer.ready(feats["__v"]), scorer.temperature, scorer.decimals, single=job.edges is None)
            bound = float(score.norm.max()) * score.reach + abs(weights[0]) * float(np.abs(prior).max())
        else:
            def tile(r, a, b):
                s = scorer.matrix({c: x[r] for c, x in rows.features.items()}, {c: x[a:b] for c, x in feats.items()}, len(r), b - a)
                return np.where(np.isnan(s), -np.inf, s)                     # ranks nowhere

            score = CE.Matrix(tile, rows.n, scorer.decimals)
        tally = None if job.edges is None else CE.Tally(job.edges, job.edge_weight, scorer.decimals, bound, rows.n * n)
        where = pc.index_in(rows.item, value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False)
        per, own = (rows.per, rows.own) if job.places else (None, None)
        (r, c, s), higher, tied, _ = CE.Scan(score, blocks, need, order, prior, weights).run(
            job.k if job.lists else 0, rows.lead, None if least is None else np.where(np.isnan(least), -np.inf, least), per, own, where, None, tally)
        out = []
        if len(r):
            out.append(_table(schema, LIST, rows.request.take(pa.array(r)), ids.take(pa.array(c)), score=np.where(np.isneginf(s), np.nan, s)))
        if job.places and len(rows.row):
            for v in range(len(weights)):
                out.append(_table(schema, PLACE, rows.request.take(pa.array(rows.row)), rows.item, np.full(len(rows.row), v, np.int32), None, higher[:, v], tied[:, v]))
        if tally is not None:
            out.append(_table(schema, SUM, None, None, higher=np.array([tally.flush()])))
        return pa.concat_tables(out) if out else empty

    return run


def _run_cells(left: DataFrame, items: DataFrame, job: _Job, schema: T.StructType, visits: list[int]) -> DataFrame:
    """Left rows that know their group (__p) and its blocks (__need) meet the items, in cells of bounded size."""
    index, spark = job.index, left.sparkSession
    per = [(r["__p"], r["n"], r["b"]) for r in left.groupBy("__p").agg(F.count("*").alias("n"), F.sum(F.bit_count("__need")).alias("b")).collect()]   # one row per group
    visits.append(sum(b for *_, b in per))
    parts, of_block = cell_parts([(p, n) for p, n, _ in per], index.group, index.count, USER_BLOCK, ITEM_BLOCK, spark.sparkContext.defaultParallelism)
    parts = F.broadcast(spark.createDataFrame(parts, "__p int, ns int, ni int"))
    of_block = F.broadcast(spark.createDataFrame(of_block, "__b int, __p int, ns int, ni int"))      # at most MAX_BLOCKS rows
    l = (left.join(parts, "__p").withColumn("__s", F.pmod(F.xxhash64(REQ), F.col("ns")).cast("int"))
         .withColumn("__i", F.explode(F.expr("sequence(0, ni - 1)"))).drop("ns", "ni"))
    r = (items.withColumnRenamed("__p", "__b").join(of_block, "__b").withColumn("__i", F.pmod(F.xxhash64(ITEM, F.lit(9)), F.col("ni")).cast("int"))
         .withColumn("__s", F.explode(F.expr("sequence(0, ns - 1)"))).drop("ns", "ni"))
    cell = ["__p", "__s", "__i"]
    return l.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInArrow(_cell(job, schema), schema)


def _route(left: DataFrame, index: _Index, choose) -> DataFrame:
    """One copy of a row for each group with blocks that `choose(batch)` marks, with these as bits."""
    schema = T.StructType([*left.schema.fields, T.StructField("__p", T.IntegerType()), T.StructField("__need", T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, group, bits = CE.group_needs(choose(part), index.group, index.bit)
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(group, pa.int32()), pa.array(bits, pa.int64())], schema=to_arrow_schema(schema))

    return stable(left.mapInArrow(run, schema))


def _visit(left: DataFrame, items: DataFrame, job: _Job, schema: T.StructType, visits: list[int]) -> DataFrame:
    """All rows that leave the cells, and those of blocks that are counted as a whole."""
    index, scorer = job.index, job.scorer
    if not isinstance(scorer, VectorScorer):
        _, group, bits = CE.group_needs(index.count[None] > 0, index.group, index.bit)
        all_ = F.array(*[F.struct(F.lit(int(g)).alias("g"), F.lit(int(b)).cast("long").alias("b")) for g, b in zip(group, bits)])
        every = left.withColumn("__x", F.explode(all_)).select(*left.columns, F.col("__x.g").alias("__p"), F.col("__x.b").alias("__need"))
        return _run_cells(every, items, job, schema, visits)

    def nearest(batch):
        upper = scorer.ready(to_numpy(batch.column(1))) @ index.pivots.T
        best = np.where(index.count > 0, upper, -np.inf).argmax(axis=1)
        return np.arange(len(index.count)) == best[:, None]

    first = _route(left, index, nearest)
    near = stable(_run_cells(first, items, job, schema, visits))
    reach = near.filter(F.col("kind") == LIST).groupBy(REQ).agg(F.when(F.count("*") >= job.k, F.min("score")).alias("__least"))
    open_ = stable(first.withColumnRenamed("__p", "__g").withColumnRenamed("__need", "__bit").join(reach, REQ, "left").select(*left.columns, "__g", "__bit", "__least"))
    views = len(job.weights)

    def state(batch):
        rows = _Rows(batch, scorer, views)
        group, bit, least = (to_numpy(batch.column(batch.num_columns - 3 + j)) for j in range(3))
        least, seen = least.astype(np.float64), index.first[group] + np.round(np.log2(bit.astype(np.float64))).astype(np.int64)
        return rows, job.settled(rows, np.where(np.isnan(least), -np.inf, least), seen), seen

    def others(batch):
        return state(batch)[1][0]

    def whole(batches):
        # blocks that need no visit: they lie above or below each positive, and between two edges, as a whole
        total, below = 0, None if job.edges is None else np.r_[0, np.cumsum(job.edge_weight)]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows, (need, bounds), seen = state(batch.slice(at, 512))
                free = ~need & (np.arange(len(index.count)) != seen[:, None])
                if job.places and len(rows.row):
                    for v, (low, _) in enumerate(bounds):
                        above = ((low[rows.row] > rows.own[:, v, None]) & free[rows.row]) @ index.count
                        t = _table(schema, PLACE, rows.request.take(pa.array(rows.row)), rows.item, np.full(len(rows.row), v, np.int32), None, above, np.zeros(len(above), np.int64))
                        yield from t.to_batches()
                if below is not None:
                    r, b = np.nonzero(free & rows.lead[:, None] & (index.count > 0))
                    total += 2 * int((below[np.searchsorted(job.edges, bounds[0][0][r, b])] * index.count[b]).sum())
        if below is not None:
            yield from _table(schema, SUM, None, None, higher=np.array([total])).to_batches()

    rest = _run_cells(_route(open_, index, others).drop("__g", "__bit"), items, job, schema, visits)
    return near.unionByName(rest).unionByName(open_.mapInArrow(whole, schema))


@dataclass
class Ranked:
    """What is known of all pairs: the best k items per request, each positive's place per view, the global AUC."""
    top: DataFrame            # request_id, item_id, score, rank; ties by item id
    places: DataFrame         # request_id, item_id, view, score, higher, tied (other items, by score)
    auc: float | None
    visits: list[int]         # (request row, block) cells that were scored, pass by pass


def rank_all(lazy: LazyCandidates, scorer: VectorScorer | PairScorer, k: int, weights: Sequence[float] = (0.0,),
             global_auc: bool = False) -> Ranked:
    """Rank every item of the pool for every request.

    `weights` name score views: score + weight x prior; lists and AUC are those of the first. Requests and
    items must be unique; a null score (NaN) of a model ranks nowhere and is refused.
    """
    weights = [float(w) for w in weights]
    if any(weights) and "prior" not in lazy.pool.columns:
        raise ValueError("the pool has no prior: see with_priors")
    kinds = lazy.requests.schema[REQ].dataType, lazy.pool.schema[ITEM].dataType
    schema, spark, visits = _schema(*kinds), lazy.requests.sparkSession, []
    items, index = _index(lazy.pool, scorer)
    left, scored = _left(lazy, scorer, weights)
    none = spark.createDataFrame([], schema)
    if not index.count.sum() or left.isEmpty():
        top = top_k(none.select(REQ, ITEM, "score"), [REQ], [F.desc("score"), F.asc(ITEM)], k)
        return Ranked(top, none.select(REQ, ITEM, "view", "score", "higher", "tied"), None, visits)
    cuts = _edge_blocks(scored) if global_auc else []
    k = min(k, int(index.count.sum()))
    job = _Job(index, scorer, weights, k, True, True, cuts[0] if cuts else None)
    found = stable(_visit(left, items, job, schema, visits))
    top = top_k(found.filter(F.col("kind") == LIST).select(REQ, ITEM, "score"), [REQ], [F.desc("score"), F.asc(ITEM)], k)
    own = scored.select(REQ, ITEM, F.posexplode("__s").alias("view", "score"))
    places = (found.filter(F.col("kind") == PLACE).groupBy(REQ, ITEM, "view").agg(F.sum("higher").alias("higher"), F.sum("tied").alias("tied"))
              .join(own, [REQ, ITEM, "view"]).select(REQ, ITEM, "view", "score", "higher", "tied"))
    auc = None
    if global_auc and cuts:
        total = left.filter("__lead").count() * int(index.count.sum())
        auc = _global_auc(found, scored, cuts, left, items, schema, visits, job, total)
    return Ranked(top, places, auc, visits)


def top_lists(lazy: LazyCandidates, scorer: VectorScorer | PairScorer, k: int) -> DataFrame:
    """The lists of `rank_all` alone (request_id, item_id, score, label, rank), without places and metrics.

    Requests with equal features have equal lists, so each such class visits the cells once, as its first request.
    What a model costs then grows with classes x items, however many requests there are.
    """
    users, own = lazy.requests, [scorer.user_vector] if isinstance(scorer, VectorScorer) else scorer.user_columns
    classes = stable(users.groupBy(*own).agg(F.min(REQ).alias("__first")))
    one = LazyCandidates(classes.withColumnRenamed("__first", REQ), lazy.pool, lazy.positives.limit(0), lazy.metadata)
    lists = stable(rank_all(one, scorer, k).top.withColumnRenamed(REQ, "__first"))
    key = classes.select("__first", *[F.col(c).alias(f"__k_{j}") for j, c in enumerate(own)])
    same = [F.col(c).eqNullSafe(F.col(f"__k_{j}")) for j, c in enumerate(own)]
    top = users.join(key, same).select(REQ, "__first").join(lists, "__first")
    hits = lazy.positives.select(REQ, ITEM).distinct().withColumn("label", F.lit(1))
    return top.join(hits, [REQ, ITEM], "left").select(REQ, ITEM, "score", F.coalesce("label", F.lit(0)).alias("label"), "rank")


def _edge_blocks(scored: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct scores of the positives in ascending blocks of at most EDGES, and how many have each; the driver holds two numbers each."""
    distinct = scored.groupBy(F.col("__s")[0].alias("s")).agg(F.count("*").alias("n"))
    n = distinct.count()
    if n <= EDGES:
        blocks = [distinct.toArrow()] if n else []
    else:
        numbered = stable(with_row_number(distinct, [], ["s"], "__n"))
        blocks = [numbered.filter((F.col("__n") > at) & (F.col("__n") <= at + EDGES)).select("s", "n").toArrow() for at in range(0, n, EDGES)]
    return [tuple(b.sort_by("s").column(c).to_numpy() for c in ("s", "n")) for b in blocks]


def _global_auc(found, scored, cuts, left, items, schema, visits, job, total) -> float | None:
    """AUC over all pairs from the sum, over all scores, of the positives' scores below (ties: half), one block of edges a pass."""
    n_pos, lost = scored.count(), 0
    if not n_pos or total == n_pos:
        return None
    for i, (edges, p) in enumerate(cuts):
        if i:
            found = _visit(left, items, _Job(job.index, job.scorer, job.weights, job.k, False, False, cuts[i]), schema, visits)
        pairs = found.filter(F.col("kind") == SUM).agg(F.sum(F.col("higher").cast("decimal(20,0)"))).first()[0] or 0
        above_pos = scored.filter(F.col("__s")[0] > float(edges[-1])).count()
        higher_pos = above_pos + np.r_[p[::-1].cumsum()[::-1][1:], 0]
        lost += int(pairs) - int((p * (2 * higher_pos + p)).sum())            # twice what is lost
    return 1.0 - lost / (2 * n_pos * (total - n_pos))


# ---------------------------------------------------------------- metrics

def place_metrics(requests: DataFrame, places: DataFrame, pool_n: int, ks: Sequence[int], top: int | None = None,
                  rank: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """Per request n, n_pos, mrr, gauc, recall_k, ndcg_k (and mrr, gauc within `top`) from the positives' places.

    Among equal scores positives come last; with `rank`, a column that holds the positive's rank in a given
    order, that order holds. gAUC counts equal scores one half either way.
    """
    same = places.groupBy(REQ, "score").agg(F.count("*").alias("peers"))
    g = with_prefix(same, [REQ], [F.col("score").desc()], {"pos_higher": F.col("peers")}, hot_rows)
    p = with_prefix(places, [REQ], [F.col("score").desc(), F.col(ITEM).asc()], {"pos_before": F.lit(1).cast("long")}, hot_rows).join(g, [REQ, "score"])
    neg_higher, neg_tied = F.col("higher") - F.col("pos_higher"), F.col("tied") - (F.col("peers") - 1)
    p = (p.withColumn("lost", neg_higher + 0.5 * neg_tied).withColumn("__nh", neg_higher)
         .withColumn("__rank", F.col(rank) if rank else neg_higher + neg_tied + F.col("pos_before") + 1))
    aggs = [F.count("*").alias("n_pos"), F.min("__rank").alias("first"), F.sum("lost").alias("lost")]
    aggs += [F.count_if(F.col("__rank") <= k).alias(f"h_{k}") for k in ks]
    aggs += [F.sum(F.when(F.col("__rank") <= k, 1.0 / F.log2(F.col("__rank") + 1.0)).otherwise(0.0)).alias(f"d_{k}") for k in ks]
    if top:
        inside = F.col("__rank") <= top
        tied_in = neg_tied                                  # positives come last, so the tied rows ahead of one are inside
        if rank:
            # of a tie cut by the last rank, only the rows inside count
            peers = p.groupBy(REQ, "score").agg(F.count_if(inside).alias("__peers_in"))
            p = p.join(peers, [REQ, "score"])
            tied_in = F.least(F.lit(top), F.col("higher") + F.col("tied") + 1) - F.col("higher") - F.col("__peers_in")
        p = p.withColumn("__lost_in", F.when(inside, F.col("__nh") + 0.5 * tied_in))
        aggs += [F.count_if(F.col("__rank") <= top).alias("pos_in_top"), F.sum("__lost_in").alias("lost_in")]
    base = requests.select(REQ).join(p.groupBy(REQ).agg(*aggs), REQ, "left")
    np_, n_in = F.coalesce("n_pos", F.lit(0)), F.lit(min(top or 0, pool_n))
    neg = F.lit(pool_n) - np_
    cols = [REQ, F.lit(pool_n).cast("long").alias("n"), np_.alias("n_pos"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
            _auc_of(np_, neg, F.col("lost")).alias("gauc")]
    for k in ks:
        cols += [F.coalesce(F.col(f"h_{k}") / F.col("n_pos"), F.lit(0.0)).alias(f"recall_{k}"),
                 F.when(np_ > 0, F.col(f"d_{k}") / ideal_dcg(np_, k)).otherwise(0.0).alias(f"ndcg_{k}")]
    if top:
        hit = F.coalesce("pos_in_top", F.lit(0))
        cols += [F.when(hit > 0, 1.0 / F.col("first")).alias(f"mrr_at_{top}"),
                 F.when(hit > 0, _auc_of(hit, n_in - hit, F.col("lost_in"))).alias(f"gauc_at_{top}"), hit.alias("pos_in_top")]
    return base.select(*cols)


def _auc_of(p: Column, n: Column, lost: Column) -> Column:
    return F.when((p > 0) & (n > 0), (p * n - lost) / (p * n)).otherwise(0.0)


def popularity_places(pool: DataFrame, positives: DataFrame) -> DataFrame:
    """Where each positive stands when the pool is ordered by popularity, ties by item id: one order for all requests."""
    sums, _ = with_global_prefix(pool.groupBy("popularity").agg(F.count("*").alias("same")), [F.desc("popularity")], {"higher": F.col("same")})
    order = with_row_number(pool.select(ITEM, "popularity"), [], [F.desc("popularity"), F.asc(ITEM)], "place")
    one = order.join(sums, "popularity").select(ITEM, F.col("popularity").cast("double").alias("score"), "higher", (F.col("same") - 1).alias("tied"), "place")
    return positives.select(REQ, ITEM).distinct().join(one, ITEM)


def lazy_report(lazy: LazyCandidates, scorer: VectorScorer | PairScorer, ks: Sequence[int], k: int, popularity_weight: float = 0.0,
                bias_weight: float = 0.0, diversity_columns: Sequence[str] = (), global_auc: bool = False,
                pool_diversity: bool = False) -> dict:
    """Lists and all metrics of an all-items stage: {'top', 'metrics', 'ranked'}.

    `top` has the best k items of every request with their labels. `metrics` is one long table (metric, value):
    MRR, gAUC, Recall, nDCG, MRR and gAUC within k, Diversity of the lists, each a mean over the requests with
    a positive (within k: over those whose first k hold one); the same metrics for the order by popularity
    (`popularity_`) if the pool has it, and for score + popularity_weight x prior (`popularity_blend_`) if the
    weight isn't 0; with `global_auc` the AUC over all pairs and over the lists that hold a positive.
    `bias_weight` x prior is part of the score itself.
    """
    weights = [bias_weight] + ([bias_weight + popularity_weight] if popularity_weight else [])
    ranked = rank_all(lazy, scorer, k, weights, global_auc)
    pool_n = lazy.pool.count()
    k = min(k, pool_n) if pool_n else k
    hits = lazy.positives.select(REQ, ITEM).distinct().withColumn("label", F.lit(1))
    top = stable(ranked.top.join(hits, [REQ, ITEM], "left").withColumn("label", F.coalesce("label", F.lit(0))).select(REQ, ITEM, "score", "label", "rank"))
    places = stable(ranked.places)
    long = None

    def add(frame: DataFrame, prefix: str = ""):
        nonlocal long
        cells = F.array(*[F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in frame.columns])
        part = frame.select(F.explode(cells).alias("m")).select("m.metric", "m.value")
        long = part if long is None else long.unionByName(part)

    per = place_metrics(lazy.requests, places.filter("view = 0"), pool_n, ks, k)
    deep = [x for x in ks if x > 1 and x <= k]
    if diversity_columns and deep:
        lists = top.join(lazy.pool.select(ITEM, *diversity_columns), ITEM)
        # within a list the rank holds, also among equal scores
        div = diversity.list_diversity(lists.drop("score").withColumn("score", -F.col("rank")), diversity_columns, deep)
        per = per.join(div, REQ, "left")
    extra = [f"diversity_{x}" for x in deep] if diversity_columns else []
    add(ranking_metrics.averages(per.fillna(0.0, subset=extra) if extra else per, ks, "with_positive", k, extra))
    if "popularity" in lazy.pool.columns:
        pop = place_metrics(lazy.requests, popularity_places(lazy.pool, lazy.positives), pool_n, ks, k, rank="place")
        add(ranking_metrics.averages(pop, ks, "with_positive", k).drop("requests", "requests_with_positive"), "popularity_")
    if popularity_weight:
        blend = place_metrics(lazy.requests, places.filter("view = 1"), pool_n, ks, k)
        add(ranking_metrics.averages(blend, ks, "with_positive", k).drop("requests", "requests_with_positive"), "popularity_blend_")
    if global_auc:
        from lumirank.operators.classification import global_auc_at_k
        add(lazy.requests.sparkSession.createDataFrame([(ranked.auc,)], "auc double"))
        add(global_auc_at_k(top, k).select(F.col("auc").alias(f"auc_at_{k}")))
    if pool_diversity and diversity_columns:
        add(diversity.pool_diversity(lazy.pool, diversity_columns).select(F.col("diversity").alias("pool_diversity")))
    return {"top": top, "metrics": long, "ranked": ranked}
