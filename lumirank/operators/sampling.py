"""Negative sampling by hashed draws.

A draw is a hash of (seed, row, draw number), so a task that runs twice draws the same.
Draws meet the pool by an equi-join on a dense index: nothing is gathered or sent whole.
`hash_of(row, draw)` may be replaced to get draws another engine can repeat.
"""

from __future__ import annotations

import math

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumirank.functions.numeric import hash_uniform
from lumirank.operators.ordering import with_global_prefix, with_row_number
from lumirank.operators.ranking_metrics import ITEM, REQ
from lumirank.operators.scoring import to_numpy
from lumirank.session import stable

HashOf = Callable[[Column, Column], Column]
WEIGHT_SCALE = 1_000_000        # weights are fixed-point, so sums do not depend on row order

DISTANCE_BLOCK = 16_384       # vectors on a side of a cell of pairwise distances


def seeded(seed: int) -> HashOf:
    return lambda row, j: F.xxhash64(F.lit(seed), row, j)


def index_pool(pool: DataFrame, item: str = ITEM) -> tuple[DataFrame, int]:
    """(__idx 0..n-1, item) in item order, and n."""
    ids = pool.select(F.col(item).alias("neg_item")).distinct()
    out, tot = with_global_prefix(ids, ["neg_item"], {"__idx": F.lit(1).cast("long")})
    return out, tot["__idx"]


def _draws(row: Column, count: int, place: Callable[[Column], Column], own: Callable[[Column], Column], n: int) -> Column:
    """First n of `count` drawn places that are not the row's own: an array, so no shuffle picks them.
    Too few valid draws are filled up with the first of them."""
    places = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), place)
    kept = F.slice(F.filter(places, lambda x: ~F.coalesce(own(x), F.lit(False))), 1, n)
    return F.when(F.size(kept) > 0, F.concat(kept, F.array_repeat(F.get(kept, F.lit(0)), F.lit(n) - F.size(kept))))


def _exploded(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode("__places").alias("__no", "__at")).withColumn("neg_no", F.col("__no") + 1).drop("__no")


def uniform(rows: DataFrame, pool: DataFrame, n: int, row: str, positive: str = ITEM, item: str = ITEM,
            hash_of: HashOf | None = None) -> DataFrame:
    """n negatives per row: 2n draws, own positive dropped, first n kept. Rows whose draws all
    collide get none instead of their own positive.

    The positive's own index is looked up first, so collisions are seen before items are joined.
    """
    hash_of = hash_of or seeded(0)
    idx, size = index_pool(pool, item)
    mine = idx.select(F.col("neg_item").alias(positive), F.col("__idx").alias("__own"))
    d = rows.select(row, positive).join(mine, positive, "left")
    d = d.withColumn("__places", _draws(F.col(row), 2 * n, lambda j: F.pmod(hash_of(F.col(row), j), F.lit(size)),
                                        lambda x: x == F.col("__own"), n))
    d = _exploded(d, [row, positive]).withColumnRenamed("__at", "__idx")
    return d.join(idx, "__idx").select(row, positive, "neg_no", "neg_item")


def weighted(rows: DataFrame, pool: DataFrame, popularity: DataFrame, n: int, row: str, positive: str = ITEM,
             alpha: float = 0.75, hash_of: HashOf | None = None) -> DataFrame:
    """Draws with probability ~ count^alpha (items without a count weigh 1).

    Each item owns an interval of the summed weights. Intervals are cut at as many equal
    cells as there are items, so each draw meets only the few intervals of its cell and an
    item that owns a third of the mass is spread over a third of the cells.
    """
    hash_of = hash_of or seeded(0)
    w = (pool.select(ITEM).distinct().join(popularity, ITEM, "left")
         .select(F.col(ITEM).alias("neg_item"),
                 F.floor(F.pow(F.coalesce(F.col("popularity"), F.lit(1)).cast("double"), F.lit(float(alpha)))
                         * WEIGHT_SCALE).cast("long").alias("__w")))
    placed, tot = with_global_prefix(w, ["neg_item"], {"__lo": F.col("__w"), "__n": F.lit(1).cast("long")})
    mass, size = tot["__lo"], tot["__n"]
    cell = max(1, -(-mass // max(size, 1)))
    placed = placed.filter("__w > 0").select("neg_item", "__lo", (F.col("__lo") + F.col("__w")).alias("__hi"))
    owned = placed.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") / cell), F.floor((F.col("__hi") - 1) / cell))))
    mine = placed.select(F.col("neg_item").alias(positive), F.col("__lo").alias("__mlo"), F.col("__hi").alias("__mhi"))
    d = rows.select(row, positive).join(mine, positive, "left")
    d = d.withColumn("__places", _draws(F.col(row), 2 * n, lambda j: F.pmod(hash_of(F.col(row), j), F.lit(mass)),
                                        lambda x: (x >= F.col("__mlo")) & (x < F.col("__mhi")), n))
    d = _exploded(d, [row, positive]).withColumn("__cell", F.floor(F.col("__at") / cell))
    return (d.join(owned, "__cell").filter((F.col("__at") >= F.col("__lo")) & (F.col("__at") < F.col("__hi")))
            .select(row, positive, "neg_no", "neg_item"))


def hard(rows: DataFrame, candidates: DataFrame, pool: DataFrame, n: int, row: str, positive: str = ITEM,
         request: str = REQ, hash_of: HashOf | None = None, order: Callable[[Column, Column], Column] | None = None,
         hot_rows: int | None = None) -> DataFrame:
    """n negatives per row from its request's candidates; rows without any use the pool.

    Candidates are put in hashed order once per request; a row takes a run of that ring from
    a hashed start, so draws are distinct while the ring is long enough and repeat only when
    it is too short. Rows x candidates is never built.
    """
    hash_of = hash_of or seeded(0)
    order = order or (lambda r, i: F.xxhash64(F.lit(1), r, i))
    c = candidates.select(request, F.col(ITEM).alias("neg_item")).filter("neg_item is not null").distinct()
    ring = with_row_number(c, [request], [order(F.col(request), F.col("neg_item")), F.col("neg_item")], "__idx", hot_rows,
                           upper=candidates)
    ring = stable(ring.withColumn("__idx", F.col("__idx") - 1))
    sizes = ring.groupBy(request).agg(F.count("*").alias("__m"))
    mine = ring.select(request, F.col("neg_item").alias(positive), F.col("__idx").alias("__own"))
    keep = list(dict.fromkeys([row, request, positive]))
    d = rows.select(*keep).join(sizes, request, "left").join(mine, [request, positive], "left")
    others = F.coalesce(F.col("__m"), F.lit(0)) - F.when(F.col("__own").isNotNull(), 1).otherwise(0)
    start = F.pmod(hash_of(F.col(row), F.lit(0)), F.col("__m"))
    some = d.filter(others > 0).withColumn("__places", _draws(
        F.col(row), 2 * n + 2, lambda j: F.pmod(start + j, F.col("__m")), lambda x: x == F.col("__own"), n))
    got = _exploded(some, keep).withColumnRenamed("__at", "__idx").join(ring, [request, "__idx"])
    back = uniform(d.filter(others <= 0), pool, n, row, positive, hash_of=hash_of)
    return (got.select(row, positive, "neg_no", "neg_item", F.lit("candidates").alias("source"))
            .unionByName(back.withColumn("source", F.lit("pool"))))


def in_batch(rows: DataFrame, order: list[str], row: str, batch: int, n: int, item: str = ITEM,
             hash_of: HashOf | None = None) -> DataFrame:
    """n draws (with replacement) per row from the other rows of its batch of consecutive rows."""
    hash_of = hash_of or seeded(0)
    placed, tot = with_global_prefix(rows.select(*dict.fromkeys([row, item, *order])), order, {"__pos": F.lit(1).cast("long")})
    total = tot["__pos"]
    start = F.floor(F.col("__pos") / batch) * batch
    size = F.least(F.lit(batch), F.lit(total) - start)
    d = placed.withColumn("__start", start).withColumn("__size", size).filter("__size > 1")
    d = d.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    step = F.pmod(hash_of(F.col(row), F.col("__j")), F.col("__size") - 1) + 1
    d = d.withColumn("__at", F.col("__start") + F.pmod(F.col("__pos") - F.col("__start") + step, F.col("__size")))
    src = placed.select(F.col("__pos").alias("__at"), F.col(row).alias("neg_row"), F.col(item).alias("neg_item"))
    return d.join(src, "__at").select(row, item, (F.col("__j") + 1).alias("neg_no"), "neg_row", "neg_item")


def in_batch_losses(rows: DataFrame, order: list[str], row: str, batch: int, user: str, item: str, gap: float = 1.0,
                    temperature: float = 1.0) -> DataFrame:
    """(row, n_neg, bpr, hinge, softmax_ce): each row's losses against the items of all other rows of its batch.

    Rows in order form batches of `batch`. A batch is one matrix product in one task (users by items) that gives one
    row per anchor: mean BPR and hinge over its negatives and the softmax cross-entropy; a lone row has none of them.
    Scores are dot products over the temperature.
    """
    src = rows.select(*dict.fromkeys([row, *order]), F.col(user).cast("array<double>").alias("__u"), F.col(item).cast("array<double>").alias("__v"))
    placed, _ = with_global_prefix(src, order, {"__pos": F.lit(1).cast("long")})
    kind = rows.schema[row].dataType.simpleString()

    def one(t: pa.Table) -> pa.Table:
        u, v = (to_numpy(t.column(c)).astype(np.float64) for c in ("__u", "__v"))
        s = u @ v.T / temperature
        n = len(s)
        lead = s - np.diag(s)[:, None]                      # how far each negative is above the positive
        np.fill_diagonal(lead, 0.0)
        off = ~np.eye(n, dtype=bool)
        top = lead.max(axis=1)                              # 0 for the positive itself, so never below 0
        ce = top + np.log(np.exp(lead - top[:, None]).sum(axis=1))
        cols = [np.full(n, n - 1)]
        for x in (np.logaddexp(0.0, lead), np.maximum(gap + lead, 0.0)):
            cols.append((x * off).sum(axis=1) / max(n - 1, 1))
        lone = np.full(n, n < 2)
        return pa.table([t.column(row), pa.array(cols[0]), *[pa.array(x, mask=lone) for x in (*cols[1:], ce)]], names=[row, "n_neg", "bpr", "hinge", "softmax_ce"])

    return (placed.withColumn("__batch", F.floor(F.col("__pos") / batch)).select(row, "__batch", "__u", "__v")
            .groupBy("__batch").applyInArrow(one, f"{row} {kind}, n_neg long, bpr double, hinge double, softmax_ce double"))


def fetch_features(negatives: DataFrame, pool: DataFrame, item: str = ITEM) -> DataFrame:
    return negatives.join(pool.withColumnRenamed(item, "neg_item"), "neg_item")


def hashed_sample(df: DataFrame, n: int, key: list[str], seed: int = 0, hash_expr: Column | None = None) -> DataFrame:
    """The n rows with the smallest hash of their key."""
    h = hash_expr if hash_expr is not None else F.xxhash64(F.lit(seed), *[F.col(c) for c in key])
    return df.withColumn("__h", h).orderBy("__h", *key).limit(n).drop("__h")


def pair_distance(df: DataFrame, key: str, vector: str, max_pairs: int | None = None, seed: int = 0) -> DataFrame:
    """Mean L2 distance over pairs of distinct rows: all, or up to `max_pairs` of them.

    Without a cap, or when all pairs fit, all are taken and the mean is exact: vectors are dealt to blocks, and each pair of blocks is one
    cell that gives a count and a sum, so no pair is a row. Else pairs are numbered, (a, b) with a < b from the number,
    and an arithmetic progression through the numbers, whose step shares no factor with their count, takes that many
    different pairs; both ends are looked up by index.
    """
    from lumirank.functions.vectors import norm
    src = df.select(key, F.col(vector).cast("array<double>").alias("v"))
    n = src.count()
    pairs = n * (n - 1) // 2
    if not pairs:
        return df.sparkSession.createDataFrame([(0, None)], "pairs long, mean_distance double")
    if max_pairs is None or pairs <= max_pairs:
        return _all_distances(df.select(key, F.col(vector).alias("v")), key, n)
    idx, _ = with_global_prefix(src, [key], {"__i": F.lit(1).cast("long")})
    take = min(max_pairs, pairs)
    step, first = 1, 0
    if take < pairs:
        step = pairs * 618 // 1000 + 1 + 2 * seed
        while math.gcd(step, pairs) != 1:
            step += 1
        first = seed * 1_000_003
    num = F.col("id").cast("decimal(38,0)") * F.lit(step) + F.lit(first)
    p = df.sparkSession.range(take).select((num % F.lit(pairs)).cast("long").alias("p"))
    guess = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("long")
    p = p.withColumn("g", guess)
    b = (F.when(F.col("g") * (F.col("g") - 1) / 2 > F.col("p"), F.col("g") - 1)
         .when(F.col("g") * (F.col("g") + 1) / 2 <= F.col("p"), F.col("g") + 1).otherwise(F.col("g")))
    p = p.withColumn("b", b).select((F.col("p") - F.expr("b * (b - 1) div 2")).alias("a"), "b")
    left = idx.select(F.col("__i").alias("a"), F.col("v").alias("va"))
    right = idx.select(F.col("__i").alias("b"), F.col("v").alias("vb"))
    d = norm(F.zip_with("va", "vb", lambda x, y: x - y))
    return p.join(left, "a").join(right, "b").agg(F.count("*").alias("pairs"), F.avg(d).alias("mean_distance"))


def _all_distances(src: DataFrame, key: str, n: int) -> DataFrame:
    blocks = max(1, -(-n // DISTANCE_BLOCK))
    mine = F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(blocks)).cast("int")
    dealt = (src.select("v", mine.alias("m")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select("v", "m", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j")))

    def cell(t: pa.Table) -> pa.Table:
        x, side = to_numpy(t.column("v")).astype(np.float64), to_numpy(t.column("m"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        a, b = x[side == i], x[side == j]
        na, nb = (a ** 2).sum(axis=1), (b ** 2).sum(axis=1)
        total, count, step = 0.0, 0, max(1, (1 << 22) // max(len(b), 1))
        for at in range(0, len(a), step):
            size = na[at:at + step, None] + nb[None]
            d = size - 2.0 * (a[at:at + step] @ b.T)
            near = np.argwhere(d < 1e-4 * size)              # close vectors cancel out here: theirs from the differences
            for k in range(0, len(near), 1 << 16):
                r, c = near[k:k + (1 << 16)].T
                d[r, c] = ((a[at + r] - b[c]) ** 2).sum(axis=1)
            np.sqrt(d, out=d)
            if i == j:                                       # each pair once
                d = d[np.arange(len(b))[None, :] > np.arange(at, at + len(d))[:, None]]
            total, count = total + float(d.sum()), count + d.size
        return pa.table({"n": pa.array([count], pa.int64()), "s": pa.array([total], pa.float64())})

    got = dealt.groupBy("i", "j").applyInArrow(cell, "n long, s double")
    return got.agg(F.sum("n").alias("pairs"), (F.sum("s") / F.sum("n")).alias("mean_distance"))


def field_uniformity(df: DataFrame, fields: list[str]) -> DataFrame:
    """Mean over field pairs of the mean absolute cosine between two fields of a row."""
    from lumirank.functions.vectors import cosine
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1:]]
    if not pairs:
        return df.agg(F.lit(0.0).alias("uniformity"))
    per = [F.avg(F.abs(cosine(F.col(a), F.col(b)))) for a, b in pairs]
    return df.agg((sum(per[1:], per[0]) / len(per)).alias("uniformity"))


def add_laplace(df: DataFrame, score: str, scale: float, key: list[str], seed: int = 0,
                uniform: Column | None = None) -> DataFrame:
    """Noise from a seeded hash of the row's key, or from a given uniform column."""
    from lumirank.functions.numeric import laplace_noise
    u = hash_uniform(F.lit(seed), *[F.col(c) for c in key]) if uniform is None else uniform
    return df.withColumn(score, F.col(score) + laplace_noise(u, scale))
