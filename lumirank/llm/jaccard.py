"""N-gram Jaccard self-join by T-occurrence search with DivideSkip, to connected groups of documents."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumirank.llm.base import map_text, shingle_sets
from lumirank.llm.graph import components
from lumirank.session import stable

SHARE = 0.3                   # share of all hash values whose document frequency is counted
CHUNK_ROWS = 2_000            # documents packed into one row of the counting step
BUCKET_KEYS = 2_000_000       # counted hashes in one task
SENT_ROWS = 500_000            # candidates (two ids and a count each, some 20 MB) that are sent to every task
BLOCK_ROWS, BLOCK_KEYS = 1_000, 2_000_000      # documents, and shingles, in one block of the search
SKIP = 0.0085                 # DivideSkip's weight of the longest list's logarithm
_CUT = np.uint64(int(SHARE * (1 << 48)))


def needed(n, num: int, den: int):
    """Smallest overlap a set of n can have with any set it is linked to."""
    return -(-num * n // den)


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    a = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(a), 8), np.uint8)
    out[:, :6] = a
    return out.reshape(-1).view("<u8")


def shingle_table(docs: DataFrame, id_col: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """Per row: id, size of the shingle set, digest of the set, and the hashes that may enter its prefix.

    Those are all below the cut, and at least as many of the smallest as a prefix takes.
    """
    def make():
        def run(texts):
            n, digest, keys = [], [], []
            for s in shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in texts], k):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                h = np.unique(s >> np.uint64(16))
                prefix = len(s) - int(needed(len(s), num, den)) + 1 if len(s) else 0
                keys.append(_pack48(h[:max(int(np.searchsorted(h, _CUT)), prefix)]))
            return n, digest, keys
        return run

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    return stable(map_text(src, "__text", make, [("__n", T.LongType()), ("__digest", T.BinaryType()), ("__keys", T.BinaryType())], keep=["__id"]))


def _chunks(reps: DataFrame) -> DataFrame:
    """Sets packed by the thousand, so that counting moves a few long rows instead of one per shingle."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("m", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("ns", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("keys", T.BinaryType())])

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                sub = batch.slice(at, CHUNK_ROWS)
                keys = sub.column(2).to_pylist()
                sizes = np.array([len(k) // 6 for k in keys], np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([(part << 32) | nth], pa.int64()), pa.array([int(sizes.sum())], pa.int64()),
                    pa.array([sub.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
                    pa.array([sub.column(1).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
                    pa.array([sizes.tobytes()], pa.binary()), pa.array([b"".join(keys)], pa.binary())], schema=to_arrow_schema(schema))
                nth += 1

    return stable(reps.select("__id", "__n", "__keys").mapInArrow(run, schema))


def prefix_entries(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(h, id): the prefix hashes of each set that some other set has as well.

    A link needs an overlap of T = ceil(num * n / den) for either side, so it shows among any
    n - T + 1 hashes of a set, when all sets choose theirs by one order. The order here is:
    counted hashes before others, rare before frequent, then by value; frequent lists (shared
    passages) are so the long lists that a search leaves out. Frequencies are counted in buckets
    of hashes and sent back to the chunks they came from.
    """
    chunks = _chunks(reps)
    total = chunks.agg(F.sum("m")).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET_KEYS))

    def order_of(h):
        return np.argsort(h % np.uint64(buckets), kind="stable")

    sent = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("vals", T.BinaryType())])

    def deal(batches):
        for batch in batches:
            for chunk, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = _unpack48(keys)
                h = h[order_of(h)]
                b = (h % np.uint64(buckets)).astype(np.int64)
                v = ((h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype("<u4")
                at = np.searchsorted(b, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()),
                                                  pa.array([v[at[i]:at[i + 1]].tobytes() for i in some], pa.binary())], schema=to_arrow_schema(sent))

    def count(pdf):
        pdf = pdf.sort_values("chunk")
        parts = [np.frombuffer(x, "<u4") for x in pdf["vals"]]
        inv, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)[1:]
        df = np.minimum(n, 255).astype(np.uint8)[inv]
        ends = np.cumsum([len(p) for p in parts])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"],
                             "df": [df[e - len(p):e].tobytes() for p, e in zip(parts, ends)]})

    counted = (chunks.select("chunk", "keys").mapInArrow(deal, sent).groupBy("bucket")
               .applyInPandas(count, "chunk long, bucket int, df binary"))

    def choose(left, right):
        out_h, out_id = [], []
        for ids, ns, sizes, keys in zip(left["ids"], left["ns"], left["sizes"], left["keys"]):
            h = _unpack48(keys)
            df = np.empty(len(h), np.uint8)
            got = right.sort_values("bucket")
            if len(h):
                df[order_of(h)] = np.frombuffer(b"".join(got["df"]), np.uint8)
            ids, ns, ends = np.frombuffer(ids, np.int64), np.frombuffer(ns, np.int64), np.cumsum(np.frombuffer(sizes, np.int32))
            late = h >= _CUT
            for i, n, a, b in zip(ids, ns, np.concatenate([[0], ends[:-1]]), ends):
                x, d = h[a:b], df[a:b]
                o = np.lexsort((x, np.where(late[a:b], 0, d), late[a:b]))[:n - needed(n, num, den) + 1]
                o = o[d[o] > 1]
                out_h.append(x[o].astype(np.int64))
                out_id.append(np.full(len(o), i))
        e = np.empty(0, np.int64)
        return pd.DataFrame({"h": np.concatenate([e, *out_h]), "id": np.concatenate([e, *out_id])})

    return chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInPandas(choose, "h long, id long")


def linked_pairs(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the sets into their components: num/den <= |A & B| / |A | B|.

    T-occurrence search with DivideSkip. Inverted lists of all shingles are built; each set asks for
    larger ones (ties: later ones) that occur at least T times on its lists. The lists are ordered
    by length, the longest L = T / (SKIP * log2(longest) + 1) are left out; the sorted short lists
    are merged (one stable sort of the runs), candidates seen T - L times there are looked up in
    the long lists by binary search. Pairs of one component so far need no look-up. With `side`,
    only pairs across the two sides count.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, sizes))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    flat = np.concatenate([sets[i] for i in order]) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes[order])
    by = np.argsort(flat, kind="stable")                     # within a list, documents ascend
    h, postings = flat[by], owner[by]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
    list_of = np.empty(len(flat), np.int64)
    list_of[by] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(h)))
    probe = (np.cumsum(new) - 1) * n + postings if len(h) else postings
    ends = np.cumsum(sizes[order])
    size, where = sizes[order], None if side is None else np.asarray(side)[order]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    root = np.arange(n)
    out = []
    for q in range(n):
        m = int(size[q])
        if m == 0:
            continue
        lists = list_of[ends[q] - m:ends[q]]
        lists = lists[length[lists] > 1]
        t = -(-2 * num * m // (num + den))                   # partners are not smaller
        if len(lists) < t:
            continue
        lists = lists[np.argsort(length[lists], kind="stable")]
        skip = min(t - 1, int(t / (SKIP * math.log2(length[lists[-1]]) + 1)))
        short, long = lists[:len(lists) - skip], lists[len(lists) - skip:]
        runs = np.concatenate([postings[start[x]:start[x] + length[x]] for x in short])
        runs = np.sort(runs[runs > q], kind="stable")
        if not len(runs):
            continue
        first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        cand, seen = runs[first], np.diff(np.append(first, len(runs)))
        ok = (seen >= t - skip) & (size[cand] * num <= m * den)
        if where is not None:
            ok &= where[cand] != where[q]
        cand, seen = cand[ok], seen[ok]
        for at in range(0, len(cand), 64):
            c, s = cand[at:at + 64], seen[at:at + 64]
            mine = find(q)
            keep = np.array([find(x) != mine for x in c.tolist()])
            c, s = c[keep], s[keep]
            if not len(c):
                continue
            if len(long):
                key = (long[:, None] * n + c[None, :]).ravel()
                pos = np.searchsorted(probe, key)
                hit = probe[np.minimum(pos, len(probe) - 1)] == key
                s = s + hit.reshape(len(long), len(c)).sum(axis=0)
            for x in c[s * (num + den) >= num * (m + size[c])].tolist():
                a, b = find(q), find(x)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(ids[order[q]]), int(ids[order[x]])))
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row: id, `n_shingles`, `component_id` (the smallest id reachable over links, its own included).

    Two rows link when den * |A & B| >= num * |A | B| for their sets of k-word shingles (words are
    what stands between ASCII white space, A-Z lower-cased; fewer than k words are one shingle).

    1. Rows of one set are one class, kept by its smallest id; copies meet only in a map-side minimum.
    2. `prefix_entries` leaves, per class, the few rare shingles that others share. Classes that
       share one are candidates of each other: each list points to its smallest id, and the
       components of that graph hold every link inside.
    3. Components are searched by `linked_pairs`, small ones many to a task. One with more than
       BLOCK_ROWS documents is cut into blocks, and each pair of blocks is a task of its own; so a
       large group is spread out, with as many copies of a text as its component has blocks.
    4. The links' components give the result.

    Null and empty texts, and those of white space, have no shingles and are linked with nothing:
    component_id is the own id. Rows that share an id are one node. A row whose id is null is no
    node; it gets the id of its class, or null if no other row has its set.
    """
    sets = shingle_table(docs, id_col, text, k, num, den)
    first = (sets.filter("__n > 0 AND __id IS NOT NULL").groupBy("__n", "__digest")
             .agg(F.min(F.struct("__id", "__keys")).alias("__s"))
             .select("__n", "__digest", F.col("__s.__id").alias("__id"), F.col("__s.__keys").alias("__keys")))
    entries = stable(prefix_entries(first, num, den))
    hubs = entries.groupBy("h").agg(F.min("id").alias("hub"), F.count("*").alias("c")).filter("c > 1").select("h", "hub")
    near = stable(components(entries.join(hubs, "h").select(F.col("hub").alias("a"), F.col("id").alias("b"))))

    # an id with several sets counts with each of them, so that blocks are bounded by rows
    own = (sets.filter("__id IS NOT NULL AND __n > 0").groupBy(F.col("__id").alias("node"), "__n", "__digest").agg(F.count("*").alias("rows"))
           .groupBy("node").agg(F.count("*").alias("c"), F.sum("__n").alias("w"), F.max("rows").alias("rows")))
    own = stable(near.join(own, "node"))
    share = own.groupBy("root").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    share = share.select("root", F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_KEYS)).cast("int").alias("blocks"), "c", "w")
    c, w = share.filter("blocks = 1").agg(F.sum("c"), F.sum("w")).first()
    tasks = max(1, -(-int(c or 0) // BLOCK_ROWS), -(-int(w or 0) // BLOCK_KEYS))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    placed = own.select("node", "root").join(share.select("root", "blocks"), "root")
    # few candidates are sent to the texts; beyond the bound texts and candidates are shuffled by id
    work = texts.join(F.broadcast(placed) if own.count() <= SENT_ROWS else placed, "node")
    if not own.filter("rows > 1").isEmpty():
        # rows of one id and text: one of them is searched
        work = work.groupBy("node", "root", "blocks", F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"))
    work = (work.withColumn("mine", F.pmod(F.xxhash64("node", "text"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("node", "text", "mine", F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(tasks))).alias("g"),
                    (F.col("blocks") > 1).alias("large"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))

    def search(pdf):
        s = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]], k)
        side = pdf["mine"].to_numpy() if pdf["i"].iloc[0] != pdf["j"].iloc[0] else None
        return pd.DataFrame(linked_pairs(pdf["node"].to_numpy(), s, side, num, den), columns=["a", "b"]).astype("int64")

    links = work.groupBy("g", "large", "i", "j").applyInPandas(search, "a long, b long")
    roots = components(links)
    classes = (first.select("__n", "__digest", F.col("__id").alias("node")).join(roots, "node", "left")
               .select("__n", "__digest", F.coalesce("root", "node").alias("__class")))
    # rows of one id are one node, whichever of their sets is linked
    return (sets.select("__id", "__n", "__digest").join(classes, ["__n", "__digest"], "left")
            .select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"),
                    F.when(F.col("__n") > 0, F.coalesce("__class", "__id")).otherwise(F.col("__id")).alias("component_id")))
