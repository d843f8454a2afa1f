"""Reproducible shuffles into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumirank.llm.base import mix
from lumirank.session import stable

ROUNDS = 8
_ROW_BITS = 33                # monotonically_increasing_id: the partition's number above the row's number in it


class Permutation:
    """A bijection of 0 .. n-1 that any process computes for single numbers from (n, seed) alone.

    A Feistel network permutes the numbers of 2 * half bits, the least such range that holds n
    (under 4 n). A number that lands past n is sent through again until it lands below: the walk
    stays on one cycle of the network, so the map remains one-to-one.
    """

    def __init__(self, n: int, seed: int = 0):
        self.n = int(n)
        self.half = np.uint64(max(1, -(-max(self.n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        with np.errstate(over="ignore"):
            self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed % (1 << 64)], np.uint64)))

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        return (right << self.half) | left               # halves swapped: the same network with reversed keys undoes it

    def _walk(self, x, keys) -> np.ndarray:
        x = np.array(x, np.uint64, ndmin=1)
        if x.size and int(x.max()) >= self.n:
            raise ValueError(f"a number is not below {self.n}")
        with np.errstate(over="ignore"):
            out = self._network(x, keys)
            while (far := np.flatnonzero(out >= np.uint64(self.n))).size:
                out[far] = self._network(out[far], keys)
        return out.astype(np.int64)

    def place(self, numbers) -> np.ndarray:
        """Where each row number goes."""
        return self._walk(numbers, self.keys)

    def number(self, places) -> np.ndarray:
        """Which row number goes to each place."""
        return self._walk(places, self.keys[::-1])


def shard_and_slot(numbers, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers among n rows: places are dealt out in turn."""
    place = Permutation(n, seed).place(numbers)
    return place % shards, place // shards


def row_number_at(shard, slot, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The row number that stands in a slot of a shard."""
    return Permutation(n, seed).number(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64))


def assign_shards(df: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text: str = "text",
                  keep: Sequence[str] | None = None) -> DataFrame:
    """Kept columns (all by default) with row_number, shard and slot; slots of a shard run from 0 without a gap.

    Rows are numbered by id (null ids first), then by the text's bytes, crc32 and 64-bit hash (a null text
    reads as empty), so the same rows get the same places in any partitioning and file order. Rows equal in
    all of these are interchangeable: which of them gets which of their numbers is not fixed, and they are
    dealt over ranges so that no task gets all of them. Shard sizes differ by one row at most; an empty
    table gives no rows. Kept columns that are named like a new one are replaced.

    Only what is kept is moved: one range shuffle, written once; the driver gets one count per partition.
    """
    new = ["row_number", "shard", "slot"]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    t = F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8")
    order = [F.col(f"`{id_col}`"), F.octet_length(t), F.crc32(t), F.xxhash64(t), F.xxhash64(F.monotonically_increasing_id())]
    keyed = df.select(*[F.col(f"`{c}`") for c in kept], *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    by = [F.col(f"__o{i}").asc_nulls_first() for i in range(len(order))]
    # numbers follow partitions, and a range partitioning is sampled: written once
    sorted_ = keyed.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = stable(sorted_.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias("__at")))
    sizes = numbered.groupBy(F.shiftright("__at", _ROW_BITS).alias("p")).count().orderBy("p").collect()      # one row per partition
    parts = np.array([r["p"] for r in sizes], np.int64)
    before = np.cumsum([0, *[r["count"] for r in sizes]])
    n = int(before[-1])
    schema = T.StructType([*[numbered.schema[c] for c in kept], T.StructField("row_number", T.LongType()),
                           T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            at = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            number = before[np.searchsorted(parts, at >> _ROW_BITS)] + (at & ((1 << _ROW_BITS) - 1))
            shard, slot = shard_and_slot(number, n, shards, seed) if len(at) else (at, at)
            cols = [pa.array(number, pa.int64()), pa.array(shard, pa.int32()), pa.array(slot, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *cols], schema=arrow)

    return numbered.mapInArrow(run, schema)


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Folders shard=0, shard=1, ... with their rows in files of consecutive slots; a file is the work of one task."""
    part = F.floor(F.col("slot") / F.lit(rows_per_file))
    (placed.withColumn("__file", part).repartition("shard", "__file").sortWithinPartitions("shard", "slot")
     .drop("__file").write.partitionBy("shard").parquet(path))
