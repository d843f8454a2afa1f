"""Shared helpers of the text operators: Arrow maps over whole texts, folds, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE = 512          # rows handled at once inside a task; the results do not depend on it

# ASCII white space, the word separators of the shingle operators
SEPARATORS = (9, 10, 11, 12, 13, 32)

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def map_text(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], Sequence]],
             fields: list[tuple[str, T.DataType]], keep: Sequence[str] | None = None) -> DataFrame:
    """Append columns computed from whole texts, batch by batch and without a shuffle.

    `make` is called once per task; what it returns maps a list of texts (null reads as
    empty when the function does not ask for it) to one sequence per new column. Columns
    of the input are kept (`keep` names which); one that has the name of a new column is
    replaced by it.
    """
    new = {n for n, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    last = "__text"
    while last in kept:
        last += "_"
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(last))
    schema = T.StructType([src.schema[c] for c in kept] + [T.StructField(n, t, True) for n, t in fields])
    types = [to_arrow_schema(T.StructType([T.StructField(n, t, True)])).field(0).type for n, t in fields]

    def run(batches):
        fn = make()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                out = fn(part.column(len(kept)).to_pylist())
                cols = [part.column(k) for k in range(len(kept))]
                cols += [o if isinstance(o, pa.Array) else pa.array(o, t) for o, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays(cols, names=kept + [n for n, _ in fields])

    return src.mapInArrow(run, schema)


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id's text modulo `mod`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod


def bounded_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """At most about n rows, chosen by a hash of the key, so reruns choose the same rows."""
    total = df.count()
    if total <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int(n / total * (1 << 30)))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S)
    h = h * _M1
    h = h ^ (h >> _S)
    h = h * _M2
    return h ^ (h >> _S)


def word_hashes(texts: list[bytes], separators: np.ndarray = _IS_SEP) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z lower-cased), and per text where its words begin
    (one more at the end). `separators` marks, per byte, what stands between words; a blank must be one."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    if not texts:
        return np.empty(0, np.uint64), bounds
    a = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    sep = separators[a]
    before = np.empty_like(sep)
    before[0] = True
    before[1:] = sep[:-1]
    start = np.flatnonzero(~sep & before)
    if not len(start):
        return np.empty(0, np.uint64), bounds
    end = np.flatnonzero(sep & ~before)
    length = end - start
    # hash of a word: its bytes weighted by powers of an odd constant, then mixed
    inside = np.flatnonzero(~sep)
    pos = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    powers = np.cumprod(np.full(int(length.max()), _P, np.uint64))
    values = (a[inside].astype(np.uint64) + np.uint64(1)) * powers[pos]
    h = mix(np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds[1:] = np.searchsorted(start, ends)
    return h, bounds


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles (lower-cased A-Z).

    A text of fewer than k words has its whole word sequence as one shingle; one without words has none.
    """
    h, bounds = word_hashes(texts)
    out, n = [], len(h)
    s = np.zeros(n, np.uint64)
    if n >= k:
        for j in range(k):
            s[:n - k + 1] = (s[:n - k + 1] + h[j:n - k + 1 + j]) * _P + np.uint64(j)
        s = mix(s)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        c = int(hi - lo)
        if c == 0:
            out.append(np.empty(0, np.uint64))
        elif c < k:
            x = np.array([c], np.uint64)
            for y in h[lo:hi]:
                x = mix((x ^ y) * _P)
            out.append(x)
        else:
            out.append(np.unique(s[lo:hi - k + 1]))
    return out
