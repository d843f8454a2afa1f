"""Order MinHash fingerprints: minimal occurrence-numbered k-mers in text order, sensitive to edit distance."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lumirank.llm.base import mix

K = 12                        # characters of a k-mer
FUNCTIONS = 32                # hash functions, one tuple each
ROWS_PER_BLOCK = 1_000        # rows of neighbouring ids that stay together; more rows make more blocks,
MAX_BLOCKS = 20_000           # up to this many block borders on the driver (blocks then grow, streamed row by row)

_P = np.uint64(0x9E3779B97F4A7C15)
_MAX = np.uint64(2**64 - 1)
_FACTORS = np.random.default_rng(20).integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NUMBERED = np.uint64(0xD1B54A32D192ED03)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 1 << 64))


def kmers(c: np.ndarray) -> np.ndarray:
    """Hash of each k-mer together with how often it has occurred before. Shorter texts are one k-mer, empty ones none."""
    n = len(c)
    if n == 0:
        return np.empty(0, np.uint64)
    x = c.astype(np.uint64) + np.uint64(1)
    if n < K:
        return mix(np.array([np.add.reduce(x * np.array([_power(i) for i in range(n)], np.uint64)) + np.uint64(n)], np.uint64))
    two = x[:-1] * _P + x[1:]
    four = two[:-2] * _power(2) + two[2:]
    eight = four[:-4] * _power(4) + four[4:]
    h = eight[:n - K + 1] * _power(4) + four[8:]
    h = mix(h)
    s = np.sort(h)
    again = s[1:] == s[:-1]
    if again.any():
        at = np.flatnonzero(np.isin(h, s[1:][again]))
        o = np.argsort(h[at], kind="stable")
        v = h[at][o]
        first = np.concatenate([[True], v[1:] != v[:-1]])
        nth = np.arange(len(v)) - np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
        h[at[o]] = mix(v + nth.astype(np.uint64) * _NUMBERED) * (nth > 0) + v * (nth == 0)
    return h


def _least(x: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Per function the two smallest hashes (FUNCTIONS x 2) of a stretch of k-mers and their places."""
    value = np.full((FUNCTIONS, 2), _MAX)
    place = np.full((FUNCTIONS, 2), -1, np.int64)
    rows = np.arange(FUNCTIONS)
    for at in range(0, len(x), 8192):                       # long texts by stretches that fit the cache
        y = x[None, at:at + 8192] * _FACTORS[:, None]
        v, p = [], []
        for _ in range(min(2, y.shape[1])):
            j = y.argmin(axis=1)
            v.append(y[rows, j])
            p.append(j + at + start)
            y[rows, j] = _MAX
        value, place = _smaller(value, place, np.stack(v, 1), np.stack(p, 1))
    return value, place


def _smaller(v1, p1, v2, p2):
    v, p = np.concatenate([v1, v2], axis=1), np.concatenate([p1, p2], axis=1)
    p_key = np.where(p < 0, np.iinfo(np.int64).max, p)
    o = np.lexsort((p_key, v), axis=1)[:, :2]               # equal hashes: the earlier place
    return np.take_along_axis(v, o, 1), np.take_along_axis(p, o, 1)


def _tuples(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """32-bit hash of each function's minimal k-mers, taken in text order."""
    place = np.sort(place, axis=1)
    h = np.where(place >= 0, x[np.maximum(place, 0)] if len(x) else np.uint64(0), np.uint64(0))
    return (mix(h[:, 0] * _P + h[:, 1] + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str | None) -> np.ndarray:
    """FUNCTIONS 32-bit numbers; equal texts have equal ones. Null reads as empty."""
    x = kmers(_points(text))
    return _tuples(x, _least(x, 0)[1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of functions that chose the same tuple."""
    return float((a == b).mean())


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the following text."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q] if q else text


def with_edit(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edit. K-mers in the part both share are searched once."""
    other = edited(text, following)
    x, y = kmers(_points(text)), kmers(_points(other))
    shared = len(text) - len(text) // 4 - K + 1
    if other == text:
        f = _tuples(x, _least(x, 0)[1])
        return f, f, other
    if shared < 1:
        return _tuples(x, _least(x, 0)[1]), _tuples(y, _least(y, 0)[1]), other
    head = _least(x[:shared], 0)
    return (_tuples(x, _smaller(*head, *_least(x[shared:], shared))[1]),
            _tuples(y, _smaller(*head, *_least(y[shared:], shared))[1]), other)


SCHEMA = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
          ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _hex(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprints of the text and of its edit by the next text in ascending id order.

    Ids are cut into blocks of neighbours (borders are ids, found by an approximate quantile and
    exact as borders; at most MAX_BLOCKS of them reach the driver). A block's texts are shuffled
    once, sorted and streamed; the first row of each block also goes to the block before it, and
    the very first to the last block. Null ids come first, rows of one id are ordered by their
    text (null as empty); all of them stay in the result. One row alone is followed by itself.
    """
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-2**63))
    src = docs.select(F.col(f"`{id_col}`").alias("__id"), key.alias("__key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    n, low = src.agg(F.count("*"), F.min("__key")).first()
    blocks = min(MAX_BLOCKS, -(-n // ROWS_PER_BLOCK))
    borders = []
    if blocks > 1:
        got = src.agg(F.percentile_approx("__key", F.lit([i / blocks for i in range(1, blocks)]), F.lit(max(10_000, 20 * blocks)))).first()[0]
        borders = sorted({b for b in got if b > low})
    # two levels of comparisons: which group of borders, then which border in it
    width = max(1, math.isqrt(len(borders)))
    groups = [borders[i:i + width] for i in range(0, len(borders), width)]
    block = F.lit(0)
    if borders:
        heads = F.array(*[F.lit(g[0]) for g in groups])
        g = F.size(F.filter(heads, lambda b: b <= F.col("__key")))
        inner = F.element_at(F.array(F.array(F.lit(borders[0])), *[F.array(*[F.lit(b) for b in x]) for x in groups]), g + 1)
        block = F.when(g == 0, 0).otherwise((g - 1) * width + F.size(F.filter(inner, lambda b: b <= F.col("__key"))))
    last = len(borders)
    first_of_block = F.array(*[F.lit(b) for b in [low if low is not None else 0, *borders]])
    placed = src.withColumn("__block", block.cast("int"))
    starts = F.col("__key") == F.element_at(first_of_block, F.col("__block") + 1)
    before = F.when(F.col("__block") == 0, last).otherwise(F.col("__block") - 1)
    own = F.struct(F.col("__block").alias("b"), F.lit(0).alias("g"))
    rows = (placed.withColumn("__at", F.explode(F.when(starts, F.array(own, F.struct(before.cast("int").alias("b"), F.lit(1).alias("g")))).otherwise(F.array(own))))
            .select("__id", "__key", "__text", F.col("__at.b").alias("__block"), F.col("__at.g").alias("__guard"))
            .repartition("__block").sortWithinPartitions("__block", "__guard", "__key", "__text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(a, t) for a, t in SCHEMA])

    def run(batches):
        held = None                                          # (id, text, block, is guard)
        pending = None                                       # a finished text that waits for its neighbour's fingerprint
        for batch in batches:
            out = []
            ids, texts, blocks_, guards = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for row in zip(ids, texts, blocks_, guards):
                if held is not None and held[2] == row[2] and not held[3]:
                    f, e, other = with_edit(held[1], row[1])
                    done = (held[0], len(held[1]), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), f, e)
                    if pending is not None:
                        out.append(_row(pending, f))
                    pending = done
                    if row[3]:
                        out.append(_row(pending, fingerprint(row[1])))
                        pending = None
                held = row
            yield _batch(out, schema)

    return rows.mapInArrow(run, schema)


def _row(done, following):
    i, n, sha, f, e = done
    return (i, n, sha, _hex(f), _hex(e), likeness(f, e), likeness(f, following))


def _batch(rows, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    s = to_arrow_schema(schema)
    cols = list(zip(*rows)) if rows else [[] for _ in s]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, s)], schema=s)
