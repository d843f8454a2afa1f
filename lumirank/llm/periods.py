"""Maximal periodic runs of words: suffix classes united by falling common-prefix length."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, types as T

from lumirank.llm.base import map_text

MIN_LENGTH, MIN_PERIODS = 12, 2
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()         # bytes split at space and 9 to 13 only


def repeats(ids: np.ndarray, width: int) -> bool:
    """Whether any `width` consecutive ids may stand twice (equal hashes may say so wrongly)."""
    n = len(ids) - width + 1
    if n < 2:
        return False
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[j:j + n].astype(np.uint64) + np.uint64(1))
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffix_neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in their order, and the common-prefix length of each with the one before (0 for the first).

    Prefix doubling: rank k orders prefixes of 2^k ids. Equal ranks, from the longest prefix down, add up
    to the common length.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while step < n and int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    lcp, a, b = np.zeros(n, np.int64), order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        # equal ranks of 2^k mean 2^k equal ids, unless the text ends first: ends differ in length, so in rank
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
        lcp[1 + same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, lcp


def periodic_runs(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All (start, length, period) with the smallest period, at least two periods and `min_length` ids, that
    can't be extended to either side; by start, then period.

    Suffixes are united by falling common-prefix length L (Kruskal over neighbours in suffix order). Each
    class keeps its positions in order. Positions i < j that become neighbours at L with j - i <= L start a
    stretch of period j - i that ends at j + L; it is a run if ids i - 1 and j - 1 differ. A run of period q
    and length m has L = m - q >= m / 2, so nothing is united below half of the least length.
    """
    n, least = len(ids), -(-min_length // 2)
    if n < min_length or not repeats(ids, least):
        return []
    order, lcp = suffix_neighbours(ids)
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    w = ids.tolist()
    owner: dict[int, list[int]] = {}                   # position -> the ordered positions of its class
    found, pending, level = [], [], -1

    def settle():
        # only pairs still adjacent when the level is done: a position between them would give a shorter period
        for i, j in pending:
            cls = owner[i]
            at = bisect_left(cls, i)
            if at + 1 < len(cls) and cls[at + 1] == j and j - i + level >= min_length:
                found.append((i, j - i + level, j - i))
        pending.clear()

    for x, y, length in zip(order[edges - 1].tolist(), order[edges].tolist(), lcp[edges].tolist()):
        if length != level:
            settle()
            level = length
        small, large = owner.get(x) or [x], owner.get(y) or [y]
        if len(small) > len(large):
            small, large = large, small
        if len(large) == 1:
            owner[large[0]] = large
        last = -1                                      # what came before p in its own class is no new neighbour
        for p in small:
            at = bisect_left(large, p)
            if at and large[at - 1] != last and p - large[at - 1] <= length:
                i = large[at - 1]
                if i == 0 or w[i - 1] != w[p - 1]:
                    pending.append((i, p))
            if at < len(large) and large[at] - p <= length:
                j = large[at]
                if p == 0 or w[p - 1] != w[j - 1]:
                    pending.append((p, j))
            large.insert(at, p)
            owner[p] = large
            last = p
    settle()
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapse(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that stand in a run after its first period."""
    if not runs:
        return list(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def find_periodic_runs(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None,
                       min_length: int = MIN_LENGTH) -> DataFrame:
    """Kept columns with `runs` (start, length, period in words) and `collapsed`, the text without repeats.

    Words are what stands between blanks and control characters 9 to 13, compared byte by byte. Null and empty
    texts have no runs and collapse to an empty text. One map over whole texts; a text is the work of one task.
    Columns named like a new one are replaced.
    """
    def make():
        def run(texts):
            runs, collapsed = [], []
            for t in texts:
                words, seen = words_of(t), {}
                ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
                found = periodic_runs(ids, min_length)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                collapsed.append(b" ".join(collapse(words, found)).decode("utf-8", "surrogatepass"))
            return runs, collapsed
        return run

    return map_text(df, text, make, [("runs", RUNS), ("collapsed", T.StringType())], keep)
