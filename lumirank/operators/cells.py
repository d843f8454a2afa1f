"""Scores of the users and items of one cell, worked off tile by tile.

A tile of dot products is a small matrix product in single precision. Its error is bounded, so most scores are settled by
it: below a user's k-th best, or above or below a positive. Only those within the bound are worked out in double precision
and rounded; a tile with very many of these is worked out as a whole. Counts are those of the exact, rounded scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

TILE_USERS, TILE_ITEMS = 256, 2_048          # scores of a tile stay in the processor's caches
PAIRS = 1 << 15                              # single pairs that are worked out at once
LEAST_SORTED, MOST_SORTED = 1 << 22, 1 << 25 # scores that are sorted at once to be counted between edges
GROUP_BLOCKS = 62                            # blocks of a group; those that a row visits are bits of a long


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the k best per row, equal scores by position."""
    n = scores.shape[1]
    if k >= n:
        return np.argsort(-scores, axis=1, kind="stable")
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    kth = np.take_along_axis(scores, part, 1).min(axis=1, keepdims=True)
    doubtful = np.flatnonzero((scores >= kth).sum(axis=1) > k)
    part.sort(axis=1)
    order = np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable")
    out = np.take_along_axis(part, order, 1)
    if doubtful.size:
        out[doubtful] = np.argsort(-scores[doubtful], axis=1, kind="stable")[:, :k]
    return out


def groups(count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Group and place in it of each block: neighbours in number, of at most `most` items together, unless one alone has more."""
    group, bit, g, b, held = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64), 0, 0, 0
    for j, n in enumerate(count.tolist()):
        if b and (held + n > most or b == GROUP_BLOCKS):
            g, b, held = g + 1, 0, 0
        group[j], bit[j], b, held = g, b, b + 1, held + n
    return group, bit


def group_needs(need: np.ndarray, group: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, blocks of it as bits) of a table of rows and the blocks that they visit."""
    bits = np.add.reduceat(np.where(need, np.int64(1) << bit, 0), np.flatnonzero(bit == 0), axis=1)
    row, g = np.nonzero(bits)
    return row, g, bits[row, g]


class Dots:
    """Dot products over a temperature, rounded."""

    def __init__(self, u: np.ndarray, x: np.ndarray, temperature: float, decimals: int, single: bool = True):
        self.u, self.x, self.temperature, self.decimals = u, x, temperature, decimals
        self.norm = np.linalg.norm(u, axis=1) / abs(temperature)
        self.reach = float(np.linalg.norm(x, axis=1).max(initial=0.0))
        most = float(self.norm.max(initial=0.0)) * self.reach
        # beyond single precision's range its errors are not bounded that way
        self.kind = np.float32 if single and max(most, self.reach, float(np.abs(u).max(initial=0.0))) < 1e18 else np.float64
        self.left, self.right = (u / temperature).astype(self.kind), np.ascontiguousarray(x.T.astype(self.kind))
        self.slack = (u.shape[1] + 16) * float(np.finfo(self.kind).eps) * self.norm * self.reach + 2.0 * 10.0 ** -decimals

    def tile(self, rows: np.ndarray, a: int, b: int) -> np.ndarray:
        return self.left[rows] @ self.right[:, a:b]

    def pairs(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        for a in range(0, len(r), PAIRS):
            out[a:a + PAIRS] = (self.u[r[a:a + PAIRS]] * self.x[c[a:a + PAIRS]]).sum(axis=1)
        return np.round(out / self.temperature, self.decimals)

    def dense(self, rows: np.ndarray, a: int, b: int, tile: np.ndarray) -> np.ndarray:
        return np.round(self.u[rows] @ self.x[a:b].T / self.temperature, self.decimals)


class Matrix:
    """Scores of a model, exact as they come. `matrix(rows, a, b)` gives those of some users and the items from a to b."""

    def __init__(self, matrix, n_users: int, decimals: int):
        self.tile, self.decimals, self.kind, self.slack = matrix, decimals, np.float64, np.zeros(n_users)

    def dense(self, rows, a, b, tile):
        return tile


class Tally:
    """Sum over all scores t of what the edges weigh: twice the weight of those below t, once that of those equal to it."""

    def __init__(self, edges: np.ndarray, weight: np.ndarray, decimals: int, bound: float, pairs: int):
        self.scale, most = 10.0 ** decimals, bound * 10.0 ** decimals + 2
        self.kind = np.int32 if most < 2**31 - 1 else np.int64 if most < 2**52 else np.float64
        scaled = np.rint(edges * self.scale)
        inside = np.abs(scaled) <= most if self.kind is np.int32 else np.ones(len(edges), bool)
        low = scaled < -most
        self.always = int(weight[low & ~inside].sum())            # edges below all scores
        self.edges, self.weight = (edges if self.kind is np.float64 else scaled[inside].astype(self.kind)), weight[inside]
        self.held = np.empty(min(pairs, max(LEAST_SORTED, min(MOST_SORTED, 32 * len(edges)))) or 1, self.kind)
        self.n, self.sum = 0, 0

    def add(self, t: np.ndarray, decimals: int) -> None:
        if self.kind is not np.float64:
            x = t * self.scale
            x = np.rint(x, out=x).ravel()
        else:
            x = np.round(t, decimals).ravel()
        at = 0
        while at < len(x):
            take = min(len(x) - at, len(self.held) - self.n)
            self.held[self.n:self.n + take] = x[at:at + take]
            self.n, at = self.n + take, at + take
            if self.n == len(self.held):
                self.flush()

    def flush(self) -> int:
        if self.n:
            x = self.held[:self.n]
            x.sort()
            at = np.searchsorted(x, self.edges, "left") + np.searchsorted(x, self.edges, "right")
            self.sum += int((self.weight * (2 * self.n - at)).sum()) + 2 * self.n * self.always
            self.n = 0
        return self.sum


def _count(mask: np.ndarray) -> np.ndarray:
    bits = np.packbits(mask, axis=1)
    if bits.shape[1] % 8 == 0:
        bits = bits.view(np.uint64)
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


class Scan:
    """What a cell gives back: the k best of each leading row, and where its positives stand among the cell's items.

    Items are sorted by block; `blocks` has where each begins and ends, `need` (rows x blocks) which a row visits, and
    `order` each item's place by id, which settles equal scores. Row r has `per[r]` positives, one after the other in
    `own` (their scores in each view, exact); `column` is a positive's own place among the items (-1: elsewhere) and
    `before` the number of the cell's items with a smaller id. A view is score + weight x prior, lists follow the first.
    """

    def __init__(self, score, blocks: Sequence[tuple[int, int]], need: np.ndarray, order: np.ndarray, prior: np.ndarray | None = None,
                 weights: Sequence[float] = (0.0,)):
        self.score, self.blocks, self.need, self.order, self.weights = score, list(blocks), need, order, list(weights)
        self.prior = np.zeros(len(order)) if prior is None else prior
        top = float(np.abs(self.prior).max(initial=0.0))
        eps = float(np.finfo(score.kind).eps)
        size = getattr(score, "norm", 0.0) * getattr(score, "reach", 0.0)
        self.slack = [score.slack + ((2.0 * 10.0 ** -score.decimals + 16 * eps * (abs(w) * top + size)) if w else 0.0) for w in self.weights]
        # scores in double precision are compared in single precision, which moves half the bytes, with room for that
        self.narrow = isinstance(score, Dots) and score.kind is np.float64 and float(np.max(size, initial=0.0)) + top * max(map(abs, self.weights)) < 1e18
        if self.narrow:
            self.slack = [x + 4 * float(np.finfo(np.float32).eps) * (abs(w) * top + size) for x, w in zip(self.slack, self.weights)]
        self.kind = np.float32 if self.narrow else score.kind
        self.shift = [(w * self.prior).astype(self.kind) if w else None for w in self.weights]

    def _exact(self, v: int, s: np.ndarray, c: np.ndarray | slice) -> np.ndarray:
        w = self.weights[v]
        return np.round(s + w * self.prior[c], self.score.decimals) if w else s

    def _pairs(self, v: int, rows, r, at, col, s):
        """Exact scores of single pairs of a tile (row r of it, item `col`)."""
        one = s[r, col - at].astype(np.float64) if isinstance(self.score, Matrix) else self.score.pairs(rows[r], col)
        return self._exact(v, one, col)

    def run(self, k: int = 0, lead: np.ndarray | None = None, theta: np.ndarray | None = None, per: np.ndarray | None = None,
            own: np.ndarray | None = None, column: np.ndarray | None = None, before: np.ndarray | None = None, tally: Tally | None = None):
        """((row, item, score) of lists, higher, tied, tied_before): counts by positive and view."""
        if tally is not None and self.score.kind is np.float32:
            raise ValueError("scores in single precision can't be told from the edges")
        m = len(self.need)
        self.theta = np.full(m, -np.inf) if theta is None else theta.astype(np.float64).copy()
        lead = np.ones(m, bool) if lead is None else lead
        per = np.zeros(m, np.int64) if per is None else per
        start = np.cumsum(per) - per
        shape = (int(per.sum()), len(self.weights))
        higher, tied, tied_before = (np.zeros(shape, np.int64) for _ in range(3))
        by, lists = np.argsort(-per, kind="stable"), []
        for a in range(0, m, TILE_USERS):
            rows, found = by[a:a + TILE_USERS], []
            for j, (lo, hi) in enumerate(self.blocks):
                mine = rows[self.need[rows, j]]
                if not len(mine):
                    continue
                first = np.flatnonzero(lead[mine])
                for c in range(lo, hi, TILE_ITEMS):
                    d, dense = min(c + TILE_ITEMS, hi), None
                    s = self.score.tile(mine, c, d)
                    if tally is not None and len(first):
                        part = s if len(first) == len(mine) else s[first]
                        # as in the exact scores, the dot product is rounded before the prior is added
                        tally.add(part if self.shift[0] is None else self._exact(0, np.round(part, self.score.decimals), slice(c, d)), self.score.decimals)
                    if self.narrow:
                        s = s.astype(np.float32)
                    for v in range(len(self.weights)):
                        t = s if self.shift[v] is None else s + self.shift[v][c:d]
                        if v == 0 and len(first):
                            part = t if len(first) == len(mine) else t[first]
                            if k:
                                self._best(found, k, mine, first, part, s, c, d)
                        if shape[0]:
                            self._places(v, mine, t, s, c, d, per, start, own, column, before, higher, tied, tied_before)
                if k and sum(len(x[0]) for x in found) > 4 * k * len(rows) + 4096:
                    found = [self._cut(found, k)]
            if k and found:
                lists.append(self._cut(found, k))
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return tuple(np.concatenate(x) for x in zip(none, *lists)), higher, tied, tied_before

    def _best(self, found, k, mine, first, part, s, c, d):
        rows, width = mine[first], d - c
        slack = self.slack[0][rows]
        cut = self.theta[rows]
        if width >= k and np.isneginf(cut).any():
            fresh = np.flatnonzero(np.isneginf(cut))
            kth = np.partition(part[fresh], width - k, axis=1)[:, width - k].astype(np.float64)
            cut[fresh] = kth - slack[fresh]
            self.theta[rows] = cut
        hit = np.flatnonzero(part >= (cut - slack).astype(part.dtype)[:, None])
        if not len(hit):
            return
        if len(hit) > 8 * k * len(rows) and len(hit) > part.size / 16:
            exact = self._exact(0, self.score.dense(rows, c, d, s[first]), slice(c, d))
            keep = min(k, width)
            by_id = np.argsort(self.order[c:d], kind="stable")
            col = by_id[best(exact[:, by_id], keep)]
            r, value, col = np.repeat(np.arange(len(rows)), keep), np.take_along_axis(exact, col, 1).ravel(), col.ravel() + c
        else:
            r, col = hit // width, hit % width + c
            value = self._pairs(0, mine, first[r], c, col, s)
        ok = value >= cut[r]
        found.append((rows[r[ok]], col[ok], value[ok]))

    def _cut(self, found, k):
        r, c, v = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((self.order[c], -v, r))
        r, c, v = r[by], c[by], v[by]
        new = np.r_[True, r[1:] != r[:-1]] if len(r) else np.empty(0, bool)
        at = np.flatnonzero(new)
        nth = np.arange(len(r)) - np.repeat(at, np.diff(np.append(at, len(r))))
        last = nth == k - 1
        self.theta[r[last]] = np.maximum(self.theta[r[last]], v[last])
        ok = nth < k
        return r[ok], c[ok], v[ok]

    def _places(self, v, mine, t, s, c, d, per, start, own, column, before, higher, tied, tied_before):
        n, slack, j, dense = per[mine], self.slack[v][mine], 0, None
        while True:
            m = int(np.searchsorted(-n, -j))                       # rows with more than j positives come first
            if not m:
                return
            p = start[mine[:m]] + j
            mark = own[p, v]
            above = t[:m] > (mark + slack[:m]).astype(t.dtype)[:, None]
            not_below = t[:m] >= (mark - slack[:m]).astype(t.dtype)[:, None]
            sure = _count(above)
            near = _count(not_below) - sure
            higher[p, v] += sure
            rows = np.flatnonzero(near)
            if near.sum() > m * (d - c) / 32:
                if dense is None:
                    dense = self._exact(v, self.score.dense(mine, c, d, s), slice(c, d))
                here = np.flatnonzero((column[p] >= c) & (column[p] < d))
                y, over = dense[:m], None
                over, same = y > mark[:, None], y == mark[:, None]
                over[here, column[p[here]] - c] = same[here, column[p[here]] - c] = False      # an item is not compared with itself
                higher[p, v] += over.sum(axis=1) - sure
                tied[p, v] += same.sum(axis=1)
                if before is not None:
                    tied_before[p, v] += (same & (self.order[c:d] < before[p][:, None])).sum(axis=1)
            elif len(rows):
                r, col = np.nonzero(not_below[rows] ^ above[rows])
                r, col = rows[r], col + c
                ok = col != column[p[r]]
                r, col = r[ok], col[ok]
                y = self._pairs(v, mine, r, c, col, s)
                over, same = y > mark[r], y == mark[r]
                higher[p, v] += np.bincount(r[over], minlength=m)
                tied[p, v] += np.bincount(r[same], minlength=m)
                if before is not None:
                    early = same & (self.order[col] < before[p[r]])
                    tied_before[p, v] += np.bincount(r[early], minlength=m)
            j += 1
