"""Toxicity severity by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from lumirank.llm.base import bounded_sample, map_text

BITS = 18                     # word features are hashed to 2**BITS slots
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(cuts[k] - weights . x): one weight vector shared by all cuts."""
    weights: np.ndarray       # float32, 2**BITS
    cuts: np.ndarray          # increasing, one fewer than the grades


def features(text: str | None) -> np.ndarray:
    """Slots of the distinct lower-cased words; a feature is present or not."""
    words = set(WORD.findall((text or "").lower()))
    return np.unique(np.fromiter((zlib.crc32(w.encode()) & ((1 << BITS) - 1) for w in words), np.int64, len(words)))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _counts(xs: list[np.ndarray], positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per slot, the rows that have it: positive ones and all."""
    flat = np.concatenate(xs) if xs else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    return np.bincount(flat[positive[rows]], minlength=1 << BITS), np.bincount(flat, minlength=1 << BITS)


def _z_scores(xs: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """How far a slot's share of positive rows is from the overall share, in standard errors."""
    pos, seen = _counts(xs, positive)
    p = (positive.sum() + 0.5) / (len(positive) + 1.0)
    return (pos - p * seen) / np.sqrt(p * (1 - p) * np.maximum(seen, 1))


def grades_of(xs: list[np.ndarray], toxic: np.ndarray, levels: tuple[int, ...] = (2, 5),
              min_z: float = 6.0, min_share: float = 0.8) -> np.ndarray:
    """Severity grades for binary labels: 0 not toxic, else 1 and one more for each level of
    `levels` reached by the number of marked words. A word is marked when at least `min_share` of
    its rows are toxic and that lies at least `min_z` standard errors above the overall share."""
    if not xs:
        return np.empty(0, np.int64)
    yes = toxic == 1
    pos, seen = _counts(xs, yes)
    marked = (_z_scores(xs, yes) >= min_z) & (pos >= min_share * np.maximum(seen, 1))
    hits = np.array([int(marked[x].sum()) for x in xs])
    return np.where(yes, 1 + sum((hits >= v).astype(int) for v in levels), 0)


def fit_ordinal(xs: list[np.ndarray], grades: np.ndarray, n_grades: int, min_z: float = 4.5,
                l1: float = 2e-4, steps: int = 300) -> OrdinalModel:
    """Proximal gradient with momentum on the mean negative log-likelihood plus an L1 penalty.

    Only slots that differ from chance by `min_z` standard errors, for grade >= 1, may get a
    weight; the others keep 0, as do all when there are no rows or only one grade. The cuts
    then follow the share of each grade.
    """
    width, n = 1 << BITS, len(xs)
    share = (np.bincount(grades, minlength=n_grades)[:n_grades] + 0.5) / (n + 0.5 * n_grades)
    below = np.cumsum(share)[:-1]
    cuts = np.log(below / (1 - below))
    full = np.zeros(width, np.float32)
    if n == 0 or len(np.unique(grades)) < 2:
        return OrdinalModel(full, cuts)
    z = _z_scores(xs, grades > 0)
    flat = np.concatenate(xs)
    rows = np.repeat(np.arange(n), [len(x) for x in xs])
    ok = np.abs(z[flat]) >= min_z
    slots, cols = np.unique(flat[ok], return_inverse=True)
    rows = rows[ok]
    k = len(slots)

    def loss(v):
        theta = np.concatenate([[-np.inf], v[k] + np.concatenate([[0.0], np.cumsum(np.exp(v[k + 1:]))]), [np.inf]])
        s = np.bincount(rows, weights=v[cols], minlength=n)
        hi, lo = _sigmoid(theta[grades + 1] - s), _sigmoid(theta[grades] - s)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = -hi * (1 - hi) / p, lo * (1 - lo) / p
        g_t = (np.bincount(grades + 1, weights=d_hi, minlength=n_grades + 1)
               + np.bincount(grades, weights=d_lo, minlength=n_grades + 1))[1:-1]
        g = np.concatenate([np.bincount(cols, weights=(1.0 - hi - lo)[rows], minlength=k), [g_t.sum()],
                            [g_t[i + 1:].sum() * np.exp(v[k + 1 + i]) for i in range(n_grades - 2)]])
        return -np.log(p).mean(), g / n

    v = np.concatenate([np.zeros(k), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))])
    y, t, rate = v, 1.0, 1.0
    for _ in range(steps):
        f, g = loss(y)
        while True:
            new = y - rate * g
            new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * l1, 0.0)
            move = new - y
            if rate < 1e-8 or loss(new)[0] <= f + g @ move + move @ move / (2 * rate) + 1e-12:
                break
            rate /= 2
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, v, t, rate = new + (t - 1) / t_next * (new - v), new, t_next, rate * 1.1
    full[slots] = v[:k]
    return OrdinalModel(full, v[k] + np.concatenate([[0.0], np.cumsum(np.exp(v[k + 1:]))]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, levels: tuple[int, ...] = (2, 5)) -> OrdinalModel:
    """Fit on a bounded sample (`max_rows`, chosen by a hash of doc_id) of the labelled documents.

    Rows with a null id or label are not used; a repeated id in `labels` counts as toxic if any row says so.
    """
    marks = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
             .agg(F.max("toxic").alias("__toxic")))
    rows = bounded_sample(docs.select("doc_id", "text").join(marks, "doc_id"), "doc_id", max_rows)

    def make():
        return lambda texts: [[features(t).astype(np.int32).tobytes() for t in texts]]

    got = map_text(rows, "text", make, [("__x", T.BinaryType())], keep=["__toxic", "doc_id"]).orderBy("doc_id", "__x").collect()
    xs = [np.frombuffer(r["__x"], np.int32).astype(np.int64) for r in got]
    toxic = np.array([int(r["__toxic"] > 0) for r in got], np.int64)
    return fit_ordinal(xs, grades_of(xs, toxic, levels), len(levels) + 2)


def severity(docs: DataFrame, model: OrdinalModel, text: str = "text", keep=None) -> DataFrame:
    """Add `severity` (expected grade, 0 to the number of cuts), `grade` (most likely) and `p_toxic` (P(grade >= 1)).

    One map over whole texts, no shuffle. A null or empty text has no features and gets the
    model's base rate. Rows are kept as they are; a clashing column is replaced.
    """
    slots = np.flatnonzero(model.weights)
    values, cuts = model.weights[slots].astype(np.float64), model.cuts

    def make():
        w = np.zeros(1 << BITS)
        w[slots] = values

        def score(texts):
            s = np.array([w[features(t)].sum() for t in texts])
            above = 1.0 - _sigmoid(cuts[None, :] - s[:, None])
            p = -np.diff(np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1), axis=1)
            return above.sum(axis=1), p.argmax(axis=1), above[:, 0]
        return score

    return map_text(docs, text, make, [("severity", T.DoubleType()), ("grade", T.IntegerType()), ("p_toxic", T.DoubleType())], keep)
