"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of whole documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from lumirank.llm.base import bounded_sample, map_text

CHUNK, STEP = 512, 448        # bytes; neighbouring chunks share 64, every byte is in one or two
WIDTH = 8                     # bytes a filter spans; it is evaluated at every byte
FILTERS, EMBED = 16, 8
_PAIRS = WIDTH // 2
# where the filter stands at each of its places in a chunk: at the even bytes, then at the odd ones
_OFFSETS = np.concatenate([np.arange(0, CHUNK - WIDTH + 1, 2), np.arange(1, CHUNK - WIDTH + 1, 2)])


@dataclass
class ByteCNN:
    embed: np.ndarray         # 256 x EMBED
    conv: np.ndarray          # WIDTH x EMBED x FILTERS
    bias: np.ndarray          # FILTERS
    out: np.ndarray           # 2 * FILTERS: mean and maximum of the chunks' maxima
    out_bias: float

    def tables(self) -> list[np.ndarray]:
        """What two neighbouring bytes add to each filter, for each of the WIDTH / 2 pairs under it."""
        per = np.einsum("be,wef->wbf", self.embed, self.conv).astype(np.float32)
        return [(per[2 * j][:, None, :] + per[2 * j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(_PAIRS)]


def chunks_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded chunks (rows of CHUNK bytes) of all texts, and each chunk's text. An empty text has one chunk."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n = [max(1, -(-max(0, len(b) - (CHUNK - STEP)) // STEP)) for b in raw]
    rows = np.zeros((sum(n), CHUNK), np.uint8)
    r = 0
    for b, k in zip(raw, n):
        a = np.frombuffer(b, np.uint8)
        for i in range(k):
            piece = a[i * STEP:i * STEP + CHUNK]
            rows[r, :len(piece)] = piece
            r += 1
    return rows, np.repeat(np.arange(len(texts)), n)


def responses(rows: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Filter outputs: chunk x place x filter, the places in the order of _OFFSETS."""
    out = []
    for part in (rows, np.ascontiguousarray(rows[:, 1:-1])):
        pairs = part.view(">u2").astype(np.intp)
        places = pairs.shape[1] - _PAIRS + 1
        x = np.take(tables[0], pairs[:, :places], axis=0)
        for j in range(1, _PAIRS):
            x += np.take(tables[j], pairs[:, j:j + places], axis=0)
        out.append(x)
    return np.concatenate(out, axis=1) + bias.astype(np.float32)


def pooled(peaks: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean and maximum over each text's chunks."""
    starts = np.searchsorted(owner, np.arange(n))
    count = np.diff(np.append(starts, len(owner)))[:, None]
    return np.concatenate([np.add.reduceat(peaks, starts, axis=0) / count, np.maximum.reduceat(peaks, starts, axis=0)], axis=1)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def probabilities(texts: list[str | None], model: ByteCNN, tables: list[np.ndarray]) -> np.ndarray:
    rows, owner = chunks_of(texts)
    peaks = np.concatenate([np.maximum(responses(rows[i:i + 128], tables, model.bias).max(axis=1), 0)
                            for i in range(0, len(rows), 128)])
    return _sigmoid(pooled(peaks.astype(np.float64), owner, len(texts)) @ model.out + model.out_bias)


def train(texts: list[str | None], y: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 3) -> ByteCNN:
    """Adam on the mean cross-entropy over whole texts. With one label only (or no rows) the score is its smoothed share."""
    rng = np.random.default_rng(seed)
    share = (float(y.sum()) + 0.5) / (len(y) + 1.0)
    model = ByteCNN(rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.25, (WIDTH, EMBED, FILTERS)),
                    np.zeros(FILTERS), np.zeros(2 * FILTERS), float(np.log(share / (1 - share))))
    if len(y) == 0 or len(np.unique(y)) < 2:
        return model
    model.out = rng.normal(0, 0.1, 2 * FILTERS)
    moments = {k: [0.0, 0.0] for k in ("embed", "conv", "bias", "out", "out_bias")}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            rows, owner = chunks_of([texts[i] for i in pick])
            tables = model.tables()
            best = np.empty((len(rows), FILTERS), np.intp)
            peaks = np.empty((len(rows), FILTERS))
            for i in range(0, len(rows), 128):
                r = responses(rows[i:i + 128], tables, model.bias)
                best[i:i + 128] = r.argmax(axis=1)
                peaks[i:i + 128] = np.take_along_axis(r, best[i:i + 128][:, None, :], axis=1)[:, 0]
            live = peaks > 0
            peaks = np.maximum(peaks, 0)
            n = len(pick)
            x = pooled(peaks, owner, n)
            err = (_sigmoid(x @ model.out + model.out_bias) - y[pick]) / n
            count = np.bincount(owner, minlength=n)
            top = peaks >= x[owner, FILTERS:]
            ties = np.zeros((n, FILTERS))
            np.add.at(ties, owner, top)
            g_peak = err[owner, None] * (model.out[:FILTERS] / count[owner, None] + model.out[FILTERS:] * top / ties[owner])
            g_peak *= live
            window = rows[np.arange(len(rows))[:, None, None], _OFFSETS[best][:, :, None] + np.arange(WIDTH)]     # chunk, filter, byte
            e = model.embed[window]
            grads = {
                "out": x.T @ err + 1e-4 * model.out, "out_bias": err.sum(), "bias": g_peak.sum(axis=0),
                "conv": np.einsum("cf,cfwe->wef", g_peak, e) + 1e-5 * model.conv,
            }
            g_embed = np.zeros_like(model.embed)
            np.add.at(g_embed, window, g_peak[:, :, None, None] * model.conv.transpose(2, 0, 1)[None])
            grads["embed"] = g_embed
            step += 1
            for k, g in grads.items():
                mo = moments[k]
                mo[0] = 0.9 * mo[0] + 0.1 * g
                mo[1] = 0.999 * mo[1] + 0.001 * g * g
                move = rate * (mo[0] / (1 - 0.9 ** step)) / (np.sqrt(mo[1] / (1 - 0.999 ** step)) + 1e-8)
                setattr(model, k, getattr(model, k) - move)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3_000, **options) -> ByteCNN:
    """Train on whole texts of a bounded sample (`max_rows`, by a hash of doc_id) of the labelled documents.

    Null ids and labels are not used; a repeated id in `labels` takes the smallest of its labels.
    """
    marks = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("__quality")))
    sample = bounded_sample(marks, "doc_id", max_rows)
    got = docs.select("doc_id", "text").join(sample, "doc_id").orderBy("doc_id", "text").collect()
    return train([r["text"] for r in got], np.array([r["__quality"] for r in got], np.float64), **options)


def score(docs: DataFrame, model: ByteCNN, text: str = "text", threshold: float = 0.7, keep=None) -> DataFrame:
    """Add `score` (0 to 1, higher: good quality likelier) and `predicted` (1 from the threshold on).

    One map over whole texts, no shuffle. A null text reads as empty, which is one chunk of padding.
    """
    def make():
        tables = model.tables()

        def run(texts):
            p = np.concatenate([probabilities(texts[i:i + 64], model, tables) for i in range(0, len(texts), 64)])
            return p, (p >= threshold).astype(np.int32)
        return run

    return map_text(docs, text, make, [("score", T.DoubleType()), ("predicted", T.IntegerType())], keep)
