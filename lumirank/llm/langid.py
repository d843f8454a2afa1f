"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from lumirank.llm.base import map_text

TOP = 400                     # length of a profile, of languages and of documents
ORDERS = 3                    # n-grams of 1 to 3 characters
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")      # letters, and signs that only count as numbers (such as ½ and ²)
_FLUSH = 1_000_000            # n-grams held per task before they are counted together


@dataclass
class Profiles:
    """grams: sorted codes of every profile; ranks[i, j]: place of grams[i] in language j, or -1."""
    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def letter_words(text: str) -> list[str]:
    """Runs of letters (Unicode category L), lower-cased."""
    words = _WORDS.findall(text.lower())
    if "".join(words).isalpha():
        return words
    return [x for w in words for x in ("".join(c if c.isalpha() else " " for c in w)).split()]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a character) and counts of the 1- to 3-grams of the lower-cased words,
    each word padded with one blank on either side; n-grams of blanks alone don't count."""
    words = letter_words(text or "")
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    grams = np.concatenate([c[c != 32], two, (two[:-1] << 21) | c[2:]])
    return np.unique(grams, return_counts=True)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP) -> Profiles:
    """Profiles of the languages named in `lang`, counted over all rows whose lang and text are not null.

    Tasks send one row per language and n-gram they saw; the rank order (count descending,
    then code) is cut to `top` before anything reaches the driver.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches):
        held: dict[str, list] = {}

        def merged(parts):
            codes, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(inv, weights=np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = held.setdefault(name, [[], 0])
                codes, n = gram_counts(t)
                if len(codes):
                    parts[0].append((codes, n))
                    parts[1] += len(codes)
                if parts[1] > _FLUSH:
                    parts[0] = [merged(parts[0])]
                    parts[1] = len(parts[0][0][0])
                    if parts[1] > _FLUSH // 2:
                        codes, n = parts[0][0]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])
                        held[name] = [[], 0]
        for name, (parts, _) in held.items():
            if parts:
                codes, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("place", place).filter(F.col("place") <= top).collect()       # top rows a language
    langs = sorted({r["lang"] for r in best})
    grams = np.array(sorted({r["gram"] for r in best}), np.int64)
    ranks = np.full((len(grams), len(langs)), -1, np.int64)
    for r in best:
        ranks[np.searchsorted(grams, r["gram"]), langs.index(r["lang"])] = r["place"] - 1
    return Profiles(langs, grams, ranks)


def distances(text: str | None, p: Profiles, top: int = TOP) -> np.ndarray | None:
    """Out-of-place distance to each language as a share of the largest possible; None without letters."""
    codes, n = gram_counts(text)
    if not len(codes) or not p.langs:
        return None
    best = np.lexsort((codes, -n))[:top]
    at = np.searchsorted(p.grams, codes[best])
    at[at == len(p.grams)] = 0
    ranks = np.where((p.grams[at] == codes[best])[:, None], p.ranks[at], -1)
    off = np.where(ranks < 0, top, np.abs(ranks - np.arange(len(best))[:, None]))
    return off.sum(axis=0) / (top * len(best))


def predict(docs: DataFrame, p: Profiles, text: str = "text", keep=None, top: int = TOP) -> DataFrame:
    """Add `lang_pred` and `score` (1 - smallest distance, 0 to 1); one map over whole texts, no shuffle.

    Null texts, texts without a letter and an empty set of profiles give `und` with score 0.
    Equal distances go to the language that sorts first. Rows are kept as they are.
    """
    def make():
        def score(texts):
            names, scores = [], []
            for t in texts:
                d = distances(t, p, top)
                names.append(UNKNOWN if d is None else p.langs[int(d.argmin())])
                scores.append(0.0 if d is None else float(1.0 - d.min()))
            return names, scores
        return score

    return map_text(docs, text, make, [("lang_pred", T.StringType()), ("score", T.DoubleType())], keep)
