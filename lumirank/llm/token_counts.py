"""Token counts with a digest cache: stored counts are joined, only distinct misses are encoded."""

from __future__ import annotations

import hashlib
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lumirank.llm.base import map_text
from lumirank.session import shared_dir, stable
from lumirank.sources import files

CACHE_FIELDS = "content_digest string, tokenizer_digest string, n_tokens long"
WORD_MEMO = 400_000           # words whose counts a task's process remembers; then it starts anew
_JOINED = 2_000               # unknown words encoded in one call

# Unicode White_Space: the tokenizer drops these, so no token spans one
_WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")

_memos: dict[str, dict[str, int]] = {}


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version: another of either misses the cache."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def splits_at_space(tokenizer) -> bool:
    """Whether white space separates words: its tokens vanish and texts are the sum of their words."""
    probe = "ab,c 　12é́ x's\n\tab  ab"
    whole = len(tokenizer.encode(probe, add_special_tokens=False))
    return whole == sum(len(tokenizer.encode(w, add_special_tokens=False)) for w in _WORD.findall(probe)) \
        and len(tokenizer.encode(" \n ", add_special_tokens=False)) == 0


def counter(path: str, digest: str):
    """A function from texts to token counts as the library gives them.

    A tokenizer that drops white space counts a text as the sum of its words, so each new
    word is encoded once and remembered. Texts that may hold a special string, and all
    texts of other tokenizers, are encoded whole.
    """
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    tk.no_truncation()
    tk.no_padding()
    by_word = splits_at_space(tk)
    specials = [t.content for t in tk.get_added_tokens_decoder().values()]
    plain = by_word and not any(_WORD.fullmatch(s) is None for s in specials)
    memo = _memos.setdefault(digest, {})

    def learn(words: list[str]) -> None:
        if len(memo) + len(words) > WORD_MEMO:
            memo.clear()
        for i in range(0, len(words), _JOINED):
            part = words[i:i + _JOINED]
            enc = tk.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            at = np.fromiter((o[0] for o in enc.offsets), np.int64, len(enc))
            memo.update(zip(part, np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(part)).tolist()))

    def count(texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        split: list[tuple[int, list[str]]] = []
        for i, t in enumerate(texts):
            if plain and not any(s in t for s in specials):
                split.append((i, _WORD.findall(t)))
            else:
                out[i] = len(tk.encode(t, add_special_tokens=False))
        words = set().union(*[w for _, w in split]) if split else set()
        new = [w for w in words if w not in memo]
        if new:
            learn(new)
        if len(memo) < len(words) or new and any(w not in memo for w in words):      # the memo started anew
            learn([w for w in words if w not in memo])
        for i, w in split:
            out[i] = sum(map(memo.__getitem__, w))
        return out

    return count


def new_cache(spark: SparkSession) -> str:
    """Folder for an empty cache in the shared folder."""
    path = os.path.join(shared_dir(spark), f"token-counts-{uuid.uuid4().hex}")
    spark.createDataFrame([], CACHE_FIELDS).write.parquet(path)
    hpath, fs = files.fs_of(spark, path)
    fs.deleteOnExit(hpath)
    return path


def content_digest(text: str = "text"):
    """sha256 of the text (null: empty) with runs of ASCII white space made one blank and the ends trimmed.

    Only meant for tokenizers that drop white space; for others use `sha2(text, 256)`.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return F.sha2(F.trim(F.regexp_replace(t, "[\\t-\\r ]+", " ")), 256)


def exact_digest(text: str = "text"):
    return F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: its id, `n_bytes` (UTF-8, null: 0) and `n_tokens`.

    1. Every text is digested; digests already in `cache` for this tokenizer need no encoding.
    2. Texts are grouped by digest, in the tasks first, so copies and repeated rows leave a task once;
       one text of each missing digest is encoded, and the counts are appended to the cache as one
       table write, which survives lost executors; a write that fails leaves nothing, and two writers
       of the same digest agree, so repeated cache rows are read as one.
    3. The digests are joined to the cache. Copies all carry one digest; AQE splits that key.
    Repeated ids and rows are kept; a null id is kept and its text counted.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tok = tokenizer_digest(tokenizer_path)
    key = content_digest if splits_at_space(Tokenizer.from_file(tokenizer_path)) else exact_digest
    src = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    digests = stable(src.select("__id", key("__text").alias("__digest"),
                                F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long").alias("n_bytes")))

    def stored():
        return (spark.read.schema(CACHE_FIELDS).parquet(cache).filter(F.col("tokenizer_digest") == tok)
                .groupBy(F.col("content_digest").alias("__digest")).agg(F.max("n_tokens").alias("n_tokens")))

    known = stored().select("__digest")
    # one text of each digest leaves a task; any of them will do, as equal digests mean equal counts
    texts = (src.select(key("__text").alias("__digest"), "__text").groupBy("__digest").agg(F.first("__text").alias("__text"))
             .join(known, "__digest", "left_anti"))

    def make():
        count = counter(tokenizer_path, tok)
        return lambda ts: [pa.array(count([t or "" for t in ts]), pa.int64())]

    counts = map_text(texts, "__text", make, [("n_tokens", T.LongType())], keep=["__digest"])
    (counts.select(F.col("__digest").alias("content_digest"), F.lit(tok).alias("tokenizer_digest"), "n_tokens")
     .write.mode("append").parquet(cache))
    return (digests.join(stored(), "__digest", "left")
            .select(F.col("__id").alias(id_col), "n_bytes", "n_tokens"))
