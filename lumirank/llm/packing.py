"""Best-fit packing of token pieces by exact complements of length counts."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumirank.session import stable

CAPACITY = 2048
END = 0                       # id appended to every document
STRETCH_MEMO = 400_000        # stretches whose ids a task's process remembers; then it starts anew

# Unicode White_Space. The byte-level pre-tokenizer never joins what stands on the two sides of these
# cuts: before a blank that precedes a non-blank, and between white space and what follows it
_STRETCH = re.compile(" ?[^\t-\r \x85\xa0  -     　]+|[\t-\r \x85\xa0  -     　]+(?![^\t-\r \x85\xa0  -     　])|[\t-\r \x85\xa0  -     　]+")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Ids of a byte-level BPE file as the tokenizers library gives them.

    New stretches of text are encoded once and remembered. Where the file's ids are in merge
    order, as ranks, tiktoken encodes them (the same merges, a quicker loop; checked against
    tokenizers on a probe when loaded); other files are encoded by tokenizers, as are texts
    that hold an added token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        self.added = [t["content"] for t in j.get("added_tokens", [])]
        self.fast = self._ranks(j)
        self._forget()

    def _ranks(self, j: dict):
        import public_tokenizers
        import tiktoken

        pre, model, of = j["pre_tokenizer"] or {}, j["model"], _byte_of_char()
        if (j["normalizer"] is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or model["type"] != "BPE" or model.get("ignore_merges") or model.get("end_of_word_suffix")):
            return None
        ranks = {}
        for token, i in model["vocab"].items():
            if token not in self.added:
                if not all(c in of for c in token):
                    return None
                ranks[bytes(of[c] for c in token)] = i
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids) or (ids and ids[0] < 256):
            return None
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = "The quick  brown\n\n fox's 123 été été, ½ 日本語 😀 \t x  \n"
        if enc.encode_ordinary(probe) != self.tk.encode(probe, add_special_tokens=False).ids:
            return None
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        return enc

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.end = np.zeros(STRETCH_MEMO + 1, np.int64)

    def _learn(self, stretches: list[str]) -> None:
        n = len(self.memo)
        at = int(self.end[n])
        # all at once: a stretch starts with a blank or is set apart by a line end, which is a token of its
        # own; the tokens' lengths in bytes tell where each stretch ends. White space is encoded on its own
        solid = [s for s in stretches if not s.isspace()]
        blank = [s for s in stretches if s.isspace()]
        order = solid + blank
        parts = []
        if solid:
            apart = np.array([s[0] != " " for s in solid])
            ids = np.array(self.fast.encode_ordinary("".join(s if s[0] == " " else "\n" + s for s in solid)), np.int64)
            ends = np.cumsum([len(s.encode()) for s in solid] + apart)
            cuts = np.searchsorted(np.cumsum(self.size[ids]), ends, side="left") + 1
            begin = np.concatenate([[0], cuts[:-1]]) + apart
            parts = [ids[x:y] for x, y in zip(begin.tolist(), cuts.tolist())]
        parts += [np.array(self.fast.encode_ordinary(s), np.int64) for s in blank]
        ids = np.concatenate(parts)
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.uint32)])
        self.flat[at:at + len(ids)] = ids
        if n + len(order) >= len(self.end):
            self.end = np.concatenate([self.end, np.zeros(max(len(self.end), len(order)), np.int64)])
        self.end[n + 1:n + 1 + len(order)] = at + np.cumsum([len(p) for p in parts])
        self.memo.update(zip(order, range(n, n + len(order))))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        split = []
        for i, t in enumerate(texts):
            if self.fast is None or any(a in t for a in self.added):
                out[i] = np.array(self.tk.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                split.append((i, _STRETCH.findall(t)))
        need = set().union(*[s for _, s in split]) if split else set()
        new = [s for s in need if s not in self.memo]
        if len(self.memo) + len(new) > STRETCH_MEMO and self.memo:
            self._forget()
            new = list(need)
        if new:
            self._learn(new)
        for i, parts in split:
            c = np.fromiter(map(self.memo.__getitem__, parts), np.int64, len(parts))
            start = self.end[c]
            size = self.end[c + 1] - start
            total = int(size.sum())
            out[i] = self.flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)]
        return out


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    """One a process: its memo is reused by the tasks that follow."""
    return ByteTokens(path)


PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
         ("__part", T.IntegerType()), ("__nth", T.LongType())]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones but for the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with its place among the task's pieces of that length. Written once, as the places must not change."""
    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string"))
    schema = T.StructType([src.schema[0]] + [T.StructField(n, t) for n, t in PIECE])

    def run(batches):
        encode = byte_tokens(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sub = batch.slice(at, 256)
                rows, cols = [], [[] for _ in PIECE]
                for r, ids in enumerate(encode([t or "" for t in sub.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append(r)
                        for c, v in zip(cols, (k, start, length, zlib.crc32(ids[start:start + length].tobytes()), part, seen[length])):
                            c.append(v)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([sub.column(0).take(pa.array(rows, pa.int32()))]
                                                 + [pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:])], schema=arrow)

    return stable(src.mapInArrow(run, schema))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how many in a sequence) and how many sequences follow each; uses every piece once.

    From the longest length on, the gap it leaves is looked up among the single lengths, the
    sums of two and the sums of three that are still there; what is found is used as often as
    the counts allow. Lengths that no combination completes are then packed best-fit: the
    longest that still fits, until none does. Work depends on the capacity, not on the counts.
    """
    c = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        c[length] = n
    out: list[tuple[dict[int, int], int]] = []

    def take(parts: list[int]) -> None:
        need = {x: parts.count(x) for x in parts}
        times = min(int(c[x]) // k for x, k in need.items())
        for x, k in need.items():
            c[x] -= k * times
        out.append((need, times))

    def two(gap: int, left: np.ndarray) -> list[int] | None:
        # larger half first; equal halves need two pieces
        lo = (gap + 1) // 2
        a = np.arange(gap - 1, lo - 1, -1)
        if not len(a):
            return None
        ok = (left[a] > 0) & (left[gap - a] > 0) & ((a != gap - a) | (left[a] > 1))
        hit = np.flatnonzero(ok)
        return [int(a[hit[0]]), int(gap - a[hit[0]])] if len(hit) else None

    def complement(length: int) -> list[int] | None:
        left = c.copy()
        left[length] -= 1
        gap = capacity - length
        if gap == 0:
            return []
        if left[gap] > 0:
            return [gap]
        if pair := two(gap, left):
            return pair
        for a in np.flatnonzero(left[:gap] > 0)[::-1]:
            a = int(a)
            if 3 * a < gap:
                break
            left[a] -= 1
            pair = two(gap - a, left)
            left[a] += 1
            if pair:
                return [a, *pair]
        return None

    for length in range(capacity, 0, -1):
        while c[length] > 0 and (rest := complement(length)) is not None:
            take([length, *rest])
    for length in range(capacity, 0, -1):
        while c[length] > 0:
            parts, gap, left = [length], capacity - length, c.copy()
            left[length] -= 1
            while gap > 0 and len(fits := np.flatnonzero(left[:gap + 1] > 0)):
                x = int(fits[-1])
                k = min(int(left[x]), gap // x)
                parts += [x] * k
                left[x] -= k
                gap -= k * x
            take(parts)
    return out


def _slots(patterns, capacity: int):
    """Per length, runs of its pieces: (length, first rank, pieces a sequence, first sequence, offset)."""
    used = [0] * (capacity + 1)
    first = 0
    rows = []
    for need, times in patterns:
        offset = 0
        for length, k in sorted(need.items(), reverse=True):
            rows.append((length, used[length], k, first, offset))
            used[length] += k * times
            offset += k * length
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are encoded where they are read. Pieces of one length are interchangeable, so only the
    count of each length (at most `capacity` numbers) goes to the driver, and the plan made of
    them (bounded by the capacity too) goes to the tasks; a piece finds its sequence from its rank
    among the pieces of its length, which is its place in its task plus the pieces of earlier tasks.
    A null or empty text is one piece of the end id. Repeated ids and rows are packed like others.
    """
    pieces = pieces_of(docs, tokenizer_path, id_col, text, capacity)
    per_task = pieces.groupBy(F.col("length").alias("__l"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = per_task.withColumn("__before", F.coalesce(F.sum("__n").over(
        W.partitionBy("__l").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = {r["__l"]: r["n"] for r in per_task.groupBy("__l").agg(F.sum("__n").alias("n")).collect()}
    slots = _slots(plan(counts, capacity), capacity)
    ranked = (pieces.join(before, (F.col("length") == F.col("__l")) & (F.col("__part") == F.col("__p")))
              .select(id_col, "piece", "start", "length", "ids_crc32", (F.col("__nth") + F.col("__before")).alias("__rank")))
    schema = T.StructType(ranked.schema.fields[:5] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        shift = np.int64(1) << np.int64(48)
        keys = slots[:, 0] * shift + slots[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            s = slots[np.searchsorted(keys, length * shift + rank, side="right") - 1] if len(rank) else slots[:0]
            nth = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)]
                                             + [pa.array(s[:, 3] + nth // np.maximum(s[:, 2], 1)), pa.array(s[:, 4] + nth % np.maximum(s[:, 2], 1) * length)],
                                             schema=to_arrow_schema(schema))

    return ranked.mapInArrow(run, schema)
