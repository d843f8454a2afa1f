"""Phrase collocations by weighted acyclic automata: shard counts, unions by prefix range, composed part lookups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumirank.llm import automata
from lumirank.llm.automata import Automaton, build, compose, union
from lumirank.operators.ordering import with_row_number
from lumirank.session import stable

SHARD_WORDS = 1_500_000       # words counted in one automaton of a task; more make more automata
RANGE_PATHS = 500_000         # paths meant for one prefix range, summed over all shards
PART_ROWS = 200_000           # frequent phrases in one lookup automaton, and candidates looked up at once
UNKNOWN = "und"

# A-Z to lower case; what ends a piece becomes a line feed, and tabs become blanks
_ENDS = b".,;:!?\n\x0b\x0c\r"
_MAP = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(_ENDS) + b" ")
_END = b"."                   # stands for the end of a piece; no word can be it


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, `.` where a piece ends."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_MAP)
    # only blanks and line feeds are left of what split() splits at
    return data.replace(b"\n", b" . ").split()


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Shard:
    """Words of one language as numbers of their own; 0 ends a piece."""

    def __init__(self):
        self.number, self.parts, self.size = _Numbers({_END: 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        if words:
            self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            self.parts.append(np.zeros(1, np.int32))
            self.size += len(words)

    def paths(self, depth: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """From every word on, the up to `depth` words of its piece: sorted, with counts."""
        words = sorted(self.number)
        rank = np.zeros(len(words), np.int64)
        rank[[self.number[w] for w in words]] = np.arange(1, len(words) + 1)
        rank[0] = 0
        at = rank[np.concatenate([*self.parts, np.zeros(depth, np.int32)])]
        n = len(at) - depth
        rows = np.empty((n, depth), np.int64)
        inside = np.ones(n, bool)
        for d in range(depth):
            inside = inside & (at[d:d + n] > 0)
            rows[:, d] = np.where(inside, at[d:d + n], 0)
        rows = rows[rows[:, 0] > 0]
        return words, *automata.sum_paths(rows, np.ones(len(rows), np.int64))


def _row(words, path) -> tuple[bytes, ...]:
    return tuple(words[i - 1] for i in path.tolist() if i)


def _cuts(words: list[bytes], paths: np.ndarray, bounds: list[tuple[bytes, ...]]) -> np.ndarray:
    """For each ascending bound, how many paths are below it."""
    out = []
    for bound in bounds:
        lo, hi = 0, len(paths)
        for d, word in enumerate(bound[:paths.shape[1]]):
            i = bisect_left(words, word)
            column = paths[lo:hi, d]
            known = i < len(words) and words[i] == word
            a = lo + int(np.searchsorted(column, i + 1))
            if not known:
                lo = hi = a
                break
            lo, hi = a, lo + int(np.searchsorted(column, i + 1, side="right"))
        out.append(lo)
    return np.array(out, np.int64)


def count_shards(docs: DataFrame, max_words: int, text: str, lang: str) -> DataFrame:
    """(lang, n_words, n_paths, sample, blob): count automata of the tasks' rows, built from sorted paths.

    A path's weight is how often it stands in the shard; the count of a phrase is the sum over all paths that
    begin with it. `sample` has every so many paths as words.
    """
    step, shard_words = max(1, RANGE_PATHS // 64), SHARD_WORDS

    def rows_of(lang, shard):
        words, paths, weights = shard.paths(max_words)
        if not len(paths):
            return []
        sample = [[w.decode("utf-8", "surrogatepass") for w in _row(words, p)] for p in paths[step // 2::step]]
        return [(lang, int(weights.sum()), len(paths), sample, build(words, paths, weights).dump())]

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_paths", T.LongType()),
                           T.StructField("sample", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("blob", T.BinaryType())])
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.string())), pa.binary()]

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

        shards: dict[str, _Shard] = {}
        held = 0
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split_words(t.as_py())
                shards.setdefault(name, _Shard()).add(words)
                held += len(words)
                if held >= shard_words:
                    big = max(shards, key=lambda k: shards[k].size)
                    held -= shards[big].size
                    if rows := rows_of(big, shards.pop(big)):
                        yield out(rows)
        for name, shard in shards.items():
            if rows := rows_of(name, shard):
                yield out(rows)

    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def prefix_ranges(shards: DataFrame) -> dict[str, list[tuple[bytes, ...]]]:
    """Per language the paths at which its ranges begin (but the first), so that a range gets about RANGE_PATHS
    paths. The driver holds some 4 paths of words a range, which is one of 125,000 paths."""
    keys = shards.select("lang", F.explode("sample").alias("path"))
    keep = keys.filter(F.pmod(F.xxhash64("path", F.lit(3)), F.lit(16)) == 0)
    per = keys.groupBy("lang").count().collect()                                  # one row per language
    if sum(r["count"] for r in per) <= 16 * 1024:
        keep = keys                                                               # few: all of them
    sampled: dict[str, list] = {}
    for r in keep.collect():
        sampled.setdefault(r["lang"], []).append(tuple(w.encode("utf-8", "surrogatepass") for w in r["path"]))
    paths = {r["lang"]: r["n"] for r in shards.groupBy("lang").agg(F.sum("n_paths").alias("n")).collect()}
    out = {}
    for name, n in paths.items():
        got, parts = sorted(sampled.get(name, [])), -(-n // RANGE_PATHS)
        out[name] = sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []
    return out


def frequent_phrases(shards: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """(lang, phrase, f): every phrase of up to `max_words` words that stands at least `min_count` times.

    Each shard's automaton is cut at the ranges' bounds; a range unites the cuts of all shards, adds up weights
    and sums them over prefixes. A prefix that goes on past a bound has a partial sum in each of its ranges.
    """
    bounds = prefix_ranges(shards)

    def cut(batches):
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = Automaton.load(blob.as_py())
                paths, weights = a.paths()
                at = np.r_[0, _cuts(a.words, paths, bounds[name]), len(paths)]
                for i in np.flatnonzero(np.diff(at)).tolist():
                    part = slice(int(at[i]), int(at[i + 1]))
                    piece = build(a.words, paths[part], weights[part])
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int32()), pa.array([piece.dump()], pa.binary())],
                                                     names=["lang", "range", "blob"])

    def total(table: pa.Table) -> pa.Table:
        words, paths, weights = union([Automaton.load(b.as_py()) for b in table.column("blob")])
        phrases, counts = [], []
        for d, first in enumerate(automata.prefixes(paths), 1):
            if not len(first):
                continue
            # a prefix of d words ends where the next one begins, or where shorter paths stand between
            stop = np.r_[first[1:], len(paths)]
            running = np.r_[0, np.cumsum(np.where(paths[:, d - 1] > 0, weights, 0))]
            f = running[stop] - running[first]
            edge = np.zeros(len(first), bool)
            edge[[0, -1]] = True                      # the only prefixes that can stand in other ranges too
            take = np.flatnonzero((f >= min_count) | edge)
            rows = paths[first[take], :d]
            phrases += [b" ".join([words[i - 1] for i in r]).decode("utf-8", "surrogatepass") for r in rows.tolist()]
            counts += f[take].tolist()
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(counts), pa.string()),
                         "phrase": pa.array(phrases, pa.string()), "f": pa.array(counts, pa.int64())})

    pieces = shards.select("lang", "blob").mapInArrow(cut, "lang string, range int, blob binary")
    partial = pieces.groupBy("lang", "range").applyInArrow(total, "lang string, phrase string, f long")
    return partial.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)


def lookup_automata(phrases: DataFrame, max_words: int) -> DataFrame:
    """(id, lang, first, blob): automata of sorted frequent phrases with their counts, PART_ROWS in each."""
    ordered = (phrases.select("lang", F.split("phrase", " ").alias("words"), "f")
               .repartitionByRange("lang", "words").sortWithinPartitions("lang", "words"))
    part_rows = PART_ROWS

    def run(batches):
        made = 0

        def out(name, rows):
            nonlocal made
            keys = [tuple(w.encode("utf-8", "surrogatepass") for w in r) for r, _ in rows]
            words = sorted({w for k in keys for w in k})
            number = {w: i for i, w in enumerate(words, 1)}
            paths = np.array([[number[w] for w in k] + [0] * (max_words - len(k)) for k in keys], np.int64)
            blob = build(words, paths, np.array([f for _, f in rows], np.int64)).dump()
            made += 1
            ident = (TaskContext.get().partitionId() << 33) + made
            return pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([name], pa.string()), pa.array([rows[0][0]], pa.list_(pa.string())),
                                               pa.array([blob], pa.binary())], names=["id", "lang", "first", "blob"])

        name, rows = None, []
        for batch in batches:
            for lang, words, f in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and (lang != name or len(rows) >= part_rows):
                    yield out(name, rows)
                    rows = []
                name = lang
                rows.append((words, f))
        if rows:
            yield out(name, rows)

    return ordered.mapInArrow(run, "id long, lang string, first array<string>, blob binary")


def look_up_parts(candidates: DataFrame, index: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, a, k, first, f): the counts of both parts of every cut of every candidate.

    A task writes the parts it asks for as one automaton for each lookup automaton that can hold them; their
    composition gives the counts. Requests are of bounded size and many may go to the same lookup automaton.
    """
    directory: dict[str, tuple[list, list]] = {}
    for r in index.select("lang", "first", "id").orderBy("lang", "first").collect():      # one row for PART_ROWS phrases
        firsts, ids = directory.setdefault(r["lang"], ([], []))
        firsts.append(tuple(r["first"]))
        ids.append(r["id"])
    part_rows = PART_ROWS

    def ask(batches):
        def out(wanted):
            for ident, parts in wanted.items():
                order = sorted(parts)
                words = sorted({w for p in order for w in p})
                number = {w: i for i, w in enumerate(words, 1)}
                paths = np.array([[number[w] for w in p] + [0] * (max_words - len(p)) for p in order], np.int64)
                # a path's weight is its place among the asked parts
                blob = build(words, paths, np.arange(1, len(order) + 1)).dump()
                who = [(i, *c) for i, p in enumerate(order) for c in parts[p]]
                cols = [pa.array([[w[j] for w in who]], pa.list_(t)) for j, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([blob], pa.binary()), *cols],
                                                 names=["id", "asked", "at", "lang", "phrase", "a", "k", "left"])

        wanted, held = {}, 0
        for batch in batches:
            for lang, phrase, a in zip(*[c.to_pylist() for c in batch.columns]):
                words = phrase.split(" ")
                firsts, ids = directory[lang]
                for k in range(1, len(words)):
                    for left, part in ((True, tuple(words[:k])), (False, tuple(words[k:]))):
                        ident = ids[max(0, bisect_right(firsts, part) - 1)]
                        key = tuple(w.encode("utf-8", "surrogatepass") for w in part)
                        wanted.setdefault(ident, {}).setdefault(key, []).append((lang, phrase, a, k, left))
                held += 1
            if held >= part_rows:
                yield from out(wanted)
                wanted, held = {}, 0
        yield from out(wanted)

    def answer(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked, counts = (Automaton.load(batch.column(j)[i].as_py()) for j in (0, 1))
                place, f = compose(asked, counts)
                of = np.zeros(int(place.max(initial=0)) + 1, np.int64)
                of[place] = f
                at, *rest = (batch.column(j).slice(i, 1).flatten() for j in range(2, 8))
                at = at.to_numpy(zero_copy_only=False) + 1
                found = pa.array(of[np.minimum(at, len(of) - 1)])
                yield pa.RecordBatch.from_arrays([*rest, found], names=["lang", "phrase", "a", "k", "left", "f"])

    requests = candidates.select("lang", "phrase", F.col("f").alias("a")).mapInArrow(
        ask, "id long, asked binary, at array<long>, lang array<string>, phrase array<string>, a array<long>, k array<int>, left array<boolean>")
    joined = requests.join(index.select("id", "blob"), "id")
    return joined.select("asked", "blob", "at", "lang", "phrase", "a", "k", "left").mapInArrow(
        answer, "lang string, phrase string, a long, k int, left boolean, f long")


def cut_score(a: str = "a", l: str = "l", r: str = "r") -> Column:
    """floor(10^6 a^2 / (l r)) of long columns, exact while 10^6 a^2 has at most 38 digits."""
    a, l, r = (f"CAST({c} AS DECIMAL(19, 0))" for c in (a, l, r))
    return F.expr(f"CAST(({a} * {a} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({l} * {r}) AS BIGINT)")


def mine_collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2_000, absorb: int = 50,
                      text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `max_words` words.

    Texts are lower-cased (A-Z) and split at punctuation and line ends into pieces, those at blanks and tabs into
    words; null and empty texts have none, a null language is `und`, and repeated rows count again. a is the
    phrase's count, l and r the counts of its parts at the cut with the least score, floor(10^6 a^2 / (l r)), the
    first such cut; n counts all words of the language. Phrases of fewer than `min_count` counts aren't candidates,
    nor do those stay that stand in a longer candidate with at least `absorb` percent of their count. Order: score
    and count descending, then phrase by bytes. Exact: all counts cover all rows, and products are decimals of 38
    digits.
    """
    shards = stable(count_shards(docs, max_words, text, lang))
    totals = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    phrases = stable(frequent_phrases(shards, max_words, min_count))
    index = stable(lookup_automata(phrases, max_words))
    candidates = phrases.filter(F.contains("phrase", F.lit(" ")))
    parts = look_up_parts(candidates, index, max_words)

    pairs = parts.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    cut = pairs.withColumn("score", cut_score()).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    absorbed = None
    words = F.split("phrase", " ")
    long_ = candidates.filter(F.size(words) > 2).select("lang", words.alias("w"), "f")
    inner = [F.struct(F.array_join(F.slice("w", i + 1, m), " ").alias("phrase"), (F.size("w") > m).alias("ok"), (F.size("w") >= i + m).alias("fits"))
             for m in range(2, max_words) for i in range(max_words - m + 1)]
    if inner:
        absorbed = (long_.select("lang", "f", F.explode(F.array(*inner)).alias("s")).filter("s.ok AND s.fits")
                    .groupBy("lang", F.col("s.phrase").alias("phrase")).agg(F.max("f").alias("longer")))
        cut = cut.join(absorbed, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))
    scored = cut.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    ranked = with_row_number(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], upper=candidates)
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
