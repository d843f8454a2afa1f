"""Secret scans: fixed patterns, and password guess-cost of values that stand in a credential context."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lumirank.llm.base import map_text
from lumirank.operators.ordering import with_row_number
from lumirank.session import stable

# fixed values: the patterns of the scan and the shortest match of each kind
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")          # the runs of [0-9a-f] that have 16 or more
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

# wider contexts, whose values are only reported when they cost many guesses
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client)[_-]?(?:key|secret))["']?\s*(?::|=>|=|\bis\b)\s*["']?([^\s"'<>]{8,})""", re.I | re.A)
MIN_LOG_GUESSES = 10.0        # log10 of the guesses from which a value counts as a secret

# fixed values: frequent password words, most frequent first, and the rows of a keyboard
WORDS = ("password pass admin welcome letmein login user test guest root master dragon monkey shadow sunshine princess "
         "football baseball superman batman qwerty secret token default change changeme hello love money summer winter "
         "spring autumn monday friday january december server database example sample dummy value key the and for with").split()
# the corpus's own words, by the number of documents that have them: bounds of what reaches the driver and every task
TOP_WORDS, ALL_WORDS = 50_000, 200_000     # a language, and of all languages
MIN_DOCS = 2
LETTERS = re.compile(r"(?<!\w)[^\W\d_]{3,40}(?!\w)")
_FLUSH = 500_000              # words held per task before they are sent on
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
_SPAN_MOST = 64               # keys of a walk or times of a repeat from either end of a long stretch that are tried one by one
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)?\d\d)")


def learn_words(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, int]:
    """Ranks of the words of all texts: within each language by the documents that have the word, the best rank of a word counts.

    Words are runs of 3 to 40 letters, lower-cased, in at least MIN_DOCS documents; what stands in a credential context
    doesn't count, so a secret that is repeated is no word. At most TOP_WORDS a language (rows without one are a language
    of their own) and ALL_WORDS in all, of the best ranks, reach the driver.
    """
    def count(batches):
        held: dict[str, Counter] = {}

        def rows():
            for name, words in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(list(words), pa.string()),
                                                  pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(name, Counter()).update(set(LETTERS.findall(CONTEXT.sub(" ", t).lower())))
                if sum(map(len, held.values())) > _FLUSH:
                    yield from rows()
        yield from rows()

    src = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")), F.col(f"`{text}`").cast("string").alias("text")).filter("text IS NOT NULL")
    counts = src.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_DOCS)
    # written once: languages of very many words are ranked in ranges, which reads the counts again
    placed = with_row_number(stable(counts), ["lang"], [F.desc("n"), F.asc("word")], "place", hot_rows=TOP_WORDS)
    best = placed.filter(F.col("place") <= TOP_WORDS).groupBy("word").agg(F.min("place").alias("place"))
    return {r["word"]: r["place"] for r in best.orderBy("place", "word").limit(ALL_WORDS).collect()}


class Ranks:
    """The password list beside a corpus's words; a word of both has the better rank."""

    def __init__(self, words: dict[str, int] | None = None):
        self.words, self.longest = words or {}, max(_LONGEST, max(map(len, words), default=0) if words else 0)

    def get(self, word: str) -> int | None:
        a, b = _RANK.get(word), self.words.get(word)
        return min(a, b) if a and b else a or b


_LISTED = Ranks()


def _neighbours(a: str, b: str) -> bool:
    (r1, k1), (r2, k2) = _PLACE.get(a, (9, 9)), _PLACE.get(b, (-9, -9))
    return abs(r1 - r2) <= 1 and abs(k1 - k2) <= 1 and a != b


def _sizes(least: int, most: int, inside: int) -> list[int]:
    """Sizes from least to most that are tried for a span which begins `inside` signs after a longer one of its kind.

    All while the stretch has up to _SPAN_MOST; in longer ones those near either end, and from starts deep inside only
    the longest: two spans that meet deep inside cost more than the one that covers both.
    """
    if most < least:
        return []
    if inside > _SPAN_MOST:
        return [most]
    if most <= 2 * _SPAN_MOST:
        return list(range(least, most + 1))
    return [*range(least, _SPAN_MOST + 1), *range(most - _SPAN_MOST, most + 1)]


def spans_from(value: str, ranks: Ranks):
    """Every (start, end, log10 of guesses) of the kinds of `log_guesses` but brute force, from every start."""
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    # how far a walk goes on from each key, the turns up to it, and how far each block length repeats
    walk, turns = [0] * n, [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        walk[i] = walk[i + 1] + 1 if _neighbours(low[i], low[i + 1]) else 0
    for i in range(1, n):
        turns[i] = turns[i - 1] + (low[i] in _PLACE and low[i - 1] in _PLACE and _PLACE[low[i]][0] != _PLACE[low[i - 1]][0])
    inside = 0
    for i in range(n):
        for length in range(3, min(ranks.longest, n - i) + 1):
            rank = ranks.get(plain[i:i + length])
            if rank:
                yield i, i + length, math.log10(rank) + ((value[i:i + length] != low[i:i + length]) + (low[i:i + length] != plain[i:i + length])) * math.log10(2)
        for length in range(4, min(10, n - i) + 1):
            if _DATE.fullmatch(value, i, i + length):
                yield i, i + length, math.log10(36500 if length > 4 else 120)
        inside = inside + 1 if i and walk[i - 1] else 0
        for keys in _sizes(4, walk[i] + 1, inside):
            yield i, i + keys, math.log10(47) + math.log10(keys) + (turns[i + keys - 1] - turns[i]) * math.log10(4)
    for block in (1, 2, 3, 4):
        same = [0] * (n + 1)              # from i on, how many signs equal those a block later
        for i in range(n - block - 1, -1, -1):
            same[i] = same[i + 1] + 1 if value[i] == value[i + block] else 0
        inside = 0
        for i in range(n):
            inside = inside + 1 if i and same[i - 1] else 0
            times = _sizes(3 if block == 1 else 2, same[i] // block + 1, inside)
            own = log_guesses(value[i:i + block], ranks) if times else 0.0
            for t in times:
                yield i, i + t * block, own + math.log10(t)


def log_guesses(value: str, ranks: Ranks | None = None) -> float:
    """log10 of the guesses the cheapest segmentation of the value takes.

    Dynamic programme over end positions. Spans: a word of the password list or of `ranks` (its rank, twice for capitals,
    twice for look-alike signs), a date (days of 100 years), a repeat of a block of 1 to 4 signs (the block's own cheapest
    cost times the number of repeats), a keyboard walk (start keys times length and turns), and brute force (the size of the
    character class per character). Every start offers all its spans (see `_sizes` for stretches
    of more than _SPAN_MOST). Each such span after the start doubles the guesses, for the ways to arrange them.
    """
    n, ranks = len(value), ranks or _LISTED
    best = [0.0] + [math.inf] * n
    spans: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    if n > 2:
        for i, end, cost in spans_from(value, ranks):
            spans[i].append((end, cost))
    for i, c in enumerate(value):
        best[i + 1] = min(best[i + 1], best[i] + math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33))
        for end, cost in spans[i]:
            best[end] = min(best[end], best[i] + cost + (math.log10(2) if i else 0.0))
    return best[n]


def scan(text: str, min_log_guesses: float = MIN_LOG_GUESSES, ranks: Ranks | None = None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start and then by the order of KINDS.

    `assign`, `access` and `hex` are the leftmost non-overlapping matches of their pattern that
    are long enough. `guess` spans are values in a wider credential context that cost at least
    `min_log_guesses` and don't overlap one of the others.
    """
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e in out)
    at = 0
    for m in CONTEXT.finditer(text):
        s, e = m.span(1)
        while at < len(base) and base[at][1] <= s:
            at += 1
        if not any(b < e and s < f for b, f in base[at:at + 3]) and log_guesses(text[s:e], ranks) >= min_log_guesses:
            out.append(("guess", s, e))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch covered by spans replaced by [KIND] of the first span there."""
    parts, at, i = [], 0, 0
    while i < len(spans):
        kind, s, e = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < e:
            i += 1
            e = max(e, spans[i][2])
        parts += [text[at:s], f"[{kind.upper()}]"]
        at = e
        i += 1
    return "".join(parts + [text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, text: str = "text", keep=None, min_log_guesses: float = MIN_LOG_GUESSES,
                 words: dict[str, int] | None = None) -> DataFrame:
    """Add `spans` (array of kind, start, end) and `masked` (the text without its secrets; null stays null).

    One map over whole texts, no shuffle; `words` of learn_words are broadcast, without them only the
    password list is known. A null or empty text has no spans.
    """
    known = docs.sparkSession.sparkContext.broadcast(words or {})

    def make():
        ranks = Ranks(known.value)

        def run(texts):
            spans = [scan(t or "", min_log_guesses, ranks) for t in texts]
            return (pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], _SPAN_ARROW),
                    pa.array([mask(t, x) if x else t for t, x in zip(texts, spans)], pa.string()))
        return run

    return map_text(docs, text, make, [("spans", SPAN), ("masked", T.StringType())], keep)
