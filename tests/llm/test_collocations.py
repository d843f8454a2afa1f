import random
import re
from collections import Counter

import numpy as np
import pytest
from samples import DOC, empty, messy

from lumirank.llm import automata, collocations


def automaton(counts, depth):
    words = sorted({w for k in counts for w in k} | {b"zz"})
    number = {w: i for i, w in enumerate(words, 1)}
    keys = sorted(counts)
    paths = np.array([[number[w] for w in k] + [0] * (depth - len(k)) for k in keys], np.int64)
    return automata.build(words, paths, np.array([counts[k] for k in keys], np.int64))


def as_dict(words, paths, weights):
    return {tuple(words[i - 1] for i in p if i): w for p, w in zip(paths.tolist(), weights.tolist())}


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_automata_equal_dictionaries(monkeypatch, block):
    monkeypatch.setattr(automata, "BLOCK", block)
    rnd = random.Random(block)
    for _ in range(150):
        depth, letters = rnd.randint(1, 4), [b"%c" % x for x in range(97, 97 + rnd.randint(1, 6))]
        one, two = ({tuple(rnd.choice(letters) for _ in range(rnd.randint(1, depth))): rnd.choice([1, 1, 5, 300]) for _ in range(rnd.randint(1, 60))} for _ in range(2))
        a, b = (automata.Automaton.load(automaton(c, depth).dump()) for c in (one, two))
        assert as_dict(a.words, *a.paths()) == one
        assert as_dict(*automata.union([a, b])) == dict(Counter(one) + Counter(two))
        assert sorted(zip(*map(np.ndarray.tolist, automata.compose(a, b)))) == sorted((one[k], two[k]) for k in one if k in two)
        for d in range(1, a.depth):               # no two states of a level have the same arcs
            states = [tuple(tuple(x[d][i:j].tolist()) for x in (a.label, a.target, a.final)) for i, j in zip(a.start[d][:-1], a.start[d][1:])]
            assert len(set(states)) == len(states)


def test_equal_hashes_keep_states_apart(monkeypatch):
    monkeypatch.setattr(automata, "mix", lambda h: h & np.uint64(1))
    counts = {(b"a", b"x"): 1, (b"b", b"y"): 1, (b"c", b"x"): 1, (b"d", b"x"): 2, (b"d", b"y"): 1}
    a = automaton(counts, 2)
    assert as_dict(a.words, *a.paths()) == counts


def brute(rows, max_words=3, least=10, top=2000, absorb=50):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand, found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        longer = {}
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer.get(p[i:i + m], 0), a)
        for p, a in cand.items():
            if 100 * longer.get(p, 0) >= absorb * a:
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    words = "the of And élan naïve New york 1x x\x0by \x01a a日本 ß".split(" ")
    return [("".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rnd.randint(0, 40))),
             rnd.choice(["en", "en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("max_words, least", [(3, 10), (2, 3), (4, 5)])
def test_equal_brute_force(spark, monkeypatch, max_words, least):
    # many small shards, ranges and lookup automata
    for name, v in (("SHARD_WORDS", 200), ("RANGE_PATHS", 64), ("PART_ROWS", 20)):
        monkeypatch.setattr(collocations, name, v)
    rows = corpus(max_words)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = collocations.mine_collocations(df, max_words, least, top=25)
    assert sorted(map(tuple, got.collect())) == brute(rows, max_words, least, top=25)


def test_repeated_rows_ties_and_one_hot_language(spark):
    rows = [("New York City hall. New York City", "en")] * 40 + [("b a, a b", "en")] * 20 + [("x y", None)] * 9
    got = collocations.mine_collocations(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_tables(spark):
    assert collocations.mine_collocations(empty(spark)).count() == 0
    df = messy(spark).withColumnRenamed("spans", "phrase")
    rows = [(r.text, r.lang) for r in df.collect()] * 12
    for _ in range(11):
        df = df.union(messy(spark).withColumnRenamed("spans", "phrase"))
    got = collocations.mine_collocations(df)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert collocations.mine_collocations(spark.createDataFrame([(1, None, None, None, 0)], DOC)).count() == 0


def test_a_very_long_text(spark):
    rows = [("lo ng te xt " * 120_000, "en")]
    got = collocations.mine_collocations(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_scores_past_64_bits(spark):
    rows = [(10**15 + 7, 10**15 + 9, 10**15 + 7), (10**13, 3 * 10**14 + 1, 10**13 + 3), (10, 10, 10), (10**12 + 1, 10**15, 10**15 - 1)]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", collocations.cut_score())
    assert [r.s for r in df.collect()] == [10**6 * a * a // (x * y) for a, x, y in rows]
