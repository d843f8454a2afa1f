"""Operators that move documents: Jaccard groups, components, packing, fingerprints, search, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumirank.llm import fingerprints as fp, graph, jaccard, packing, search

from samples import DOC, ODD, empty, messy

public_tokenizers = pytest.importorskip("public_tokenizers")


def corpus(n, seed=5):
    """Bases with near copies of varying distance, exact copies, a shared passage and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(30)]
    docs = []
    while len(docs) < n:
        base = [word() for _ in range(rng.randint(20, 90))]
        docs.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
        if rng.random() < .4:
            docs.append(passage + [word() for _ in range(rng.randint(1, 40))])
    texts = [" ".join(d) for d in docs[:n]]
    texts += [texts[0], texts[0].upper(), texts[0].replace(" ", "\n\t "), "one two", "One  two", "one", "", None, " \n", "word " * 3_000]
    return list(enumerate(texts))


def groups_by_hand(rows, k=4, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = list(sets.items())
    for a, (i, s) in enumerate(items):
        for j, u in items[:a]:
            if s and u and den * len(s & u) >= num * len(s | u):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("blocks,k,num", [(1_000, 4, 85), (3, 5, 80)])
def test_jaccard_groups_against_all_pairs(spark, monkeypatch, blocks, k, num):
    rows = corpus(90)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", blocks)       # 3: components are cut into pairs of blocks
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", 17)
    monkeypatch.setattr(jaccard, "BUCKET_KEYS", 400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, k=k, num=num).collect()}
    assert got == groups_by_hand(rows, k, num)


def test_divide_skip_finds_every_component():
    rng = np.random.default_rng(3)
    for trial in range(30):
        base = rng.integers(0, 10**6, 60)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([.02, .08, .2]), rng.integers(0, 10**6, 60), base)).astype(np.uint64) for _ in range(40)]
        ids = np.arange(40) * 3
        side = rng.integers(0, 2, 40) if trial % 2 else None
        links = jaccard.linked_pairs(ids, sets, side, 85, 100)

        def comps(pairs):
            root = {int(i): int(i) for i in ids}
            for _ in range(40):
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            return root
        plain = [(int(ids[a]), int(ids[b])) for a in range(40) for b in range(a) if (side is None or side[a] != side[b])
                 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
        assert comps(links) == comps(plain) and len(links) <= len(plain)


def test_jaccard_edge_cases(spark):
    out = jaccard.similar_groups(messy(spark)).collect()
    assert len(out) == len(ODD) + 2
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in out)
    assert got[(0, 0, 0)] == got[(1, 0, 1)] == got[(2, 0, 2)] == 1 and got[(5, 1, 4)] == 1 and got[(None, 1, None)] == 1
    assert jaccard.similar_groups(empty(spark)).count() == 0
    alone = spark.createDataFrame([(None, None), (None, "a b c d"), (7, "a b c d")], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id) for r in jaccard.similar_groups(alone).collect() if r.component_id) == [(1, 7), (1, 7)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(9, 9)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != 9}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing_plan_uses_every_piece_once():
    rng = np.random.default_rng(4)
    for trial in range(20):
        cap = int(rng.choice([8, 50, 2048]))
        counts = Counter(int(x) for x in np.minimum(cap, np.maximum(1, rng.gamma(2, cap / 5, 3_000).astype(int))))
        patterns = packing.plan(dict(counts), cap)
        used = Counter()
        for need, times in patterns:
            assert times > 0 and sum(x * k for x, k in need.items()) <= cap
            for x, k in need.items():
                used[x] += k * times
        assert used == counts
        bound = -(-sum(x * n for x, n in counts.items()) // cap)
        assert sum(n for _, n in patterns) <= bound * 1.02 + 2
    # pair, triple and single complements are found before anything is left over
    assert sum(n for _, n in packing.plan({1000: 2, 1048: 2, 700: 1, 648: 1, 2048: 3})) == 6
    assert packing.plan({}) == [] and packing.plan({1: 5}) == [({1: 5}, 1)]


def test_byte_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk, own = Tokenizer.from_file(path), packing.ByteTokens(path)
    texts = [t or "" for t in ODD] + ["\x1c a\x1c\x1d", "　　b  c", "don't we'll\n\n\n'x", "a\n b", "\t\tx", " ", "a  <|endoftext|>", "½²³ 12"]
    assert own.fast is not None
    assert [a.tolist() for a in own(texts)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]
    own.fast = None                                            # the library's own way
    assert [a.tolist() for a in own(texts)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, out, tk, capacity=2048):
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    want = Counter()
    for i, t in rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0] + list(range(min(first, len(ids)), len(ids), capacity)) + [len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_packing_edge_cases(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = messy(spark).unionByName(messy(spark)).repartition(3)
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, path).collect(), Tokenizer.from_file(path))
    assert packing.pack(empty(spark), path).count() == 0


def naive_fingerprint(text):
    """The definition, k-mer by k-mer, with the module's hash of a k-mer."""
    n = max(1, len(text) - fp.K + 1) if text else 0
    seen, x = Counter(), []
    for i in range(n):
        part = text[i:i + fp.K]
        h = fp.kmers(fp._points(part))[0]
        nth = seen[part]
        seen[part] += 1
        x.append(fp.mix(np.array([h + np.uint64(nth) * fp._NUMBERED], np.uint64))[0] if nth else h)
    x = np.array(x, np.uint64)
    out = []
    for f in fp._FACTORS:
        best = sorted(sorted(range(n), key=lambda i: (x[i] * f, i))[:2])
        a = [x[i] for i in best] + [np.uint64(0)] * (2 - len(best))
        if len(best) == 1:
            a = [np.uint64(0), x[best[0]]]
        out.append(int(fp.mix(np.array([a[0] * fp._P + a[1] + np.uint64(1)], np.uint64))[0] >> np.uint64(32)))
    return out


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_fingerprints_follow_the_definition():
    texts = ["", "a", "abcdefghijk", "abcdefghijkl", "abcabcabcabcabcabcabcabcabc", "the quick brown fox jumps over the lazy dog " * 3, "é😀" * 30]
    for t in texts:
        assert fp.fingerprint(t).tolist() == naive_fingerprint(t), t
    for a in texts:
        for b in texts:
            f, e, other = fp.with_edit(a, b)
            q = len(a) // 4
            assert other == (a[:len(a) - q] + b[:q] if q else a)
            assert (f == fp.fingerprint(a)).all() and (e == fp.fingerprint(other)).all()
    rng = random.Random(1)
    base = [rng.choice("abcdefghij ") for _ in range(2_000)]
    near, moved, far = list(base), base[1_000:] + base[:1_000], [rng.choice("abcdefghij ") for _ in range(2_000)]
    near[1_000] = "#"
    like = [fp.likeness(fp.fingerprint("".join(base)), fp.fingerprint("".join(x))) for x in (base, near, moved, far)]
    assert like[0] == 1 and like[1] > .8 and like[3] < .1 and like[2] < like[1]        # the order of blocks counts


@pytest.mark.parametrize("rows_per_block", [1_000, 4])
def test_fingerprint_query(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(fp, "ROWS_PER_BLOCK", rows_per_block)
    rows = sorted([(r.doc_id if r.doc_id is not None else -2**63, r.text or "") for r in messy(spark).collect()])
    out = fp.fingerprint_with_edits(messy(spark)).collect()
    want = Counter()
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        f, e, other = fp.with_edit(t, following)
        want[(i if i != -2**63 else None, len(t), hashlib.sha256(other.encode()).hexdigest(), fp._hex(f), fp._hex(e), fp.likeness(f, e),
              fp.likeness(f, fp.fingerprint(following)))] += 1
    assert Counter(tuple(r) for r in out) == want
    assert fp.fingerprint_with_edits(empty(spark)).count() == 0
    one = fp.fingerprint_with_edits(spark.createDataFrame([(1, "abcdefgh" * 5)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_block_max_wand_equals_full_scoring(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = np.random.default_rng(8)
    for _ in range(60):
        lists = []
        for _ in range(int(rng.integers(1, 7))):
            d = np.unique(rng.integers(0, 80, int(rng.integers(1, 60))))
            lists.append((d, rng.choice([.5, 1.0, 1.5, 2.0], len(d)), float(rng.choice([.1, 1.0, 4.0]))))
        k, skip = int(rng.integers(1, 12)), int(rng.integers(0, 80))
        score = {}
        for d, v, w in lists:
            for a, b in zip(d.tolist(), v.tolist()):
                score[a] = score.get(a, 0.0) + w * b
        want = sorted(((s, d) for d, s in score.items() if d != skip), key=lambda x: (-x[0], x[1]))[:k]
        assert search.block_max_wand(lists, k, skip) == want


@pytest.mark.parametrize("shard", [4_000, 9])
def test_search_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD_ROWS", shard)
    rows = corpus(40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in search.search(df, df.filter("doc_id % 20 = 0"), k=5).collect())
    counts = {i: dict(zip(*(x.tolist() for x in c))) for (i, _), c in zip(rows, search.term_counts([t for _, t in rows]))}
    length = {i: sum(c.values()) for i, c in counts.items()}
    mean, n, df_ = sum(length.values()) / len(rows), len(rows), Counter(t for c in counts.values() for t in c)
    want = []
    for q in [i for i, _ in rows if i % 20 == 0]:
        terms = sorted((-float(search.idf(n, df_[t])) * (c * (search.K3 + 1) / (c + search.K3)), t) for t, c in counts[q].items() if df_[t] >= 2)[:16]
        scored = []
        for d in counts:
            hit = [(t, -w) for w, t in terms if t in counts[d]]
            if hit and d != q:
                scored.append((-sum(w * search.impact(counts[d][t], length[d], mean) for t, w in hit), d))
        want += [(q, k + 1, d, round(-s, 9)) for k, (s, d) in enumerate(sorted((round(s, 9), d) for s, d in scored)[:5])]
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in sorted(want)] and len(got) > 0
    assert sum(a[2] == b[2] for a, b in zip(got, sorted(want))) >= 0.9 * len(got)      # equal up to rounding inside ties


def whole_queries_by_hand(rows, k, weigh):
    """(query, rank) -> score over every term that two documents have, for the rows whose id 20 divides."""
    counts = {i: dict(zip(*(x.tolist() for x in c))) for (i, _), c in zip(rows, search.term_counts([t for _, t in rows]))}
    length = {i: sum(c.values()) for i, c in counts.items()}
    mean, n, df_ = sum(length.values()) / len(rows), len(rows), Counter(t for c in counts.values() for t in c)
    want = {}
    for q in [i for i, _ in rows if i % 20 == 0]:
        w = {t: float(search.idf(n, df_[t])) * weigh(c) for t, c in counts[q].items() if df_[t] >= 2}
        scores = [sum(w[t] * search.impact(c, length[d], mean) for t, c in counts[d].items() if t in w) for d in counts if d != q]
        want |= {(q, r + 1): s for r, s in enumerate(sorted((s for s in scores if s > 0), reverse=True)[:k])}
    return want


@pytest.mark.parametrize("shard", [4_000, 9])
def test_search_with_every_term_of_the_text(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD_ROWS", shard)
    rows = corpus(40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.query_id, r["rank"]): r.score for r in search.search(df, df.filter("doc_id % 20 = 0"), k=5, query_terms=None).collect()}
    assert got == pytest.approx(whole_queries_by_hand(rows, 5, lambda c: c * (search.K3 + 1) / (c + search.K3)))


def test_repeats_of_one_id_stay_within_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 50)
    inner = jaccard.linked_pairs

    def counted(ids, *rest):
        with open(f"{tmp_path}/{len(ids)}-{np.random.default_rng().integers(1 << 60)}", "w"):
            pass
        return inner(ids, *rest)
    monkeypatch.setattr(jaccard, "linked_pairs", counted)
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    rows = [(7, base)] * 900 + [(8, base + " more")] + [(9, f"{base} x{i}") for i in range(300)] + [(10, "something else entirely here")] * 40
    out = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(out) == len(rows) and {(r.doc_id, r.component_id) for r in out} == {(7, 7), (8, 7), (9, 7), (10, 10)}
    import os
    groups = [int(f.split("-")[0]) for f in os.listdir(tmp_path)]
    assert groups and max(groups) < 3 * 50


@pytest.mark.parametrize("block", [1, 3, 32])
def test_block_bounds_with_thresholds(monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(9)
    for _ in range(200):
        lists = []
        for _ in range(int(rng.integers(1, 40))):
            d = np.unique(rng.integers(0, 80, int(rng.integers(1, 60))))
            lists.append((d, rng.choice([.5, 1.0, 1.5, 2.0], len(d)), float(rng.choice([.1, 1.0, 4.0]))))
        term = np.repeat(np.arange(len(lists)), [len(d) for d, *_ in lists])
        index = search.BlockIndex(term, np.concatenate([d for d, *_ in lists]), np.concatenate([v for _, v, _ in lists]), len(lists), 80)
        total = np.zeros(80)
        for d, v, w in lists:
            total[d] += w * v
        k, skip, order, theta = int(rng.integers(1, 12)), np.unique(rng.integers(0, 80, int(rng.integers(0, 9)))), rng.permutation(80), float(rng.choice([0, total.mean(), total.max()]))
        want = [i for i in np.lexsort((order, -total)).tolist() if total[i] > 0 and total[i] >= theta and i not in skip][:k]
        docs, scores = index.best(np.arange(len(lists)), np.array([w for *_, w in lists]), k, order, skip, theta)
        assert docs.tolist() == want and scores.tolist() == total[want].tolist()


@pytest.mark.parametrize("min_df", [1, 2])
def test_results_do_not_depend_on_shards(spark, monkeypatch, min_df):
    rows = corpus(60) + [(20, "alpha beta"), (20, "alpha beta"), (20, "alpha beta gamma delta"), (21, "alpha gamma"), (None, "alpha beta gamma"), (None, None),
                         (9007199254740993, "beta gamma delta"), (9007199254740992, "beta gamma delta"), (40, ""), (60, None)] + [(77, "alpha beta copy")] * 15
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    for shard, growth in ((16_000, 4), (7, 4), (3, 2), (1, 4)):
        monkeypatch.setattr(search, "SHARD_ROWS", shard)
        monkeypatch.setattr(search, "GROWTH", growth)
        out = search.search(df, df.filter("doc_id % 20 = 0"), k=6, query_terms=None, k3=None, min_df=min_df).collect()
        assert not [r for r in out if r.query_id == r.doc_id]
        seen.append(sorted((r.query_id, r["rank"], repr(r.doc_id), round(r.score, 9)) for r in out))
    assert seen[0] == seen[1] == seen[2] == seen[3]
    counts = [(i, dict(zip(*(x.tolist() for x in c)))) for (i, _), c in zip(rows, search.term_counts([t for _, t in rows]))]
    length, n, df_ = [sum(c.values()) for _, c in counts], len(rows), Counter(t for _, c in counts for t in c)
    mean, want = sum(length) / n, []
    for q in {i for i, _ in rows if i is not None and i % 20 == 0}:
        ask = Counter()
        for i, c in counts:
            if i == q:
                ask.update(c)
        w = {t: float(search.idf(n, df_[t])) * c for t, c in ask.items() if df_[t] >= min_df}
        scored = [(-round(sum(w[t] * search.impact(c, length[j], mean) for t, c in d.items() if t in w), 9), (i is not None, i or 0), i) for j, (i, d) in enumerate(counts) if i != q]
        want += [(q, r + 1, repr(i), -s) for r, (s, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:6])]
    assert [x[:2] + x[3:] for x in seen[0]] == [x[:2] + x[3:] for x in sorted(want)]


def test_cells_of_shards_and_queries_are_bounded(spark, monkeypatch):
    """Packed rows and cells have a bound, a shuffle deals cells evenly, and results don't depend on either."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 900, 300)
    sizes[7] = search.ENTRIES + 5
    edges = search._upto(sizes)
    assert edges[0] == 0 and edges[-1] == len(sizes) and max(np.diff(edges)) <= search.PACKED
    assert all(sizes[a:b].sum() <= search.ENTRIES or b == a + 1 for a, b in zip(edges[:-1], edges[1:]))
    numbers = [np.sort(rng.choice(1 << 40, n, replace=False)) for n in (3, 1, 50)]
    counts, ids = rng.integers(1, 9, 54), np.array([-2**63, 2**63 - 1, 5])
    q, size, held, place, count = search._unpack(search._pack(ids, np.concatenate(numbers), counts, np.array([3, 1, 50])))
    assert q.tolist() == ids.tolist() and size.tolist() == [3, 1, 50] and held[place].tolist() == np.concatenate(numbers).tolist() and count.tolist() == counts.tolist()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = spark.createDataFrame([(x,) for x in search._labels(spark, 3 * parts)], "x int")
    assert labels.distinct().count() == 3 * parts
    assert {r["n"] for r in labels.groupBy((F.pmod(F.hash("x"), F.lit(parts))).alias("p")).agg(F.count("*").alias("n")).collect()} == {3}
    df, seen = spark.createDataFrame(corpus(60), "doc_id long, text string"), []
    for shard, cell, group in ((16_000, 1 << 16, 2), (3, 1, 2), (1, 2, 30)):
        for name, value in (("SHARD_ROWS", shard), ("CELL_QUERIES", cell), ("GROUP_SHARDS", group)):
            monkeypatch.setattr(search, name, value)
        out = search.search(df, df.filter("doc_id % 10 = 0"), k=4, query_terms=None, k3=None).collect()
        seen.append(sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in out))
    assert seen[0] and seen[0] == seen[1] == seen[2]


def test_search_of_a_very_long_text(spark):
    rows = [(i, f"w{i} common words of text {i % 7}") for i in range(1, 40)] + [(20, "common " + "filler text " * 120_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = search.search(df, df.filter("doc_id = 20"), k=3, query_terms=None, k3=None).collect()
    assert [r["rank"] for r in out] == [1, 2, 3] and 20 not in {r.doc_id for r in out}


def test_registered_search_weighs_counts_in_full(spark, tmp_path):
    from lumirank.llm.queries import QUERIES

    rows = corpus(40) + [(100, "zebra " * 9 + "apple"), (101, "zebra quagga"), (102, "apple " + "pear " * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.query_id, r["rank"]): r.score for r in QUERIES["op7_block_max_search"](spark, str(tmp_path)).collect()}
    want = whole_queries_by_hand(rows, 10, float)              # idf times the count, as it stands in the text
    assert got == pytest.approx(want) and got[100, 1] > 3 * got[100, 2]


def test_search_edge_cases(spark):
    docs = messy(spark)
    out = search.search(docs, docs, k=3, min_df=1).collect()
    assert {r.query_id for r in out} >= {3, 4, 5} and None not in {r.query_id for r in out}
    assert {(r.query_id, r.doc_id) for r in out} >= {(4, 5), (5, 4)}
    assert search.search(empty(spark), docs).count() == 0 and search.search(docs, empty(spark)).count() == 0


def test_pipeline_keeps_one_row_of_a_group(spark):
    a, b, c = ("a b c d e f g h", "one two three four five six seven", "red green blue white black grey pink")
    rows = [(5, a), (5, a), (3, b), (7, b), (7, c), (None, a), (None, c), (None, c), (9, ""), (9, ""), (None, None), (2, "alone " * 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC).repartition(3)
    out = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert out == Counter([(5, a), (3, b), (7, c), (9, ""), (9, ""), (None, None), (2, "alone " * 3)])


def test_pipeline_against_plain_python(spark, tmp_path):
    """The stages' decisions on a small corpus, each derived again from its own input."""
    rows, labels = [], []
    for i, (_, t) in enumerate(corpus(120)):
        toxic = i % 9 == 0 and t and len(t) > 40
        text = t + " vile grim foul" if toxic else t
        rows.append((i, text, "xx", "s", len(text or "")))
        labels.append((i, 1, int(bool(toxic))))
    rows.append((900, "some words here token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and more", None, "s", 77))
    rows.append((901, "12 %% 34", "xx", "s", 8))
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), DOC)
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append({r.doc_id: r for r in docs.collect()})
    toxic = {i for i, _, t in labels if t}
    assert not toxic & set(seen[0]) and set(seen[0]) == {r[0] for r in rows} - toxic
    assert set(seen[0]) - set(seen[1]) >= {901} and all(re.search(r"[^\W\d_]", r.text) for r in seen[1].values()) and seen[1][900].lang == "xx"
    want = {i for i, (n, c) in groups_by_hand([(i, r.text) for i, r in sorted(seen[1].items())], 5, 80).items() if n == 0 or c == i}
    assert set(seen[2]) == want
    assert set(seen[3]) == want and "[ASSIGN]" in seen[3][900].text and seen[3][900].n_chars == len(seen[3][900].text)
    assert all(seen[3][i].text == seen[2][i].text for i in want - {900})
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing([(i, r.text) for i, r in seen[3].items()], corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), tk)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == want


@pytest.mark.parametrize("alike,dense", [(512, 16), (8, 4), (4, 10**9)])
def test_many_queries_at_once_equal_full_scoring(monkeypatch, alike, dense):
    """A shard is searched by all queries together: clusters, dense and rare terms, thresholds and left-out pairs."""
    for name, value in (("ALIKE", alike), ("DENSE", dense), ("BLOCK", 4), ("MOST_DENSE", 20), ("POSTINGS", 50)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(10)
    for _ in range(40):
        n_terms, n_docs = 60, int(rng.integers(1, 90))
        table = np.where(rng.random((n_terms, n_docs)) < rng.random((n_terms, 1)), rng.choice([.5, 1.0, 1.5, 2.0], (n_terms, n_docs)), 0.0)
        table[:, rng.integers(0, n_docs, 9)] = table[:, :1]                  # equal documents, equal scores
        term, doc = np.nonzero(table)
        label = search.clusters(term, doc, n_terms, n_docs)
        table = table[:, np.argsort(label, kind="stable")]
        term, doc = np.nonzero(table)
        index = search.ClusterIndex(term, doc, table[term, doc], n_terms, np.searchsorted(np.sort(label), np.arange(label.max() + 2)))
        asked = [np.unique(rng.integers(0, n_terms, int(rng.integers(1, 30)))) for _ in range(7)]
        weights = [rng.choice([.1, 1.0, 4.0], len(t)) for t in asked]
        k, order, skip = int(rng.integers(1, 12)), rng.permutation(n_docs), np.unique(rng.integers(0, 7 * n_docs, 20))
        total = [np.bincount(np.tile(np.arange(n_docs), len(t)), (w[:, None] * table[t]).ravel(), n_docs) for t, w in zip(asked, weights)]
        theta = np.array([rng.choice([0.0, s.mean(), np.sort(s)[-min(k, n_docs)]]) for s in total])
        want = []
        for i, s in enumerate(total):
            fit = [d for d in np.lexsort((order, -s)).tolist() if s[d] > 0 and s[d] >= theta[i] and i * n_docs + d not in skip]
            want += [(i, d, s[d]) for d in fit[:k]]
        first = np.cumsum([0, *map(len, asked)])
        got = index.best(np.concatenate(asked), np.concatenate(weights), first, k, order, skip, theta)
        assert list(zip(*(x.tolist() for x in got))) == want
