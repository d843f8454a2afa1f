import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from samples import empty, messy

from lumirank.llm import periods, queries


def brute_runs(ids, least):
    n, out = len(ids), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                seg = ids[s:i + q]
                if not any(seg[r:] == seg[:-r] for r in range(1, q)):
                    out.add((s, i - s + q, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    rnd = random.Random(least)
    for _ in range(1500):
        n, letters = rnd.randint(0, 70), rnd.randint(1, 4)
        ids = [rnd.randrange(letters) for _ in range(n)]
        if n > 5 and rnd.random() < 0.5:
            s, p = rnd.randrange(n), rnd.randint(1, 20)
            ids = [x if i < s else ids[s + (i - s) % p] for i, x in enumerate(ids)]
        assert periods.periodic_runs(np.array(ids, np.int64), least) == brute_runs(ids, least), (ids, least)


def test_runs_of_long_texts():
    n = 150_000
    assert periods.periodic_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periods.periodic_runs(np.arange(n) % 50_000) == [(0, n, 50_000)]
    assert periods.periodic_runs(np.arange(n)) == []


def test_collapsed_texts(spark):
    texts = [(1, "x " + "a b c\n" * 5 + "y"), (2, "no run"), (3, None), (4, ""), (1, "w " * 12)]
    got = periods.find_periodic_runs(spark.createDataFrame(texts, "doc_id long, text string"), keep=["doc_id"]).collect()
    assert [([tuple(r) for r in g.runs], g.collapsed) for g in got] == [
        ([(1, 15, 3)], "x a b c y"), ([], "no run"), ([], ""), ([], ""), ([(0, 12, 1)], "w")]


def test_odd_tables(spark):
    assert periods.find_periodic_runs(empty(spark)).count() == 0
    df = messy(spark).withColumnRenamed("score", "runs")
    got = periods.find_periodic_runs(df.union(df))
    assert got.count() == 2 * df.count() and got.schema["runs"].dataType == periods.RUNS and "__text" in got.columns


def test_query_equals_plain_python(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("a bb ccc dd\te".split()) for _ in range(rnd.choice([0, 1, 5, 80, 400])))) for i in range(120)]
    rows += [(None, "a " * 20), (200, None), (200, None), (7, "q\x0b" * 30), (10**15, "é " * 3000)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        names = {x: k for k, x in enumerate(dict.fromkeys(w))}
        runs = brute_runs([names[x] for x in w], 12) if n <= 400 else periods.periodic_runs(np.array([names[x] for x in w]))
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want.append((i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                     hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
