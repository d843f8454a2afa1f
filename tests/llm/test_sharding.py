import zlib
from collections import Counter

import numpy as np
import pytest
from samples import empty, messy

from lumirank.llm import queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 1000, 4096, 4097, 70_001])
def test_permutation_is_a_bijection_with_an_inverse(n):
    p, x = sharding.Permutation(n, 11), np.arange(n)
    y = p.place(x)
    assert np.array_equal(np.sort(y), x) and np.array_equal(p.number(y), x)
    assert np.array_equal(sharding.Permutation(n, 11).place(x[::-1]), y[::-1])        # single numbers, any order
    shard, slot = sharding.shard_and_slot(x, n, 7, 11)
    assert np.array_equal(sharding.row_number_at(shard, slot, n, 7, 11), x)
    if n > 1000:
        assert not np.array_equal(y, sharding.Permutation(n, 12).place(x))
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.1
    with pytest.raises(ValueError):
        p.place([n])


def test_large_ranges():
    p, x = sharding.Permutation(10**15 + 7, 3), np.array([0, 1, 10**15 + 6, 123_456_789_012_345])
    assert np.array_equal(p.number(p.place(x)), x)


def check(got, n, shards):
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == n
    assert max(map(len, slots.values())) - min(len(slots.get(i, [])) for i in range(shards)) <= 1


def test_same_places_in_any_partitioning(spark):
    df = messy(spark).withColumnRenamed("score", "slot")
    df = df.union(df)                                        # every row twice
    a = sharding.assign_shards(df.repartition(7), 5, 1).collect()
    b = sharding.assign_shards(df.coalesce(1), 5, 1).collect()
    assert Counter(map(repr, a)) == Counter(map(repr, b))
    check(a, df.count(), 5)
    first = min(a, key=lambda r: r.row_number)
    assert first.doc_id is None


def test_one_row_repeated_spreads_over_tasks(spark):
    df = spark.createDataFrame([(1, "same")] * 5000, "doc_id long, text string")
    got = sharding.assign_shards(df, 24, 1, keep=["doc_id"])
    check(got.collect(), 5000, 24)
    assert sharding.assign_shards(empty(spark), 24).count() == 0


def test_written_shards_can_be_read_by_place(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    sharding.write_shards(sharding.assign_shards(df, 4, 9), f"{tmp_path}/out", rows_per_file=50)
    got = spark.read.parquet(f"{tmp_path}/out/shard=2").filter("slot = 17").first()
    assert got.doc_id == sharding.row_number_at(2, 17, 500, 4, 9)[0] and got.text == f"text {got.doc_id}"


def test_query(spark, tmp_path):
    df = messy(spark, extra=False)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_feistel_shards"](spark, str(tmp_path)).collect()
    texts = [(r.text or "").encode() for r in df.collect()]
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(t) + 8, zlib.crc32(t)) for t in texts)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    check(got, df.count(), 24)
