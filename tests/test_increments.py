"""Tables that grow, caches under racing writers, and small files that are switched at once."""

import pytest
from pyspark.sql import functions as F

from lumirank.operators import stats
from lumirank.sources import files, increments as INC, relations as RL


def rows(df):
    return sorted(map(repr, df.collect()))


def some(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("cast(id % 7 as string) AS item_id", "id % 5 AS user_id", "cast(id % 3 = 0 as double) AS label", "if(id % 2 = 0, 'train', 'test') AS split")


def full(df):
    parts = INC.dataset_partials("label", {"item": "item_id", "user": "user_id"})(df)
    return {n: rows(t) for n, t in INC.merged_statistics(parts).items()}


def test_a_new_file_costs_its_own_scan(spark, tmp_path):
    table, root, read = f"{tmp_path}/table", f"{tmp_path}/stats", []
    inner = INC.dataset_partials("label", {"item": "item_id", "user": "user_id"})

    def partials(df):
        read.append(sorted(df.inputFiles()))
        return inner(df)

    def refreshed(key="k"):
        return {n: rows(t) for n, t in INC.merged_statistics(INC.refresh(spark, table, root, partials, key)).items()}

    some(spark, 0, 50).coalesce(1).write.parquet(table)
    some(spark, 50, 80).coalesce(1).write.mode("append").parquet(table)
    assert refreshed() == full(spark.read.parquet(table)) and len(read) == 1 and len(read[0]) == 2
    assert refreshed() == full(spark.read.parquet(table)) and len(read) == 1                   # nothing new: nothing read
    some(spark, 80, 100).coalesce(1).write.mode("append").parquet(table)
    assert refreshed() == full(spark.read.parquet(table)) and len(read) == 2 and len(read[1]) == 1
    # a file that goes drops its batch; the batch's other file is read again
    files.remove(spark, read[0][0])
    assert refreshed() == full(spark.read.parquet(table)) and len(read) == 3 and read[2] == [read[0][1]]
    assert refreshed("other") == full(spark.read.parquet(table)) and len(read) == 4 and len(read[3]) == 2
    sides = {tuple(r) for r in stats.side_stats(stats.id_frequencies(spark.read.parquet(table), {"item": "item_id"}, ["split"]), ["split", "side"]).collect()}
    got = INC.merged_statistics(INC.refresh(spark, table, root, partials, "other"))["sides"].filter("side = 'item' AND split <> 'all'")
    assert {tuple(r) for r in got.collect()} == sides


def test_two_refreshes_do_not_overwrite_each_other(spark, tmp_path):
    table, root = f"{tmp_path}/table", f"{tmp_path}/stats"
    some(spark, 0, 10).write.parquet(table)
    inner = INC.dataset_partials("label", {"item": "item_id"})

    def raced(df):
        INC.refresh(spark, table, root, inner)               # another writer is done first
        return inner(df)

    with pytest.raises(FileExistsError):
        INC.refresh(spark, table, root, raced)
    assert INC.refresh(spark, table, root, inner)["ids"].count() > 0


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/mark.json"
    files.write_text(spark, path, "one")
    files.write_text(spark, path, "two")
    assert files.read_text(spark, path) == "two" and not [n for n in files.names_in(spark, str(tmp_path)) if n.endswith(".tmp")]
    files.write_new(spark, f"{tmp_path}/new", "a")
    with pytest.raises(FileExistsError):
        files.write_new(spark, f"{tmp_path}/new", "b")
    assert files.read_text(spark, f"{tmp_path}/new") == "a" and not [n for n in files.names_in(spark, str(tmp_path)) if n.endswith(".tmp")]


def test_racing_rebuilds_of_a_cache(spark, tmp_path):
    path, built = f"{tmp_path}/pool", []

    def build(n):
        def make():
            built.append(n)
            return spark.range(n)
        return make

    first = RL.cached_table(spark, path, "a", build(3))
    assert RL.cached_table(spark, path, "a", build(4)).count() == 3 and built == [3]

    def slow(key, n):
        def make():
            RL.cached_table(spark, path, key, build(7))      # another writer is done first
            return spark.range(n)
        return make

    assert RL.cached_table(spark, path, "b", slow("b", 5)).count() == 7          # the winner's table fits
    assert first.count() == 3                                                    # and the old one is still there for its reader
    with pytest.raises(RuntimeError, match="another writer"):
        RL.cached_table(spark, path, "c", slow("d", 5))
    assert RL.cached_table(spark, path, "d", build(1)).count() == 7
    assert RL.cached_table(spark, path, "e", build(2)).count() == 2

    def fails():
        raise OSError("stopped")
    with pytest.raises(OSError):
        RL.cached_table(spark, path, "f", fails)
    assert RL.cached_table(spark, path, "e", build(9)).count() == 2
