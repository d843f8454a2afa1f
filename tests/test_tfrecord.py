"""TFRecord files: the batch codec against a plain encoder, ranges of large files, commits that stop half-way."""

import gzip
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lumirank.sources import examples as E, tfrecord as TF


def varint(v):
    v &= (1 << 64) - 1
    out = b""
    while v > 0x7F:
        out += bytes([v & 0x7F | 0x80])
        v >>= 7
    return out + bytes([v])


def sized(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def feature(kind, values, packed=True):
    if kind == E.BYTES:
        return sized(1, b"".join(sized(1, v) for v in values))
    if kind == E.FLOAT:
        return sized(2, sized(1, struct.pack(f"<{len(values)}f", *values)) if packed else b"".join(b"\x0d" + struct.pack("<f", v) for v in values))
    return sized(3, sized(1, b"".join(map(varint, values))) if packed else b"".join(b"\x08" + varint(v) for v in values))


def example(row, rnd):
    """A message with entries in any order, unknown fields, packed and single numbers."""
    entries = []
    for name, (kind, values) in row.items():
        key, val = sized(1, name.encode()), sized(2, feature(kind, values, rnd.random() < 0.7))
        extra = rnd.choice([b"", b"\x18\x05", b"\x25abcd", b"\x21abcdefgh"])
        entries.append(sized(1, rnd.choice([key + val, val + key]) + extra))
    rnd.shuffle(entries)
    cut = rnd.randint(0, len(entries))
    return sized(1, b"".join(entries[:cut])) + sized(1, b"".join(entries[cut:]))


def messages(n, seed):
    rnd, rows = random.Random(seed), []
    for _ in range(n):
        row = {}
        if rnd.random() < 0.9:
            row["i"] = (E.INT64, [rnd.choice([0, 1, -1, 127, 128, 2**63 - 1, -2**63, rnd.randint(-9**18, 9**18)]) for _ in range(rnd.randint(0, 5))])
        if rnd.random() < 0.9:
            row["f"] = (E.FLOAT, [rnd.randint(-9, 9) / 4 for _ in range(rnd.randint(0, 4))])
        if rnd.random() < 0.9:
            row["s"] = (E.BYTES, [rnd.choice([b"", b"a", "é日".encode(), b"x" * 300]) for _ in range(rnd.randint(0, 4))])
        row["other"] = (E.INT64, [5])
        rows.append(row)
    return rows, [example(r, rnd) for r in rows]


def decode(bodies, names):
    size = np.array([len(b) for b in bodies], np.int64)
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    found = E.find_features(buf, np.cumsum(size) - size, size, list(names))
    types = {E.INT64: pa.int64(), E.FLOAT: pa.float32(), E.BYTES: pa.binary()}
    return {n: [E.to_arrow(buf, *E.feature_values(buf, *found[n], k), k, t).to_pylist() for t in (pa.list_(types[k]), types[k])] for n, k in names.items()}


def test_decoding_equals_what_was_encoded():
    rows, bodies = messages(800, 1)
    got = decode(bodies, {"i": E.INT64, "f": E.FLOAT, "s": E.BYTES, "absent": E.INT64})
    for n in ("i", "f", "s", "absent"):
        lists = [r[n][1] if n in r and r[n][1] else None for r in rows]
        assert got[n] == [lists, [x[0] if x else None for x in lists]]
    assert decode([b"", example({}, random.Random(1))], {"i": E.INT64})["i"] == [[None, None], [None, None]]
    # a name that holds another kind reads as missing
    assert decode(bodies, {"s": E.INT64})["s"][0] == [None] * len(bodies)


def test_broken_messages_are_refused():
    good = example({"i": (E.INT64, [1, 300])}, random.Random(2))
    for bad in (good[:-1], b"\x0a\x7f", b"\x0b\x00", b"\xff" * 12, sized(1, sized(1, sized(1, b"i") + sized(2, sized(3, sized(1, b"\x80")))))):
        with pytest.raises(ValueError):
            decode([good, bad], {"i": E.INT64})


def test_encoding_is_read_back():
    rnd = random.Random(3)
    n = 500
    cols = {"i": [[rnd.randint(-2**63, 2**63 - 1) for _ in range(rnd.randint(0, 5))] for _ in range(n)], "s": [rnd.choice(["", "é", "y" * 200]) for _ in range(n)],
            "f": [[rnd.random() for _ in range(3)] for _ in range(n)], "b": [[b"", b"\x00"] * rnd.randint(0, 2) for _ in range(n)], "one": list(range(n))}
    batch = pa.RecordBatch.from_arrays([pa.array(cols["i"], pa.list_(pa.int64())), pa.array(cols["s"]), pa.array(cols["f"], pa.list_(pa.float32())),
                                        pa.array(cols["b"], pa.list_(pa.binary())), pa.array(cols["one"], pa.int32())], names=list(cols))
    kinds = {"i": E.INT64, "s": E.BYTES, "f": E.FLOAT, "b": E.BYTES, "one": E.INT64}
    for at, k in ((0, n), (37, 60), (100, 0)):
        body, size = E.encode_batch(batch.slice(at, k), list(kinds.items()))
        ends = np.cumsum(size)
        got = decode([body[e - m:e].tobytes() for e, m in zip(ends, size)], kinds) if k else {}
        for name in got:
            want = batch.slice(at, k).column(list(cols).index(name)).to_pylist()
            want = [w.encode() for w in want] if name == "s" else want
            assert got[name][0 if isinstance(want[0], list) else 1] == ([w or None for w in want] if isinstance(want[0], list) else want), name
    with pytest.raises(ValueError, match="missing"):
        E.encode_batch(pa.RecordBatch.from_arrays([pa.array([1, None])], names=["x"]), [("x", E.INT64)])


def foreign(path, bodies, gz=False):
    """A file of another writer: no index, one gzip member."""
    size = np.array([len(b) for b in bodies], np.int64)
    raw = TF._framed(np.frombuffer(b"".join(bodies), np.uint8), size)
    open(path, "wb").write(gzip.compress(raw) if gz else raw)


@pytest.mark.parametrize("split", [1, 50, 999, 10**6])
def test_ranges_of_foreign_files_meet_every_record_once(tmp_path, split):
    fs = TF.pafs.LocalFileSystem()
    rnd = random.Random(4)
    bodies = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 3, 60, 400]))) for _ in range(40)]
    foreign(f"{tmp_path}/x.tfrecord", bodies)
    foreign(f"{tmp_path}/y.tfrecord.gz", bodies, True)
    for name in ("x.tfrecord", "y.tfrecord.gz"):
        path, got = f"{tmp_path}/{name}", []
        for lo in range(0, os.path.getsize(path), split):
            for buf, start, size in TF.read_range(fs, path, lo, lo + split, True):
                got += [buf[a:a + n].tobytes() for a, n in zip(start, size)]
        assert got == bodies


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_one_large_file_gives_many_tasks(spark, tmp_path, compression):
    df = spark.range(20_000).selectExpr("id", "repeat('x', 50) AS s", "array(id, -id) AS q").coalesce(1)
    TF.write_tfrecord(df, f"{tmp_path}/t", compression=compression, member=50_000)
    assert len(TF.list_files(f"{tmp_path}/t")) == 1
    got = TF.read_tfrecord(spark, f"{tmp_path}/t", "id long, s string, q array<long>", verify=True, split=20_000)
    assert got.rdd.getNumPartitions() >= 5
    assert sorted((r.id, r.s, tuple(r.q)) for r in got.collect()) == [(i, "x" * 50, (i, -i)) for i in range(20_000)]


def rows_of(spark, path):
    return sorted(r.id for r in TF.read_tfrecord(spark, path, "id long").collect())


@pytest.mark.parametrize("step", ["_move", "put_manifest", "_sweep", "_clean", "none"])
def test_a_commit_killed_at_any_step_leaves_a_whole_table(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/t"
    TF.write_tfrecord(spark.range(10).repartition(2), path)
    schema = T.StructType([T.StructField("id", T.LongType())])

    def job():
        w = TF._Writer(schema, {"path": path}, True)
        w.start()
        return w, [w.write(iter([pa.RecordBatch.from_arrays([pa.array([a, a + 1])], names=["id"])])) for a in (100, 200)]

    w, sent = job()
    assert rows_of(spark, path) == list(range(10))                     # written, but not committed

    def stop(*a, **k):
        raise OSError("killed")
    if step == "put_manifest":
        monkeypatch.setattr(TF, step, stop)
    elif step != "none":
        monkeypatch.setattr(TF._Writer, step, stop)
    if step == "none":
        w.commit(sent)
    else:
        with pytest.raises(OSError):
            w.commit(sent)
    monkeypatch.undo()
    new = [100, 101, 200, 201]
    assert rows_of(spark, path) == (list(range(10)) if step in ("_move", "put_manifest") else new)
    TF.write_tfrecord(spark.range(3), path)                            # a later commit works all the same
    TF.write_tfrecord(spark.range(4), path)
    assert rows_of(spark, path) == [0, 1, 2, 3]


def test_a_running_reader_keeps_its_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    TF.write_tfrecord(spark.range(10), path)
    planned = TF._Reader(T.StructType([T.StructField("id", T.LongType())]), {"path": path})
    parts = planned.partitions()
    TF.write_tfrecord(spark.range(5), path)                            # replaces the table under the reader
    assert sorted(x for p in parts for b in planned.read(p) for x in b.column(0).to_pylist()) == list(range(10))


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    path, schema = f"{tmp_path}/t", T.StructType([T.StructField("id", T.LongType())])
    fs = TF.pafs.LocalFileSystem()
    w = TF._Writer(schema, {"path": path}, True)
    w.start()
    TF.put_manifest(fs, path, {"version": 1, "files": [], "previous": []})
    with pytest.raises(RuntimeError, match="another writer"):
        TF.put_manifest(fs, path, {"version": 1, "files": ["x"], "previous": []})
    assert TF.read_manifest(fs, path)["files"] == [] and not [f for f in os.listdir(path) if f.startswith("_manifest.")]
    assert rows_of(spark, path) == []


def test_folders_of_other_writers(spark, tmp_path):
    rows, bodies = messages(30, 9)
    os.makedirs(f"{tmp_path}/f")
    foreign(f"{tmp_path}/f/a.tfrecord", bodies[:20])
    foreign(f"{tmp_path}/f/b.tfrecord.gz", bodies[20:], True)
    got = TF.read_tfrecord(spark, f"{tmp_path}/f", "i array<long>, s string", split=100).collect()
    assert sorted(repr(r.i) for r in got) == sorted(repr(r["i"][1] if "i" in r and r["i"][1] else None) for r in rows)
    with pytest.raises(FileNotFoundError):
        TF.list_files(f"{tmp_path}/none")
