"""TFRecord files of Example messages as a Spark data source.

Files are read in byte ranges, many tasks to a large file. Files written here have gzip members of bounded size and
an index beside them, so a range starts at a member; plain files of other writers are entered where a length and its
checksum agree; only a gzip file of another writer is the work of one task. Whole batches of messages are decoded and
encoded by array operations (`examples.py`).

A table's valid files stand in a manifest of ascending version. A commit moves its files beside the old ones and then
puts the next manifest in place by one rename, so readers see the old table or the new one, whatever step fails; files
go one commit after the one that replaced them.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lumirank.sources import examples
from lumirank.sources.files import fs_of

# fixed values: CRC-32C polynomial (reflected) and the mask TFRecord adds to it
CRC_POLY, CRC_MASK = 0x82F63B78, 0xA282EAD8
READ_BYTES = 1 << 20          # bytes read at once from a file without index
MEMBER_BYTES = 1 << 22        # records written as one gzip member, or one entry of the index
SPLIT_BYTES = 1 << 25         # stored bytes of a file that one task reads


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC_POLY), t >> 1)
    return t


_TABLE = _crc_table()


def masked_crcs(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of many stretches of a byte array, one byte position at a time for all of them."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    crc = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    for at, n in enumerate(live.tolist()):
        crc[:n] = _TABLE[(crc[:n] ^ buf[start[:n] + at]) & 0xFF] ^ (crc[:n] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    masked = ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(CRC_MASK)
    out = np.empty_like(masked)
    out[order] = masked
    return out


def _kind(t: T.DataType) -> int:
    e = t.elementType if isinstance(t, T.ArrayType) else t
    if isinstance(e, (T.FloatType, T.DoubleType)):
        return examples.FLOAT
    if isinstance(e, (T.StringType, T.BinaryType)):
        return examples.BYTES
    if isinstance(e, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)):
        return examples.INT64
    raise ValueError(f"TFRecord cannot hold {t.simpleString()}")


# ---------------------------------------------------------------- files, index and manifest

def _filesystem(path: str):
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host of Hadoop's default file system, if it names none: never a worker's own disk."""
    p, fs = fs_of(spark, path)
    return str(fs.makeQualified(p).toString())


def _beside(path: str, ending: str) -> str:
    return os.path.join(os.path.dirname(path), f"_{os.path.basename(path)}{ending}")


def _manifests(fs, root: str) -> list[str]:
    info = fs.get_file_info(root)
    if info.type != pafs.FileType.Directory:
        return []
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file
                  and os.path.basename(f.path).startswith("_manifest-") and f.path.endswith(".json"))


def read_manifest(fs, root: str) -> dict | None:
    """{'version', 'files', 'previous'} of the latest manifest, with names inside the folder."""
    found = _manifests(fs, root)
    if not found:
        return None
    with fs.open_input_stream(found[-1], compression=None) as f:
        return json.loads(f.read())


def put_manifest(fs, root: str, manifest: dict) -> None:
    """Written beside, then moved to the name of its version, which no other writer may have taken."""
    final = f"{root}/_manifest-{manifest['version']:012d}.json"
    temp = f"{root}/_manifest.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as f:
        f.write(json.dumps(manifest).encode())
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            os.link(temp, final)                    # a local rename would replace the other writer's file
        elif fs.get_file_info(final).type != pafs.FileType.NotFound:
            raise FileExistsError(final)
        else:
            fs.move(temp, final)
    except FileExistsError:
        raise RuntimeError(f"another writer has committed version {manifest['version']} of {root}") from None
    finally:
        if fs.get_file_info(temp).type != pafs.FileType.NotFound:
            fs.delete_file(temp)


def _data_files(fs, folder: str) -> list[str]:
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file
                   and not os.path.basename(f.path).startswith(("_", ".")))
    known = [n for n in names if n.endswith((".tfrecord", ".tfrecord.gz"))]
    return known or names


def list_files(path: str) -> list[str]:
    """Files of a folder (those of its manifest, or all whose names don't start with _ or .), one file, or the name with
    a known ending. A folder with a manifest may hold no file."""
    fs, p = _filesystem(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.Directory:
        manifest = read_manifest(fs, p)
        if manifest is not None:
            return [f"{p}/{n}" for n in manifest["files"]]
        found = _data_files(fs, p)
    else:
        found = [q for q in (p, f"{p}.tfrecord", f"{p}.tfrecord.gz") if fs.get_file_info(q).is_file][:1]
    if not found:
        raise FileNotFoundError(f"no TFRecord files at {path}")
    return found


# ---------------------------------------------------------------- records of a byte range

def _check(path: str, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    eight = np.full(len(start), 8)
    for what, at, n, stored in (("length", start - 12, eight, start - 4), ("record", start, size, start + size)):
        held = buf[stored[:, None] + np.arange(4)].view("<u4").ravel() if len(start) else np.empty(0, np.uint32)
        if (masked_crcs(buf, at, n) != held).any():
            raise ValueError(f"{path}: a {what} does not match its checksum")


def _follow(path: str, data: bytes, at: int, stop: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bodies of the records that begin in [at, stop) and are whole; where the next record begins. Without an index
    only a record's length tells where the next one is."""
    start, size = [], []
    while at < stop and len(data) - at >= 12:
        n = int.from_bytes(data[at:at + 8], "little")
        if len(data) - at < n + 16:
            break
        start.append(at + 12)
        size.append(n)
        at += n + 16
    return np.array(start, np.int64), np.array(size, np.int64), at


def _first_record(data: bytes) -> int | None:
    """The first place where a length and its checksum stand."""
    buf = np.frombuffer(data, np.uint8)
    at = np.arange(max(0, len(buf) - 11))
    if not len(at):
        return None
    held = buf[at[:, None] + 8 + np.arange(4)].view("<u4").ravel()
    hit = np.flatnonzero(masked_crcs(buf, at, np.full(len(at), 8)) == held)
    return int(hit[0]) if len(hit) else None


def read_range(fs, path: str, lo: int, hi: int, verify: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, sizes) of the records of one byte range of a file, batch by batch."""
    if fs.get_file_info(_beside(path, ".idx")).is_file:
        yield from _indexed(fs, path, lo, hi, verify)
        return
    with fs.open_input_stream(path, compression=None) as raw:
        zipped = raw.read(2) == b"\x1f\x8b"
    if zipped and lo > 0:
        return                                      # the first range reads it all
    if zipped:
        stream, skip, stop = fs.open_input_stream(path, compression="gzip"), 0, 1 << 62
    else:
        stream = fs.open_input_file(path)
        stream.seek(lo)
        skip, stop = None if lo else 0, hi
    with stream:
        data, base = b"", 0 if zipped else lo
        while True:
            more = stream.read(READ_BYTES)
            data += more
            if skip is None:
                skip = _first_record(data)
                if skip is None:
                    if not more or base + len(data) - 12 >= hi:
                        return
                    base, data = base + max(0, len(data) - 11), data[-11:]
                    continue
                base, data, skip = base + skip, data[skip:], 0
            start, size, at = _follow(path, data, 0, stop - base)
            if len(start):
                buf = np.frombuffer(data, np.uint8)
                if verify:
                    _check(path, buf, start, size)
                yield buf, start, size
            base, data = base + at, data[at:]
            if base >= stop:
                return
            if not more:
                if data:
                    raise ValueError(f"{path}: cut inside a record")
                return


def _indexed(fs, path, lo, hi, verify):
    with fs.open_input_file(_beside(path, ".idx")) as f:
        entries = np.frombuffer(f.read(), "<i8").reshape(-1, 3)           # offset, stored bytes, records
    first = np.r_[0, np.cumsum(entries[:, 2])]
    zipped = path.endswith(".gz")
    with fs.open_input_file(path) as data, fs.open_input_file(_beside(path, ".len")) as lengths:
        for i in np.flatnonzero((entries[:, 0] >= lo) & (entries[:, 0] < hi)).tolist():
            offset, stored, n = entries[i].tolist()
            lengths.seek(4 * int(first[i]))
            size = np.frombuffer(lengths.read(4 * n), "<u4").astype(np.int64)
            data.seek(offset)
            raw = data.read(stored)
            raw = zlib.decompress(raw, 31) if zipped else raw
            if len(raw) != int((size + 16).sum()):
                raise ValueError(f"{path}: cut inside a record")
            buf, start = np.frombuffer(raw, np.uint8), np.cumsum(size + 16) - size - 4
            if verify:
                _check(path, buf, start, size)
            yield buf, start, size


# ---------------------------------------------------------------- the source

@dataclass
class RangePartition(InputPartition):
    path: str
    lo: int
    hi: int


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.split = int(options.get("split", SPLIT_BYTES))

    def partitions(self):
        fs, _ = _filesystem(self.path)
        infos = fs.get_file_info(list_files(self.path))
        for f in infos:
            if not f.is_file:
                raise FileNotFoundError(f"{f.path} is missing")
        # an empty table still needs a partition
        return [RangePartition(f.path, lo, lo + self.split) for f in infos for lo in range(0, max(f.size, 1), self.split)] or [RangePartition("", 0, 0)]

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        if not partition.path:
            return
        fs, _ = _filesystem(self.path)
        target = to_arrow_schema(self.schema)
        kinds = [_kind(f.dataType) for f in self.schema.fields]
        for buf, start, size in read_range(fs, partition.path, partition.lo, partition.hi, self.verify):
            try:
                found = examples.find_features(buf, start, size, target.names)
                columns = []
                for f, kind in zip(target, kinds):
                    counts, values = examples.feature_values(buf, *found[f.name], kind)
                    columns.append(examples.to_arrow(buf, counts, values, kind, f.type))
            except ValueError as e:
                raise ValueError(f"{partition.path}: {e}") from e
            yield pa.RecordBatch.from_arrays(columns, schema=target)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.root, self.overwrite = schema, options["path"], overwrite
        self.gz = str(options.get("compression", "gzip")).lower() == "gzip"
        self.member = int(options.get("member", MEMBER_BYTES))
        self.job = uuid.uuid4().hex

    def start(self) -> None:
        """Before any task: files that are there already become the first version, so that no reader lists new ones."""
        fs, root = _filesystem(self.root)
        fs.create_dir(root, recursive=True)
        if read_manifest(fs, root) is None:
            put_manifest(fs, root, {"version": 0, "files": [os.path.basename(f) for f in _data_files(fs, root)], "previous": []})

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _filesystem(self.root)
        name = f"part-{uuid.uuid4().hex}.tfrecord" + (".gz" if self.gz else "")
        temp = f"{root}/_temporary-{self.job}"
        fs.create_dir(temp, recursive=True)
        kinds = [(f.name, _kind(f.dataType)) for f in self.schema.fields]
        entries, at, held = [], 0, []
        with fs.open_output_stream(f"{temp}/{name}", compression=None) as out, fs.open_output_stream(_beside(f"{temp}/{name}", ".len"), compression=None) as lengths:
            def flush():
                nonlocal at, held
                body, size = np.concatenate([b for b, _ in held]), np.concatenate([n for _, n in held])
                raw = _framed(body, size)
                if self.gz:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = z.compress(raw) + z.flush()
                out.write(raw)
                lengths.write(size.astype("<u4").tobytes())
                entries.append((at, len(raw), len(size)))
                at, held = at + len(raw), []

            for batch in iterator:
                for a in range(0, batch.num_rows, 4096):
                    held.append(examples.encode_batch(batch.slice(a, 4096), kinds))
                    if sum(len(b) for b, _ in held) >= self.member:
                        flush()
            if held:
                flush()
        with fs.open_output_stream(_beside(f"{temp}/{name}", ".idx"), compression=None) as out:
            out.write(np.array(entries, "<i8").tobytes())
        return _Written(name)

    def commit(self, messages) -> None:
        fs, root = _filesystem(self.root)
        old = read_manifest(fs, root) or {"version": -1, "files": [], "previous": []}
        names = [m.name for m in messages if m]
        self._move(fs, root, names)
        new = {"version": old["version"] + 1, "files": names if self.overwrite else [*old["files"], *names], "previous": old["files"]}
        put_manifest(fs, root, new)
        self._sweep(fs, root, {*old["previous"]} - {*new["files"], *new["previous"]}, new["version"])

    def abort(self, messages) -> None:
        self._clean(*_filesystem(self.root))

    def _move(self, fs, root, names) -> None:
        for n in names:
            for f in (_beside(f"/{n}", ".idx")[1:], _beside(f"/{n}", ".len")[1:], n):
                fs.move(f"{root}/_temporary-{self.job}/{f}", f"{root}/{f}")

    def _sweep(self, fs, root, gone, version) -> None:
        """Files of the version before last, and older manifests: a reader of the last version still has its files."""
        for n in sorted(gone):
            for f in (f"{root}/{n}", _beside(f"{root}/{n}", ".idx"), _beside(f"{root}/{n}", ".len")):
                if fs.get_file_info(f).is_file:
                    fs.delete_file(f)
        for m in _manifests(fs, root):
            if m < f"{root}/_manifest-{version - 1:012d}.json":
                fs.delete_file(m)
        self._clean(fs, root)

    def _clean(self, fs, root) -> None:
        temp = f"{root}/_temporary-{self.job}"
        if fs.get_file_info(temp).type == pafs.FileType.Directory:
            fs.delete_dir(temp)


def _framed(body: np.ndarray, size: np.ndarray) -> bytes:
    """Records with their lengths and checksums around them."""
    out = np.zeros(len(body) + 16 * len(size), np.uint8)
    at = np.cumsum(size + 16) - size - 16
    four, eight = np.arange(4), np.arange(8)
    out[at[:, None] + eight] = size.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[(at + 8)[:, None] + four] = masked_crcs(out, at, np.full(len(at), 8)).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[examples.spans(at + 12, size)] = body
    out[(at + 12 + size)[:, None] + four] = masked_crcs(out, at + 12, size).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


class TFRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord_examples"

    def schema(self):
        raise ValueError("a schema must be given: Example files do not carry one")

    def reader(self, schema):
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite):
        w = _Writer(schema, self.options, overwrite)
        w.start()
        return w


def read_tfrecord(spark: SparkSession, path: str, schema: T.StructType | str, verify: bool = False,
                  defaults: dict[str, object] | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """`defaults` fills fields that a record lacks (a missing request id, an unset label). A field whose feature is
    missing, empty or of another kind is null. `split` bounds the stored bytes that one task reads."""
    spark.dataSource.register(TFRecordSource)
    df = (spark.read.format("tfrecord_examples").schema(schema).option("verify", str(verify)).option("split", str(split))
          .load(qualified(spark, path)))
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in defaults.items()}) if defaults else df


def write_tfrecord(df: DataFrame, path: str, widths: dict[str, int] | None = None, compression: str = "gzip",
                   member: int = MEMBER_BYTES) -> None:
    """Replaces the table. `widths` gives array columns their fixed width; a null field is an error. `member` bounds the
    bytes of records under one entry of the index, up to one batch of 4,096 rows."""
    from lumirank.functions.text import fixed_width_ints
    out = df.withColumns({c: fixed_width_ints(F.col(c), n) for c, n in widths.items()}) if widths else df
    for f in out.schema.fields:
        _kind(f.dataType)
    spark = df.sparkSession
    spark.dataSource.register(TFRecordSource)
    out.write.format("tfrecord_examples").mode("overwrite").option("compression", compression).option("member", str(member)).save(qualified(spark, path))


def positive_records(spark: SparkSession, src: str, dst: str, schema: T.StructType | str, label: str = "label") -> None:
    """Copy of the records with label > 0."""
    write_tfrecord(read_tfrecord(spark, src, schema).filter(F.col(label) > 0), dst)
