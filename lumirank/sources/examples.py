"""Example messages of whole batches: decoded and encoded by array operations, all records in step.

A batch is one byte array with the place and length of each record. A loop runs over the entries (or the
strings) of a record, never over records: its n-th round handles the n-th entry of all records at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

BYTES, FLOAT, INT64 = 1, 2, 3          # fixed values: the field of a Feature that holds each kind of list


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of all bytes of the stretches, one stretch after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def read_varints(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The varint at each place, and the place behind it."""
    value, at, open_ = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for k in range(10):
        if not len(open_):
            return value, at
        if (at[open_] >= end[open_]).any():
            raise ValueError("a message ends inside a number")
        b = buf[at[open_]]
        value[open_] |= (b & 0x7F).astype(np.uint64) << np.uint64(7 * k)
        at[open_] += 1
        open_ = open_[b >= 0x80]
    if len(open_):
        raise ValueError("a number has more than ten bytes")
    return value, at


def _fields(buf, start, end):
    """Round by round (owner, field number, wire type, value, start, end) of the next field of each message; for
    numbers the value, for the others where their bytes are."""
    at, live = start.copy(), np.flatnonzero(start < end)
    while len(live):
        tag, p = read_varints(buf, at[live], end[live])
        kind, value, stop = (tag & np.uint64(7)).astype(np.int64), np.zeros(len(live), np.uint64), p.copy()
        number = np.flatnonzero(kind == 0)
        value[number], stop[number] = read_varints(buf, p[number], end[live[number]])
        sized = np.flatnonzero(kind == 2)
        n, q = read_varints(buf, p[sized], end[live[sized]])
        if (n > np.uint64(len(buf))).any():
            raise ValueError("a field is longer than its message")
        p[sized], stop[sized] = q, q + n.astype(np.int64)
        stop = np.where(kind == 5, p + 4, np.where(kind == 1, p + 8, stop))
        if not np.isin(kind, (0, 1, 2, 5)).all():
            raise ValueError("unknown wire type")
        if (stop > end[live]).any():
            raise ValueError("a field is longer than its message")
        yield live, (tag >> np.uint64(3)).astype(np.int64), kind, value, p, stop
        at[live] = stop
        live = live[stop < end[live]]


def _same_name(buf, start, end, name: bytes) -> np.ndarray:
    ok = (end - start) == len(name)
    rows = np.flatnonzero(ok)
    if len(rows) and name:
        ok[rows] = (buf[start[rows][:, None] + np.arange(len(name))] == np.frombuffer(name, np.uint8)).all(axis=1)
    return ok


def find_features(buf: np.ndarray, start: np.ndarray, size: np.ndarray, names: Sequence[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per wanted name where each record's Feature begins and ends (-1: the record lacks it; of repeats the last)."""
    out = {n: (np.full(len(start), -1, np.int64), np.full(len(start), -1, np.int64)) for n in names}
    for rec, _, kind, _, a, b in _fields(buf, start, start + size):                         # Example.features
        rec, a, b = rec[kind == 2], a[kind == 2], b[kind == 2]
        for of, _, kind2, _, c, d in _fields(buf, a, b):                                    # one map entry each
            of, c, d = of[kind2 == 2], c[kind2 == 2], d[kind2 == 2]
            key, val = [np.zeros(len(of), np.int64) for _ in range(2)], [np.zeros(len(of), np.int64) for _ in range(2)]
            for e, field, kind3, _, f, g in _fields(buf, c, d):
                for which, pair in ((1, key), (2, val)):
                    hit = (field == which) & (kind3 == 2)
                    pair[0][e[hit]], pair[1][e[hit]] = f[hit], g[hit]
            for n, (s, t) in out.items():
                hit = np.flatnonzero(_same_name(buf, key[0], key[1], n.encode()))
                s[rec[of[hit]]], t[rec[of[hit]]] = val[0][hit], val[1][hit]
    return out


def packed_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All varints of a byte array, and for each byte whether a varint ends there."""
    last = data < 0x80
    if not len(data):
        return np.empty(0, np.int64), last
    if not last[-1]:
        raise ValueError("a message ends inside a number")
    first = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.r_[first, len(data)]))
    if place.max() > 9:
        raise ValueError("a number has more than ten bytes")
    return np.bitwise_or.reduceat((data & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), first).view(np.int64), last


def feature_values(buf: np.ndarray, start: np.ndarray, end: np.ndarray, want: int) -> tuple[np.ndarray, object]:
    """Values per record, and all values one after the other: numbers, or for BYTES the pair (start, size).

    A record whose feature is missing, empty or of another kind has none. Numbers may be packed or not.
    """
    n, owners, parts = len(start), [], []
    for rec, field, kind, _, a, b in _fields(buf, np.where(start < 0, 0, start), np.where(start < 0, 0, end)):
        hit = (field == want) & (kind == 2)
        rec, a, b = rec[hit], a[hit], b[hit]
        for of, _, wire, value, c, d in _fields(buf, a, b):
            if want == BYTES:
                ok = wire == 2
                owners.append(rec[of[ok]])
                parts.append(np.stack([c[ok], (d - c)[ok]], axis=1))
            elif want == FLOAT:
                ok = np.isin(wire, (2, 5))
                size = (d - c)[ok]
                if (size % 4).any():
                    raise ValueError("a list of floats has a broken length")
                owners.append(np.repeat(rec[of[ok]], size // 4))
                parts.append(buf[spans(c[ok], size)].view("<f4"))
            else:
                single, many = wire == 0, wire == 2
                if single.any():
                    owners.append(rec[of[single]])
                    parts.append(value[single].view(np.int64))
                size = (d - c)[many]
                found, last = packed_varints(buf[spans(c[many], size)])
                ends = np.r_[0, np.cumsum(last)]
                bound = np.r_[0, np.cumsum(size)]
                if len(size) and (size > 0).any() and not last[bound[1:][size > 0] - 1].all():
                    raise ValueError("a message ends inside a number")
                owners.append(np.repeat(rec[of[many]], np.diff(ends[bound])))
                parts.append(found)
    empty = {BYTES: np.empty((0, 2), np.int64), FLOAT: np.empty(0, "<f4"), INT64: np.empty(0, np.int64)}[want]
    owner = np.concatenate([np.empty(0, np.int64), *owners])
    values = np.concatenate([empty, *parts])
    by = np.argsort(owner, kind="stable")                   # rounds interleave records; within one, order holds
    return np.bincount(owner, minlength=n).astype(np.int64), values[by]


def to_arrow(buf: np.ndarray, counts: np.ndarray, values, kind: int, target: pa.DataType) -> pa.Array:
    """A column of lists, or of first values (null where there is none)."""
    listed = pa.types.is_list(target)
    inner = target.value_type if listed else target
    if not listed:
        first = np.cumsum(counts) - counts
        has = counts > 0
        values = values[first[has]]
    if kind == BYTES:
        size = values[:, 1]
        data = buf[spans(values[:, 0], size)]
        offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
        flat = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        if pa.types.is_string(inner) or pa.types.is_large_string(inner):
            try:
                flat = flat.cast(pa.large_string())
            except pa.ArrowInvalid:                          # bytes that are no UTF-8
                flat = pa.array([x.decode("utf-8", "replace") for x in flat.to_pylist()], pa.large_string())
        flat = flat.cast(inner)
    else:
        flat = pa.array(values).cast(inner, safe=False)
    if listed:
        # a missing feature is a null list
        mask = pa.array(counts == 0) if (counts == 0).any() else None
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), flat, mask=mask).cast(target)
    out = np.full(len(counts), -1, np.int64)
    out[has] = np.arange(int(has.sum()))
    return flat.take(pa.array(out, mask=~has))


# ---------------------------------------------------------------- encoding

def _width(v: np.ndarray) -> np.ndarray:
    """Bytes of each number as a varint."""
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += v >= np.uint64(1 << (7 * k))
    return n


def _put(out: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Write a varint at each place; the places behind them."""
    v, rows, at = v.astype(np.uint64), np.arange(len(v)), at.copy()
    while len(rows):
        low, rest = (v[rows] & np.uint64(0x7F)).astype(np.uint8), v[rows] >> np.uint64(7)
        out[at[rows]] = low | np.where(rest > 0, 0x80, 0).astype(np.uint8)
        at[rows] += 1
        v[rows] = rest
        rows = rows[rest > 0]
    return at


def _total(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the sizes of each row's values."""
    c = np.r_[0, np.cumsum(sizes)]
    e = np.cumsum(counts)
    return c[e] - c[e - counts]


def _sized(n: np.ndarray) -> np.ndarray:
    """Bytes of a field of n bytes with its tag and length."""
    return 1 + _width(n.astype(np.uint64)) + n


class _Column:
    def __init__(self, name: str, array: pa.Array, kind: int):
        if array.null_count:
            raise ValueError(f"field {name} is missing in a row to be written")
        self.name, self.kind = name.encode(), kind
        if pa.types.is_list(array.type) or pa.types.is_large_list(array.type):
            self.counts, flat = np.diff(array.offsets.to_numpy()).astype(np.int64), array.flatten()
        else:
            self.counts, flat = np.ones(len(array), np.int64), array
        if flat.null_count:
            raise ValueError(f"field {name} has a null among its values")
        if kind == BYTES:
            flat = flat.cast(pa.large_binary())
            offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
            raw = flat.buffers()[2]
            self.data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
            self.start, self.size = offsets[:-1], np.diff(offsets)
            self.body = _total(_sized(self.size), self.counts)
        else:
            if kind == FLOAT:
                self.raw = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).astype("<f4")).view(np.uint8)
                self.packed = 4 * self.counts
            else:
                self.values = flat.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
                self.packed = _total(_width(self.values), self.counts)
            self.body = _sized(self.packed)
        self.feature = _sized(self.body)
        self.entry = int(_sized(np.array([len(self.name)]))[0]) + _sized(self.feature)
        self.whole = _sized(self.entry)

    def write(self, out: np.ndarray, at: np.ndarray) -> np.ndarray:
        def head(tag, at, n):
            out[at] = tag
            return _put(out, at + 1, n)

        at = head(0x0A, at, self.entry)
        at = head(0x0A, at, np.full(len(at), len(self.name)))
        out[at[:, None] + np.arange(len(self.name))] = np.frombuffer(self.name, np.uint8)
        at = head(0x12, at + len(self.name), self.feature)
        at = head(self.kind << 3 | 2, at, self.body)
        end = at + self.body
        if self.kind == BYTES:
            sizes = _sized(self.size)
            before = np.cumsum(sizes) - sizes
            first = before[np.minimum(np.cumsum(self.counts) - self.counts, max(len(before) - 1, 0))] if len(before) else np.zeros(len(at), np.int64)
            place = np.repeat(at - first, self.counts) + before
            place = head(0x0A, place, self.size)
            out[spans(place, self.size)] = self.data[spans(self.start, self.size)]
            return end
        at = head(0x0A, at, self.packed)
        if self.kind == FLOAT:
            out[spans(at, self.packed)] = self.raw
        else:
            width = _width(self.values)
            before = np.cumsum(width) - width
            first = before[np.minimum(np.cumsum(self.counts) - self.counts, max(len(before) - 1, 0))] if len(before) else np.zeros(len(at), np.int64)
            _put(out, np.repeat(at - first, self.counts) + before, self.values)
        return end


def encode_batch(batch: pa.RecordBatch, kinds: Sequence[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Example messages of all rows as one byte array, and their sizes. A null is an error."""
    cols = [_Column(n, batch.column(i), k) for i, (n, k) in enumerate(kinds)]
    inner = sum((c.whole for c in cols), np.zeros(batch.num_rows, np.int64))
    size = _sized(inner)
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    out[at] = 0x0A
    at = _put(out, at + 1, inner)
    for c in cols:
        at = c.write(out, at)
    return out, size
