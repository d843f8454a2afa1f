"""Weighted acyclic automata over words: built in order, read back, composed. All arrays, no object per state.

An automaton holds word sequences (paths) of up to `depth` words, each with a positive weight. Level d has the
states reached by d words; an arc has a word, the state it leads to and the weight of the path that ends with it
(0: none ends here). State 0 of every level below the root has no arcs. States with the same arcs are one state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lumirank.llm.base import mix

BLOCK = 1 << 18               # paths that are frozen at once
_SIZES = (np.uint8, np.uint16, np.uint32, np.uint64)


def order_paths(paths: np.ndarray) -> np.ndarray:
    """Order of the rows (word numbers from 1, 0 behind the last word): by the first word, then the next."""
    bits = int(paths.max(initial=1)).bit_length()
    if bits * paths.shape[1] > 63:
        return np.lexsort(paths.T[::-1])
    key = np.zeros(len(paths), np.int64)
    for column in paths.T:
        key = (key << bits) | column
    return np.argsort(key, kind="stable")


def sum_paths(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their weights."""
    if not len(paths):
        return paths, weights
    by = order_paths(paths)
    paths, weights = paths[by], weights[by]
    first = np.flatnonzero(np.r_[True, (paths[1:] != paths[:-1]).any(axis=1)])
    return paths[first], np.add.reduceat(weights, first)


def prefixes(paths: np.ndarray):
    """Of sorted rows, for each number of words d: where the rows of each prefix of d words begin."""
    new = np.ones(len(paths), bool)
    new[1:] = False
    for d in range(paths.shape[1]):
        new = new | np.r_[True, paths[1:, d] != paths[:-1, d]][:len(paths)]
        yield np.flatnonzero(new & (paths[:, d] > 0))


@dataclass
class Automaton:
    words: list[bytes]                               # ascending
    start: list[np.ndarray]                          # per level: where each state's arcs begin, one more at the end
    label: list[np.ndarray]                          # per level and arc: word number from 1, ascending within a state
    target: list[np.ndarray]
    final: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.label)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths in order, and their weights."""
        state, prefix, out, weights = np.zeros(1, np.int64), np.zeros((1, self.depth), np.int64), [], []
        for d in range(self.depth):
            count = self.start[d][state + 1] - self.start[d][state]
            arc = _spans(self.start[d][state], count)
            prefix = np.repeat(prefix, count, axis=0)
            prefix[:, d] = self.label[d][arc]
            ends = self.final[d][arc] > 0
            out.append(prefix[ends])
            weights.append(self.final[d][arc][ends])
            state = self.target[d][arc]
        paths, weights = np.concatenate(out), np.concatenate(weights)
        by = order_paths(paths)
        return paths[by], weights[by]

    def dump(self) -> bytes:
        arrays = [x for d in range(self.depth) for x in (np.diff(self.start[d]), self.label[d], self.target[d], self.final[d])]
        small = [a.astype(next(t for t in _SIZES if int(a.max(initial=0)) <= np.iinfo(t).max)) for a in arrays]
        alphabet = b"\n".join(self.words)
        head = np.array([len(alphabet), *[v for a in small for v in (a.itemsize, len(a))]], "<i8").tobytes()
        raw = b"".join([np.array([len(head)], "<i8").tobytes(), head, alphabet, *[a.tobytes() for a in small]])
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def load(blob: bytes) -> Automaton:
        raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        size = int(np.frombuffer(raw, "<i8", 1)[0])
        head = np.frombuffer(raw, "<i8", size // 8, 8)
        at = 8 + size + int(head[0])
        words, arrays = raw[8 + size:at].split(b"\n") if head[0] else [], []
        for width, n in head[1:].reshape(-1, 2).tolist():
            arrays.append(np.frombuffer(raw, f"<u{width}", n, at).astype(np.int64))
            at += width * n
        start = [np.r_[0, np.cumsum(a)] for a in arrays[::4]]
        return Automaton(words, start, arrays[1::4], arrays[2::4], arrays[3::4])


class Builder:
    """Minimal automaton from paths that come in order, block by block.

    Only the paths of the last first word stay open between blocks; the states of all others are frozen: looked
    up among the frozen states of their level, and stored once.
    """

    def __init__(self, words: Sequence[bytes], depth: int):
        self.words, self.depth = list(words), depth
        self.open = (np.empty((0, depth), np.int64), np.empty(0, np.int64))
        none = np.empty(0, np.int64)
        self.label, self.target, self.final = [none] * depth, [none] * depth, [none] * depth
        self.start = [np.zeros(1 + int(d > 0), np.int64) for d in range(depth)]     # below the root the empty state is there first
        self.root: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none)]
        self.known = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in range(depth)]

    def add(self, paths: np.ndarray, weights: np.ndarray) -> None:
        for at in range(0, len(paths), BLOCK):
            rows = np.concatenate([self.open[0], paths[at:at + BLOCK]])
            held = np.concatenate([self.open[1], weights[at:at + BLOCK]])
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            self.open = rows[cut:], held[cut:]
            self._freeze(rows[:cut], held[:cut])

    def finish(self) -> Automaton:
        self._freeze(*self.open)
        self.label[0], self.target[0], self.final[0] = (np.concatenate(x) for x in zip(*self.root))
        self.start[0] = np.array([0, len(self.label[0])])
        return Automaton(self.words, self.start, self.label, self.target, self.final)

    def _freeze(self, paths: np.ndarray, weights: np.ndarray) -> None:
        if not len(paths):
            return
        nodes = list(prefixes(paths))
        reached = np.zeros(len(nodes[-1]), np.int64)                    # the state that each prefix of the level leads to
        for d in range(self.depth - 1, -1, -1):
            rows = nodes[d]
            ends = np.ones(len(rows), bool) if d + 1 == self.depth else paths[rows, d + 1] == 0
            label, final = paths[rows, d], np.where(ends, weights[rows], 0)
            if d == 0:
                self.root.append((label, reached, final))
                return
            parent = np.searchsorted(nodes[d - 1], rows, side="right") - 1
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]][:len(parent)])
            states = self._intern(d, first, label, reached, final)
            reached = np.zeros(len(nodes[d - 1]), np.int64)
            reached[parent[first]] = states

    def _intern(self, d, first, label, target, final) -> np.ndarray:
        """Numbers of the states whose arcs begin at `first`; new ones are stored."""
        if not len(first):
            return np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(label)])
        with np.errstate(over="ignore"):
            arc = mix(mix(label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + target.astype(np.uint64)) + final.astype(np.uint64))
            h = mix(np.add.reduceat(arc, first) + count.astype(np.uint64))
        keys, ids = self.known[d]
        fresh, one, which = np.unique(h, return_index=True, return_inverse=True)
        number = np.full(len(fresh), -1, np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, fresh), len(keys) - 1)
            number = np.where(keys[at] == fresh, ids[at], -1)
        new = number < 0
        number[new] = self._store(d, one[new], first, count, label, target, final)
        keys, ids = np.concatenate([keys, fresh[new]]), np.concatenate([ids, number[new]])
        by = np.argsort(keys)
        self.known[d] = keys[by], ids[by]
        # equal hashes of different arcs: such states are stored on their own
        out, start = number[which], self.start[d]
        same = start[out + 1] - start[out] == count
        held = np.where(same, count, 0)
        mine, theirs = _spans(first, held), _spans(start[out], held)
        differ = (label[mine] != self.label[d][theirs]) | (target[mine] != self.target[d][theirs]) | (final[mine] != self.final[d][theirs])
        same[np.repeat(np.arange(len(out)), held)[differ]] = False
        own = np.flatnonzero(~same)
        out[own] = self._store(d, own, first, count, label, target, final)
        return out

    def _store(self, d, states, first, count, label, target, final) -> np.ndarray:
        at, n = _spans(first[states], count[states]), len(self.start[d]) - 1
        self.label[d] = np.concatenate([self.label[d], label[at]])
        self.target[d] = np.concatenate([self.target[d], target[at]])
        self.final[d] = np.concatenate([self.final[d], final[at]])
        self.start[d] = np.concatenate([self.start[d], self.start[d][-1] + np.cumsum(count[states])])
        return n + np.arange(len(states))


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first[0], first[0] + 1, ... of count[0] entries, then those of the next, and so on."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def build(words: Sequence[bytes], paths: np.ndarray, weights: np.ndarray) -> Automaton:
    """From distinct paths in order; words that no path has are left out."""
    used = np.unique(paths[paths > 0])
    small = np.zeros(len(words) + 1, np.int64)
    small[used] = np.arange(1, len(used) + 1)
    b = Builder([words[i - 1] for i in used.tolist()], paths.shape[1])
    b.add(small[paths], weights)
    return b.finish()


def union(automata: Sequence[Automaton]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, paths in order and weights of the union; weights of equal paths add up."""
    words = sorted(set().union(*[a.words for a in automata]))
    number = {w: i for i, w in enumerate(words, 1)}
    paths, weights = [], []
    for a in automata:
        to = np.array([0, *map(number.__getitem__, a.words)], np.int64)
        p, w = a.paths()
        paths.append(to[p])
        weights.append(w)
    return (words, *sum_paths(np.concatenate(paths), np.concatenate(weights)))


def compose(left: Automaton, right: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Weights in `left` and in `right` of the paths that both have: both are walked at once, level by level."""
    number = {w: i for i, w in enumerate(right.words, 1)}
    to = np.array([0, *[number.get(w, 0) for w in left.words]], np.int64)
    base = np.int64(len(right.words) + 1)
    ls, rs, out = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    for d in range(min(left.depth, right.depth)):
        arcs = np.repeat(np.arange(len(right.start[d]) - 1), np.diff(right.start[d])) * base + right.label[d]     # ascending
        count = left.start[d][ls + 1] - left.start[d][ls]
        la = _spans(left.start[d][ls], count)
        wanted = np.repeat(rs, count) * base + to[left.label[d][la]]
        ra = np.minimum(np.searchsorted(arcs, wanted), max(len(arcs) - 1, 0))
        hit = np.flatnonzero((arcs[ra] == wanted) & (to[left.label[d][la]] > 0)) if len(arcs) else np.empty(0, np.int64)
        la, ra = la[hit], ra[hit]
        both = (left.final[d][la] > 0) & (right.final[d][ra] > 0)
        out.append((left.final[d][la][both], right.final[d][ra][both]))
        ls, rs = left.target[d][la], right.target[d][ra]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
