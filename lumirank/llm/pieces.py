"""SentencePiece encoding of merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import heapq
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from lumirank.llm.base import map_text

SPACE = "▁"
STRETCH_MEMO = 500_000        # stretches of text whose ids a task's process remembers; then it starts anew
_NONE = np.int32(2**31 - 1)
_WIDTHS = (4, 8, 12, 16, 24, 32)
_FIELDS_ARROW = (pa.int64(), pa.string(), pa.string())


class Vocabulary:
    """What encoding needs of a merge-type model: piece ids, the order of scores, and where a text may be cut.

    Refused are models that this agenda doesn't state: another normaliser than identity, white
    space removed or kept as a suffix, user-defined or unused pieces, no byte pieces.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            m = proto.ModelProto.FromString(f.read())
        kind = proto.ModelProto.SentencePiece
        if (m.trainer_spec.model_type != proto.TrainerSpec.BPE or m.normalizer_spec.precompiled_charsmap
                or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix
                or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix
                or not m.trainer_spec.byte_fallback
                or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in m.pieces)):
            raise ValueError("only plain merge-type models with byte pieces are encoded here")
        self.end_id = self.library.eos_id()
        normal = [(i, p) for i, p in enumerate(m.pieces) if p.type == kind.NORMAL]
        self.ids = {p.piece: i for i, p in normal}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = np.array([p.score for _, p in normal], np.float32)
        order = np.unique(-scores, return_inverse=True)[1]         # equal scores have one place in the agenda
        self.place = {p.piece: int(o) for (_, p), o in zip(normal, order)}
        # a merge joins characters that stand together in some piece, so no merge crosses a line end, a
        # blank after something else, or the place between a letter or digit and a sign that never follows one
        joined = {(a, b) for _, p in normal for a, b in zip(p.piece, p.piece[1:])}
        signs = set(string.punctuation) - {b for a, b in joined if a.isalnum()}
        q = re.escape("".join(sorted(signs)))
        self.cut = (re.compile(f"{SPACE}*[^\\W_]+(?![^{SPACE}\n{q}])|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
                    if not any("\n" in x or (x[1] == SPACE and x[0] != SPACE) for x in joined) else None)
        self._pairs()

    def _pairs(self) -> None:
        """Every way to split a piece into two symbols, as sorted keys for binary search."""
        self.symbols: dict[str, int] = {}
        for piece in self.ids:
            self.symbols.setdefault(piece, len(self.symbols))
        keys, places, merged = [], [], []
        for piece in self.ids:
            for i in range(1, len(piece)):
                a, b = self.symbols.get(piece[:i]), self.symbols.get(piece[i:])
                # a lone character may be a symbol without being a piece
                if a is None and i == 1:
                    a = self.symbols.setdefault(piece[:1], len(self.symbols))
                if b is None and i == len(piece) - 1:
                    b = self.symbols.setdefault(piece[i:], len(self.symbols))
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    places.append(self.place[piece])
                    merged.append(self.symbols[piece])
        o = np.argsort(keys, kind="stable")
        self.keys, self.pair_place, self.pair_symbol = np.array(keys, np.int64)[o], np.array(places, np.int32)[o], np.array(merged, np.int32)[o]
        self.names = list(self.symbols)
        self.other = len(self.names)                               # any character that is in no piece
        self.of_char = np.full(0x110000, self.other, np.int32)
        for name, i in self.symbols.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.pair_place[at], _NONE), np.where(hit, self.pair_symbol[at], -1)

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in p.encode()]
        return out

    def agenda(self, text: str) -> list[int]:
        """Ids of one stretch: the best pair by (score, leftmost) is merged until none is a piece."""
        parts = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, str]] = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j < n:
                piece = parts[i] + parts[j]
                if (place := self.place.get(piece)) is not None:
                    heapq.heappush(heap, (place, i, j, piece))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != piece:
                continue                                           # one of the two has been merged meanwhile
            parts[i], parts[j] = piece, ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            propose(left[i], i)
            propose(i, right[i])
        return self.ids_of([p for p in parts if p])

    def agenda_batch(self, texts: list[str]) -> list[list[int]]:
        """`agenda` for many short stretches at once: in each round every stretch merges its best pair.

        Stretches of one width share a matrix of symbols and one of the places of their pairs;
        a merge renews only the two pairs beside it. Longer stretches take the heap.
        """
        out: list[list[int] | None] = [None] * len(texts)
        groups: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            width = next((w for w in _WIDTHS if len(t) <= w), 0)
            if width:
                groups.setdefault(width, []).append(i)
            else:
                out[i] = self.agenda(t)
        for width, members in groups.items():
            for at in range(0, len(members), 8192):
                part = members[at:at + 8192]
                for i, ids in zip(part, self._rounds([texts[i] for i in part], width)):
                    out[i] = ids
        return out

    def _rounds(self, texts: list[str], width: int) -> list[list[int]]:
        n = len(texts)
        lengths = np.array([len(t) for t in texts])
        other = self.other
        sym = np.full((n, width + 1), -1, np.int32)
        flat = self.of_char[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        sym[np.arange(width + 1) < lengths[:, None]] = flat
        unknown = [[c for c in t if c not in self.symbols] for t in texts] if (flat == other).any() else None
        place, result = self.lookup(sym[:, :-1], sym[:, 1:])
        place[np.arange(1, width + 1) >= lengths[:, None]] = _NONE
        live = np.arange(n)
        columns = np.arange(width + 1)
        while True:
            j = place[live].argmin(axis=1)
            busy = place[live, j] != _NONE
            live, j = live[busy], j[busy]
            if not len(live):
                break
            s = sym[live]
            merged = result[live, j]
            # close the gap right of the merged symbol
            take = np.minimum(columns + (columns > j[:, None]), width)
            s = np.take_along_axis(s, take, axis=1)
            s[:, width] = -1
            rows = np.arange(len(live))
            s[rows, j] = merged
            sym[live] = s
            p, r = np.take_along_axis(place[live], np.minimum(take[:, :width], width - 1), axis=1), np.take_along_axis(result[live], np.minimum(take[:, :width], width - 1), axis=1)
            p[:, width - 1] = _NONE
            for k in (j - 1, j):
                ok = k >= 0
                a, b = s[rows[ok], k[ok]], s[rows[ok], k[ok] + 1]
                pl, re_ = self.lookup(a, b)
                pl[b < 0] = _NONE
                p[rows[ok], k[ok]], r[rows[ok], k[ok]] = pl, re_
            place[live], result[live] = p, r
        names, ids = self.names, self.ids
        piece_id = np.array([ids.get(x, -1) for x in names] + [-1])
        codes = piece_id[np.maximum(sym, 0)]
        valid = sym >= 0
        bad = ((codes < 0) & valid).any(axis=1)
        ends = np.cumsum(valid.sum(axis=1)).tolist()
        flat_ids = codes[valid].tolist()
        rows_out = [flat_ids[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(bad):
            rest = iter(unknown[i]) if unknown else iter(())
            rows_out[i] = self.ids_of([next(rest) if s == other else names[s] for s in sym[i][valid[i]]])
        return rows_out


class Encoder:
    """Encodes whole texts stretch by stretch; each new stretch is encoded once, in batches, and
    checked there against the library, which then also gives the ids of any it disagrees on."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.disagreed = 0
        self._forget()

    def _forget(self) -> None:
        # flat arrays and strings only: nothing here for the garbage collector to walk
        self.memo: dict[str, int] = {}             # stretch -> its number
        self.text: list[str] = []                  # number -> ids joined by blanks
        self.flat = np.empty(1 << 20, np.int32)    # ids of all stretches, end to end
        self.end = np.zeros(STRETCH_MEMO + 1, np.int64)

    def _library(self, stretches: list[str]) -> list[list[int]]:
        # the library puts a blank before every text; a line end keeps it apart from other stretches
        lead = self.v.library.encode("\n")
        texts = [s[1:].replace(SPACE, " ") if s[0] == SPACE else "\n" + s for s in stretches]
        found = self.v.library.encode(texts, num_threads=1)
        return [f if s[0] == SPACE else f[len(lead):] for s, f in zip(stretches, found)]

    def _checked(self, stretches: list[str]) -> list[list[int]]:
        own = self.v.agenda_batch(stretches)
        some = [i for i, s in enumerate(stretches) if s != SPACE]      # the library has no text for a lone blank
        for i, theirs in zip(some, self._library([stretches[i] for i in some])):
            if own[i] != theirs:
                self.disagreed += 1
                raise ValueError(f"agenda and library disagree on {stretches[i][:80]!r}: {own[i][:20]} and {theirs[:20]}")
        return own

    def learn(self, stretches: list[str]) -> None:
        found = self._checked(stretches)
        n, at = len(self.text), int(self.end[len(self.text)])
        ids = np.array([i for f in found for i in f], np.int32)
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.int32)])
        self.flat[at:at + len(ids)] = ids
        self.end[n + 1:n + 1 + len(found)] = at + np.cumsum([len(f) for f in found])
        self.memo.update(zip(stretches, range(n, n + len(found))))
        self.text += [" ".join(map(str, f)) for f in found]

    def __call__(self, texts: list[str]) -> list[tuple[int, str, list[int]]]:
        """Per text: number of ids, the ids joined by blanks, the ids; the end id is the last."""
        if len(texts) > 1 and sum(map(len, texts)) > 4_000_000:        # long texts one by one
            return [self([t])[0] for t in texts]
        split = []
        for t in texts:
            norm = SPACE + t.replace(" ", SPACE) if t else ""
            split.append(self.v.cut.findall(norm) if self.v.cut else [norm] if norm else [])
        need = set().union(*split)
        new = [s for s in need if s not in self.memo]
        if len(self.text) + len(new) > STRETCH_MEMO and self.text:
            self._forget()
            new = list(need)
        for i in range(0, len(new), 50_000):
            if len(self.text) + 50_000 > len(self.end) - 1:
                self.end = np.concatenate([self.end, np.zeros(len(self.end), np.int64)])
            self.learn(new[i:i + 50_000])
        last, joined = self.v.end_id, str(self.v.end_id)
        out = []
        for parts in split:
            codes = list(map(self.memo.__getitem__, parts))
            c = np.array(codes, np.int64)
            size = self.end[c + 1] - self.end[c]
            total = int(size.sum())
            ids = self.flat[np.repeat(self.end[c] - np.cumsum(size) + size, size) + np.arange(total)].tolist()
            ids.append(last)
            words = list(map(self.text.__getitem__, codes))
            words.append(joined)
            out.append((total + 1, " ".join(words), ids))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a process: its memo is reused by the tasks that follow."""
    return Encoder(path)


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", keep=None) -> DataFrame:
    """Add `n_tokens`, `piece_ids` (decimal ids joined by blanks, end id last) and `decoded` (by the library).

    One map over whole texts in Arrow batches, no shuffle. A null or empty text has the end id only.
    """
    def make():
        enc = encoder(model_path)
        decode = enc.v.library.decode

        def run(texts):
            got = enc([t or "" for t in texts])
            return [g[0] for g in got], [g[1] for g in got], [decode(g[2]) for g in got]
        return run

    return map_text(docs, text, make, [("n_tokens", T.LongType()), ("piece_ids", T.StringType()), ("decoded", T.StringType())], keep)
