"""Sampled SentencePiece segmentation: forward filtering, backward sampling over the piece lattice, and exact decoding.

A text, with the model's leading space, is cut before every run of spaces; no piece of the model spans such a cut, so the
lattice of a text is the product of its units' lattices. Each distinct unit of a batch gets its lattice once, and the units
that a worker met first keep theirs for its later texts: all pieces at all positions (and byte pieces for characters that
have none), forward sums of piece weights exp(alpha * score), and at every position the distribution of the last piece. Every occurrence then draws its pieces backwards from the unit's end.
The draws come from a counter: the row's key, the unit's number in its row, and the step. Each position's distribution is
kept in integers (of 2^-40), and its sums are those of its unit alone. So a row's segmentation depends on its key, text,
model, alpha and seed only, to the last bit, not on batches, partitions or retries.

Units advance side by side, a byte a step; those of over LOCKSTEP bytes one after the other. Forward sums are scaled by
powers of two on the way, which changes no digit of them.

Decoding is exact: a literal U+2581 is never taken for the space mark, but spelled in byte pieces.
"""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .text import U64, column, hash_spans, mix, slices, trim

ALPHA = 2e-4
LOCKSTEP = 4096  # bytes of a unit that advances with others
_ALONE = 65535  # the place in its unit of a byte that doesn't
SCALE = 16  # bytes between scalings: sums stay within a double
FEW = 48  # occurrences that draw on one after the other
ONE = 1 << 40
KNOWN = 1 << 20  # edges of the lattice that a worker keeps, 16 bytes each
CHUNK = 1 << 18
MARK = "▁"
_STEP = 0x9E3779B97F4A7C15
_BASE = U64(0xC2B2AE3D27D4EB4F)
_CODE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_made: dict = {}


def _roll(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * int(_BASE) + int(_CODE[b])) & (2**64 - 1)
    return h


class Model:
    """The vocabulary as hash tables, and each piece's bytes and weight."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if len(set(self.byte.tolist())) < 256:
            raise ValueError("the model has no byte pieces")
        spelled, scores = [b""] * n, np.zeros(n)
        for b, i in enumerate(self.byte):
            spelled[i] = bytes([b])
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        worst = min((s for s in map(sp.get_score, normal) if s > -1e8), default=-1.0)
        for i in normal:
            p = sp.id_to_piece(i)
            if MARK in p.lstrip(MARK):
                raise ValueError("a piece has a space inside")
            spelled[i], scores[i] = p.replace(MARK, " ").encode(), max(sp.get_score(i), worst)
        scores[self.byte] = 2 * worst
        self.log = alpha * scores
        self.weight = np.exp(self.log)
        hashes = np.array([_roll(spelled[i]) for i in normal], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(normal)[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces are alike")
        self.longest = max(map(len, spelled))
        # by a hash's first 20 bits: 1 where a piece may be, 2 where a beginning of one may be; and the first such piece
        bits = (self.hashes >> U64(44)).astype(np.int64)
        self.kind, self.slot = np.zeros(1 << 20, np.uint8), np.zeros(1 << 20, np.int32)
        self.kind[bits] = 1
        self.kind[np.unique([_roll(x) >> 44 for x in {spelled[i][:k] for i in normal for k in range(1, len(spelled[i]) + 1)}])] |= 2
        self.slot[bits[::-1]] = np.arange(len(bits), dtype=np.int32)[::-1]
        self.alike = int(np.unique(bits, return_counts=True)[1].max()) if len(bits) else 0  # pieces with the same bits
        self.size = np.array([len(x) for x in spelled])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.known: Known | None = None


def model(path: str, alpha: float) -> Model:
    if (path, alpha) not in _made:
        _made[path, alpha] = Model(path, alpha)
    return _made[path, alpha]


def _edges(m: Model, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces within units, by the byte where they end: each byte's first (length n + 1), the pieces' length and id.
    data: the units' bytes in a row; stop: for each byte its unit's end."""
    size = len(data)
    wide = np.int32 if size * m.longest < 1 << 31 else np.int64
    at = np.arange(size, dtype=wide)
    left = np.minimum(stop - at, 255 if m.longest < 255 else 1 << 30).astype(np.uint8 if m.longest < 255 else wide)
    h = np.zeros(size, np.uint64)
    first = np.flatnonzero((data & 0xC0) != 0x80).astype(wide)
    width = np.diff(first, append=wide(size))
    whole = np.zeros(size, wide)
    whole[first] = width
    bare = np.ones(size, bool)  # characters without a piece of their own
    found, count = [], np.zeros(size, np.int32)
    for n in range(1, m.longest + 1):
        if not len(at):
            break
        h = h * _BASE + _CODE[data[at + (n - 1)]]
        bits = (h >> U64(44)).astype(np.int32)
        kind = m.kind[bits]
        maybe = np.flatnonzero(kind & 1)
        k, want = m.slot[bits[maybe]], h[maybe]
        hit = m.hashes[k] == want
        for _ in range(m.alike - 1):
            again = np.flatnonzero(~hit)
            k[again] = np.minimum(k[again] + 1, len(m.hashes) - 1)
            hit[again] = m.hashes[k[again]] == want[again]
        start = at[maybe[hit]]
        bare[start[whole[start] == n]] = False
        count[start + (n - 1)] += 1  # starts differ
        found.append((start + (n - 1), n, m.ids[k[hit]]))
        go = np.flatnonzero((kind > 1) & (left > n))
        at, h, left = at[go], h[go], left[go]
    lone = np.flatnonzero(np.repeat(bare[first], width)).astype(wide)
    count[lone] += 1
    found.append((lone, 1, m.byte[data[lone]]))
    to = np.zeros(size + 1, wide)
    np.cumsum(count, out=to[1:])
    length, piece, free = np.empty(to[-1], np.int32), np.empty(to[-1], np.int32), to[:-1].copy()
    for node, n, ids in found:
        place = free[node]
        free[node] += 1
        length[place], piece[place] = n, ids
    return to, length, piece


class Lattice:
    """For distinct units: at each byte, the pieces that may end there with their cumulative probabilities."""

    def __init__(self, m: Model, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        size = end - begin
        wide = np.int32 if len(data) * m.longest < 1 << 31 else np.int64
        stop, unit = np.repeat(end.astype(wide), size), np.repeat(begin.astype(wide), size)
        self.first, self.length, self.piece = _edges(m, data, stop)
        length, piece, each = self.length, self.piece, np.diff(self.first)
        rel = np.arange(len(data), dtype=wide)
        node = np.repeat(rel, each)
        start = node - length + 1
        rel = np.where(np.repeat(size <= LOCKSTEP, size), rel - unit, _ALONE).astype(np.uint16)
        weight, share = m.weight[piece], np.zeros(len(piece))
        self._side_by_side(m.longest, np.repeat(rel, each), start, node, unit, weight, share)
        for u in np.flatnonzero(size > LOCKSTEP):
            self._alone(m.longest, int(begin[u]), int(end[u]), start, weight, share)
        part = np.floor(share * ONE).astype(np.int64)
        total = np.cumsum(part)
        self.cumulative = total - (total - part)[self.first[node]]
        last = self.first[1:][each > 0] - 1
        # nothing lies beyond the last piece that can be reached; rounding must not step over it
        reach = np.maximum.accumulate(np.where(share > 0, np.arange(len(share)), -1))
        self.cumulative[reach[last][reach[last] >= 0]] = 2 * ONE

    @staticmethod
    def _side_by_side(longest, rel, start, node, unit, weight, share) -> None:
        forward, origin = np.zeros(len(unit)), np.ones(len(unit))  # origin: the scale of a unit's beginning
        by = np.argsort(rel, kind="stable").astype(node.dtype)  # of 16 bits: by radix
        cuts = np.concatenate([[0], np.cumsum(np.bincount(rel[rel != _ALONE]))])
        for at, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a == b:
                continue
            e = by[a:b]
            n, s = node[e], start[e]
            heads = np.flatnonzero(np.diff(n, prepend=n.dtype.type(-1)))
            if at and at % SCALE == 0:
                # units whose last sums have become small: scaled up, back to the longest piece
                ends = n[heads]
                back = ends[:, None] - np.arange(1, min(longest, at) + 1)
                top = np.frexp(forward[back].max(axis=1))[1]
                low = top < -64
                if low.any():
                    forward[back[low]] = np.ldexp(forward[back[low]], -top[low][:, None])
                    if at < longest:
                        origin[unit[ends[low]]] = np.ldexp(origin[unit[ends[low]]], -top[low])
            c = np.where(s == unit[n], origin[s], forward[s - 1]) * weight[e]
            total = np.add.reduceat(c, heads)
            forward[n[heads]] = total
            total = np.repeat(total, np.diff(heads, append=len(n)))
            share[e] = c / np.where(total > 0, total, 1.0)

    def _alone(self, longest, begin, end, start, weight, share) -> None:
        lo, hi = int(self.first[begin]), int(self.first[end])
        cuts, back = (self.first[begin : end + 1] - lo).tolist(), (start[lo:hi] - begin).tolist()
        w, out = weight[lo:hi].tolist(), [0.0] * (hi - lo)
        forward = [0.0] * (end - begin + 1)  # forward[k]: the sum over the first k bytes
        forward[0] = 1.0
        a = 0
        for k, b in enumerate(cuts[1:], 1):
            if b - a == 1:
                c = forward[back[a]] * w[a]
                forward[k] = c
                if c > 0:
                    out[a] = 1.0
            elif b > a:
                c = [forward[x] * y for x, y in zip(back[a:b], w[a:b])]
                total = sum(c)
                forward[k] = total
                if total > 0:
                    out[a:b] = [x / total for x in c]
            if k % SCALE == 0:
                first = max(0, k - longest)
                top = max(forward[first : k + 1])
                if top < 1e-20:
                    forward[first : k + 1] = np.ldexp(forward[first : k + 1], -int(np.frexp(top)[1])).tolist()
            a = b
        share[lo:hi] = out


    def walk(self, node: int, low: int, key: np.uint64, step: int) -> np.ndarray:
        """The pieces that a unit's occurrence draws backwards from node on; step: the pieces it has drawn."""
        lo, hi = int(self.first[low]), int(self.first[node + 1])
        cuts, cumulative, length = (self.first[low : node + 1] - lo).tolist(), self.cumulative[lo:hi].tolist(), self.length[lo:hi].tolist()
        at, out, draws = node - low, [], []
        while at >= 0:
            if not draws:
                n = min(4096, at + 1)
                draws = (mix(key + np.arange(step, step + n, dtype=np.uint64) * U64(_STEP)) >> U64(24)).tolist()[::-1]
                step += n
            u, e = draws.pop(), cuts[at]
            while cumulative[e] <= u:
                e += 1
            out.append(e)
            at -= length[e]
        return self.piece[lo + np.array(out, np.int64)].astype(np.int32)

    def draw(self, occ: np.ndarray, node: np.ndarray, low: np.ndarray, key: np.ndarray, counts: np.ndarray) -> tuple[list, list]:
        """Draws pieces backwards for the occurrences occ, of units from low to node, and counts them. For each step the
        occurrences still on and their pieces; and what the last few drew after these."""
        took, step = [], 0
        while len(occ) > FEW:
            u = (mix(key[occ] + U64(step * _STEP & (2**64 - 1))) >> U64(24)).astype(np.int64)
            e = self.first[node]
            more = np.flatnonzero(self.cumulative[e] <= u)
            while len(more):
                e[more] += 1
                more = more[self.cumulative[e[more]] <= u[more]]
            took.append((occ, self.piece[e]))
            counts[occ] += 1
            node = node - self.length[e]
            on = np.flatnonzero(node >= low)
            occ, node, low = occ[on], node[on], low[on]
            step += 1
        tails = [(o, self.walk(int(v), int(a), key[o], step)) for o, v, a in zip(occ, node, low)]
        for o, x in tails:
            counts[o] += len(x)
        return took, tails


class Known:
    """The units that a worker met first, and their lattice, for its later texts: most of these hold the same units again. A
    unit's distributions are the same wherever it is met, so this changes no draw. KNOWN edges at most."""

    def __init__(self, before: Known | None, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, lattice: Lattice):
        if before:
            a, b, lattice = before.lattice, lattice, copy.copy(lattice)
            hashes, size = np.concatenate([before.hashes, hashes]), np.concatenate([before.size, size])
            begin = np.concatenate([before.begin, begin + len(a.first) - 1])
            lattice.first = np.concatenate([a.first, b.first[1:] + a.first[-1]])
            lattice.piece, lattice.length, lattice.cumulative = (np.concatenate([getattr(a, k), getattr(b, k)]) for k in ("piece", "length", "cumulative"))
        order = np.argsort(hashes)
        self.hashes, self.begin, self.size, self.lattice = hashes[order], begin[order], size[order], lattice

    def find(self, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The units' places here; -1: not here."""
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[k] == hashes) & (self.size[k] == size), k, -1)


def segment(m: Model, texts: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled pieces of each text: all ids in a row, and each text's first (length n + 1). An empty text has none."""
    n = len(at) - 1
    size = np.diff(at)
    lead = (size > 0).astype(np.int64)
    to = np.concatenate([[0], np.cumsum(size + lead)])
    data = np.full(to[-1], 32, np.uint8)
    keep = np.ones(len(data), bool)
    keep[to[:-1][lead > 0]] = False
    data[keep] = texts
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    space = data == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[to[:-1][lead > 0]] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(data))
    row = np.searchsorted(to, begin, "right") - 1
    number = np.arange(len(begin)) - np.searchsorted(begin, to[:-1])[row]
    hashes = hash_spans(data, begin, end, lower=False)
    which = pa.array(hashes).dictionary_encode().indices.to_numpy()
    index = np.zeros(which.max() + 1, np.int64)
    index[which[::-1]] = np.arange(len(which))[::-1]  # each unit's first occurrence
    hashes, length = hashes[index], (end - begin)[index]
    known = m.known
    place = known.find(hashes, length) if known else np.full(len(index), -1)
    new = np.flatnonzero(place < 0)
    low = known.begin[place] if known else np.zeros(len(index), np.int64)
    size = length[new]
    low[new] = np.cumsum(size) - size
    source = np.arange(size.sum()) + np.repeat(begin[index[new]] - low[new], size)
    fresh = Lattice(m, data[source], low[new], low[new] + size)
    key = mix(seeds[row] + mix(number.astype(U64)))
    first, last = low[which], low[which] + length[which] - 1
    old = place[which] >= 0
    counts, drawn = np.zeros(len(begin), np.int64), []
    for lattice, occ in ((fresh, np.flatnonzero(~old)), (known and known.lattice, np.flatnonzero(old))):
        if len(occ):
            drawn.append(lattice.draw(occ, last[occ], first[occ], key, counts))
    ends = np.cumsum(counts)
    ids = np.empty(ends[-1], np.int32)
    for took, tails in drawn:
        for s, (o, piece) in enumerate(took):
            ids[ends[o] - 1 - s] = piece
        for o, x in tails:
            ids[ends[o] - counts[o] : ends[o] - len(took)] = x[::-1]
    if len(new) and len(fresh.piece) + (len(known.lattice.piece) if known else 0) <= KNOWN:
        m.known = Known(known, hashes[new], low[new], size, fresh)
    before = np.concatenate([[0], ends])
    return ids, before[np.searchsorted(begin, to)]


def join(m: Model, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that pieces spell, without each text's leading space, and each text's offset (length n + 1)."""
    size = m.size[ids]
    end = np.cumsum(size)
    data = m.flat[np.arange(end[-1] if len(end) else 0) + np.repeat(m.start[ids] - (end - size), size)]
    at = np.concatenate([[0], end])[first]
    keep = np.ones(len(data), bool)
    full = np.diff(at) > 0
    keep[at[:-1][full]] = False
    return data[keep], at - np.concatenate([[0], np.cumsum(full)])


def _seeds(ids: list, seed: int) -> np.ndarray:
    return mix(np.array([0x5DEECE66D if i is None else (i * 2 + 1) & (2**64 - 1) for i in ids], np.uint64) + mix(np.array([seed], np.uint64)))


def _encode(path: str, alpha: float, seed: int, arrays: bool):
    names = ["doc_id", "n_bytes", "n_pieces", "ids" if arrays else "ids_sha256", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # what earlier stages left in this worker
        m = model(path, alpha)
        for whole in batches:
            yield from parts(m, whole)
            del whole
            trim()

    def parts(m: Model, whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in slices(whole, "text", CHUNK):
            data, at = column(b.column(1))
            ids, first = segment(m, data, at, _seeds(b.column(0).to_pylist(), seed))
            back, to = join(m, ids, first)
            if len(back) == len(data) and (to == at).all() and (back == data).all():
                same = [True] * b.num_rows
            else:
                same = [back[to[i] : to[i + 1]].tobytes() == data[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)]
            if arrays:
                out = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
            else:
                raw = ids.astype("<i4")
                out = pa.array([hashlib.sha256(raw[first[i] : first[i + 1]].tobytes()).hexdigest() for i in range(b.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(np.diff(first)), out, pa.array(same, pa.bool_())], names)

    return run


def sample_pieces(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = 1, arrays: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids (or ids_sha256 of the 32-bit little-endian ids), lossless for every row of docs.

    lossless: decoding the ids gives the text again. A null or empty text has no pieces. Rows without doc_id share one
    seed; rows that repeat an id and a text have the same pieces. Other columns are ignored; an empty table gives an empty
    result.
    """
    ship(docs.sparkSession)
    last = "ids array<int>" if arrays else "ids_sha256 string"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(path, alpha, seed, arrays), f"doc_id long, n_bytes long, n_pieces long, {last}, lossless boolean")


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with a column text: what the ids spell. Null ids give null; a column of that name is replaced."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def decoded(s):
        import pandas as pd

        m, out = model(path, ALPHA), []
        for x in s:
            if x is None:
                out.append(None)
                continue
            x = np.asarray(x, np.int64)
            out.append(join(m, x, np.array([0, len(x)]))[0].tobytes().decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    return df.withColumn(text, decoded(F.col(ids)))
