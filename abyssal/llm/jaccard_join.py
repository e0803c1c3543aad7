"""Operator 3: n-gram Jaccard join by parity sketches.

A document's set are its distinct k-word shingles. Documents of one set are one class; only classes are compared.

Sketch. Tokens of a set are dealt by their hash to N cells of 64 bits, and the hashes in a cell are XORed. A token in only
one of two sets changes one cell, so the number of cells that differ is at most the symmetric difference. Sets of a and b
tokens with similarity t or more differ in at most (1-t)/(1+t) * (a+b) tokens, which is (1-t)/t * a for the smaller set.
For the larger set of b tokens it is (1-t)/(1+t) * (b+m), m the largest size of a smaller partner. N depends on the size
band by one rule for all sizes (``Bands.cells``); a set is sketched for its own band and, near the lower end, for the band
below, where m is that band's top. By the pigeonhole principle two similar sets share a cell, in fact at least p - d, for
p cells that are not empty and d tokens of difference.

Candidates. Cells are shuffled packed, in buckets by cell hash, and grouped in numpy. A cell of up to ``light`` classes
is a light group. A cell of more is heavy (common passages, or a large group of copies); map tasks split off its surplus
before the shuffle. Of a class's cells in the order of their numbers of classes only the first d+1 matter: the rarest cell
that two similar classes share is among these in both, as at most d cells of either are not shared. Cells that no other
class has come first in that order, so a class keeps t - (p - d - 1) of its t shared cells, the rarest, and mostly none.

Stars first: classes of equal minimum under one of a few hash functions are compared with the least of them, which makes a
large group of copies one component. Then the members of cells, packed, are dealt by class, where they learn component, size
and a short sketch and leave the cells that do not matter, and back by cell. A cell of one component is passed over. In
others, members of different components are compared by size and sketch, in numpy: all of a light cell, and what is outside
the main component of a heavy one with all. This is done three times, for each class in a few of its cells with those of
nearest sketch, so in all its cells, and, when these have joined what is alike, in all its cells with all. Thus every pair that shares a deciding cell is compared or already connected. A
cell of very many saturated classes is cut into packs, each pair of which is a group of its own.

Verification. Sizes, then parity sketches (1,024 bits, and 16,384 for large sets), whose Hamming distance also bounds the
symmetric difference from below, rule out most candidates; the rest are compared exactly, from the shingles of the texts.

Shingles, sets and cells are compared by 64-bit hashes. N leaves a set fewer than d+1 non-empty cells with a probability
under 1e-12.

Defined results: a null or empty text, or one without words, has no shingles, is linked with nothing and is its own
component; with fewer than k words, the whole sequence is the one shingle; doc_ids that repeat are nodes of their own
text's class each; a null doc_id has the component of its class (null when all ids of it are null); extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abyssal.llm import textkit
from abyssal.llm.common import materialise, ship, small_or_plain, tidy
from abyssal.llm.components import components
from abyssal.llm.packing import bucket_of, dealt, gathered, runs
from abyssal.llm.textkit import U64, mix

_SKETCH_BITS = 1024
#: Sets larger than this have a second sketch of so many bits, as the first one fills up.
_WIDE_FROM, _WIDE_BITS = 1000, 16384
#: The first sketch as it travels with deciding cells, folded by XOR; a token still changes one bit of it.
_SHORT_BITS = 256
_NO_ID = -(1 << 63)
_CELL = U64(0x9E6C63D0876A9A47)
_CLASS = U64(0x3C79AC492BA7B653)
_MULT = [U64(x) for x in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0xF1357AEA2E62A9C5)]


class Bands:
    """Size bands for a threshold of ``num`` per cent."""

    def __init__(self, num: int, ratio: float = 2.0):
        self.num, self.ratio = num, ratio
        self._cells: dict[int, int] = {}

    def of(self, n: int) -> int:
        return int(math.log(n) / math.log(self.ratio) + 1e-9)

    def top(self, band: int) -> int:
        """The largest size in the band."""
        return max(1, math.ceil(self.ratio ** (band + 1)) - 1)

    def cells(self, band: int) -> int:
        """Cells of the band's sketches: a share of its largest size, and so many that no set leaves too few non-empty.

        n tokens fill d cells or fewer of N with a probability of at most C(N, d) * (d/N)^n; N is the least for which
        that is under 1e-12 at all sizes sketched in the band (from some size on, the share is the larger).
        """
        if band not in self._cells:
            top = self.top(band)
            least = max(1, int(top * max(0.36, 1.45 * (100 - self.num) / self.num)))
            wants = [(n, d) for n in range(math.ceil(self.ratio**band), min(100 * top // self.num, 400) + 1) for g, d in self.roles(n) if g == band and d]
            rare = lambda c: all(c > d and math.lgamma(c + 1) - math.lgamma(d + 1) - math.lgamma(c - d + 1) + n * math.log(d / c) < -27.6 for n, d in wants)
            while not rare(least):
                least = least + 1 + least // 16
            self._cells[band] = least
        return self._cells[band]

    def roles(self, n: int) -> list[tuple[int, int]]:
        """(band, largest symmetric difference to a partner) under which a set of n tokens is sketched.

        In its own band it may be the smaller set; in the band below its partners have that band's top size at most.
        """
        band = self.of(n)
        out = [(band, (100 - self.num) * n // self.num)]
        if band and self.num * n <= 100 * self.top(band - 1):
            out.append((band - 1, (100 - self.num) * (n + self.top(band - 1)) // (100 + self.num)))
        return out


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashed, per = textkit.words(data, offsets)
    grams, per = textkit.shingles(hashed, per, k)
    ends = np.cumsum(per)
    for a, b in zip((ends - per).tolist(), ends.tolist()):
        s = np.sort(grams[a:b])
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if b > a else s


def class_of(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int(mix(np.array([np.add.reduce(mix(s ^ _CLASS)) + U64(len(s))], U64)).view(np.int64)[0])


def cell_hashes(s: np.ndarray, band: int, n_cells: int) -> np.ndarray:
    """Hashes of the cells that are not empty."""
    salt = mix(np.array([band + 1], U64))[0]
    dealt = mix(s + _CELL + salt)
    cell = ((dealt >> U64(32)) * U64(n_cells)) >> U64(32)
    order = np.argsort(cell, kind="stable")
    c = cell[order]
    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return mix(np.bitwise_xor.reduceat(mix(s ^ salt)[order], starts) ^ c[starts] * _CELL)


def sketched(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, int]:
    """The cells of a set under all its roles, and p - d - 1 of the role where that is least."""
    cells, slack = [], []
    for g, d in bands.roles(len(s)):
        cells.append(cell_hashes(s, g, bands.cells(g)))
        slack.append(len(cells[-1]) - d - 1)
    return np.concatenate(cells), min(slack)


def parity_sketch(s: np.ndarray, bits: int = _SKETCH_BITS) -> bytes:
    bits = np.bincount((mix(s + _CELL) >> U64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def minima(s: np.ndarray) -> list[int]:
    """The least hash of the set under each of a few functions."""
    return [int((s * m).min().view(np.int64)) for m in _MULT]


def _profile(k: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.buffers(batch.column(2))
            n, cls, least, sketch, wide, short = [], [], [], [], [], []
            for a, b in textkit.steps(offsets):
                for s in sets_of(data, offsets[a : b + 1], k):
                    n.append(len(s))
                    cls.append(class_of(s) if len(s) else None)
                    least.append(minima(s) if len(s) else None)
                    sketch.append(parity_sketch(s) if len(s) else None)
                    wide.append(parity_sketch(s, _WIDE_BITS) if len(s) > _WIDE_FROM else None)
                    short.append(np.bitwise_xor.reduce(np.frombuffer(sketch[-1], U64).reshape(-1, _SHORT_BITS // 64)).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(wide, pa.binary()), pa.array(short, pa.binary())], names=["id", "th", "n", "cls", "minima", "sketch", "wide", "short"])

    return run


_FOUND = ["", "heavy_cell", "heavy_cls", "heavy_slack"]
_LONGS = pa.list_(pa.int64())


def _heavy(cells: np.ndarray, cls: np.ndarray, slack: np.ndarray, most: int = 128) -> list[pa.Array]:
    """Columns (cell, up to ``most`` of its classes, their slacks) from sorted cells."""
    starts, sizes = runs(cells)
    cuts = np.concatenate([np.arange(a, a + n, most) for a, n in zip(starts.tolist(), sizes.tolist())]) if len(starts) else np.zeros(0, np.int64)
    at = np.concatenate([cuts, [len(cells)]]).astype(np.int32)
    return [pa.array(cells[cuts].view(np.int64)), pa.ListArray.from_arrays(at, cls), pa.ListArray.from_arrays(at, slack.astype(np.int64))]


def _cells(k: int, bands: Bands, buckets: int, light: int, chunk: int = 1_000_000):
    """Map side: packed (bucket, classes, slacks, counts, cell hashes), and rows of cells that are heavy within one chunk."""
    names = ["bucket", "cls", "slack", "counts", "cells", *_FOUND[1:]]
    types = [pa.int32(), *[pa.binary()] * 4, pa.int64(), _LONGS, _LONGS]

    def flush(held: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cells = np.concatenate([x for _, _, x in held])
        owner = np.repeat(np.arange(len(held)), [len(x) for _, _, x in held])
        classes, slacks = np.array([c for c, _, _ in held], np.int64), np.array([t for _, t, _ in held], np.int32)
        order = np.argsort(cells, kind="stable")
        starts, sizes = runs(cells[order])
        rank = np.arange(len(cells)) - np.repeat(starts, sizes)
        surplus = np.zeros(len(cells), bool)
        surplus[order] = rank > light  # light + 1 of them stay, and show the cell to be heavy
        if surplus.any():
            more = order[surplus[order]]
            columns = _heavy(cells[more], classes[owner[more]], slacks[owner[more]])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), t) for t in types[:5]] + columns, names=names)
            cells, owner = cells[~surplus], owner[~surplus]
        bucket = bucket_of(cells, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, cells, owner = bucket[order], cells[order], owner[order]
        out: list[list] = [[] for _ in types[:5]]
        for a, m in zip(*(x.tolist() for x in runs(bucket))):
            s, c = runs(owner[a : a + m])
            mine = owner[a : a + m][s]
            for column, value in zip(out, (int(bucket[a]), classes[mine].tobytes(), slacks[mine].tobytes(), c.astype("<u2").tobytes(), cells[a : a + m].tobytes())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)] + [pa.nulls(len(out[0]), t) for t in types[5:]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        seen: set[int] = set()
        total = 0
        for batch in batches:
            data, offsets = textkit.buffers(batch.column(0))
            for a, b in textkit.steps(offsets):
                for s in sets_of(data, offsets[a : b + 1], k):
                    if not len(s) or (c := class_of(s)) in seen:
                        continue
                    seen.add(c)
                    cells, slack = sketched(s, bands)
                    for i in range(0, len(cells), 65_000):
                        held.append((c, slack, cells[i : i + 65_000]))
                    total += len(cells)
                    if total >= chunk:
                        yield from flush(held)
                        held, total = [], 0
                        if len(seen) > 1_000_000:
                            seen.clear()
        if held:
            yield from flush(held)

    return run


_ENTRY = ["cls", "cell", "cnt", "slack"]
#: An entry's cnt holds its cell's number of classes in so many bits, and above them for how many cells of these classes it stands.
_COUNT_BITS = 40


def _by_class(columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Entries (class, cell, its count and weight, slack) dealt by class."""
    return dealt(bucket_of(mix(columns[0].view(U64)), buckets), columns, _ENTRY)


def _groups(light: int, buckets: int):
    """Reduce side: members of light cells packed by class, heavy cells as rows. A task holds its own buckets' cells."""

    def loose_rows(columns: list[pa.Array]) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary()) for _ in _ENTRY], *columns], names=["bucket", *_ENTRY, *_FOUND[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, cls, slack = [], [], []
        for batch in batches:
            loose = batch.column(0).is_null()
            if loose.true_count:  # heavy rows of the map side, as they are
                rest = batch.filter(loose)
                yield loose_rows([rest.column(i) for i in (5, 6, 7)])
                batch = batch.filter(pc.invert(loose))
            for c, t, n, x in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                n = np.frombuffer(n, "<u2")
                cells.append(np.frombuffer(x, U64))
                cls.append(np.repeat(np.frombuffer(c, np.int64), n))
                slack.append(np.repeat(np.frombuffer(t, np.int32), n))
        if not cells:
            return
        cells, cls, slack = np.concatenate(cells), np.concatenate(cls), np.concatenate(slack)
        order = np.argsort(cells, kind="stable")
        cells, cls, slack = cells[order], cls[order], slack[order]
        starts, sizes = runs(cells)
        wide = np.repeat(sizes > 1, sizes)
        cells, cls, slack = cells[wide], cls[wide], slack[wide]
        order = np.lexsort((cls, cells))
        cells, cls, slack = cells[order], cls[order], slack[order]
        if not len(cells):
            return
        fresh = np.concatenate([[True], (cells[1:] != cells[:-1]) | (cls[1:] != cls[:-1])])
        cells, cls, slack = cells[fresh], cls[fresh], slack[fresh]
        starts, sizes = runs(cells)
        heavy = np.repeat(sizes > light, sizes)
        if heavy.any():
            yield loose_rows(_heavy(cells[heavy], cls[heavy], slack[heavy]))
        # of light cells with the same members, one
        few = (sizes > 1) & (sizes <= light)
        digest = mix(np.add.reduceat(mix(cls.view(U64) ^ _CLASS), starts) + sizes.astype(U64)) if len(starts) else np.zeros(0, U64)
        stand = np.zeros(len(starts), np.int64)  # for how many cells one stands
        some = np.flatnonzero(few)
        _, first, like = np.unique(digest[some], return_index=True, return_counts=True)
        stand[some[first]] = like
        keep = np.repeat(stand > 0, sizes)
        if keep.any():
            weight = np.repeat(stand << _COUNT_BITS | sizes, sizes)[keep]
            found = _by_class([cls[keep], cells[keep].view(np.int64), weight, slack[keep].astype(np.int64)], buckets)
            yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, pa.int64()), *[pa.nulls(found.num_rows, _LONGS)] * 2], names=["bucket", *_ENTRY, *_FOUND[1:]])

    return run


def _turn(buckets: int):
    """Heavy rows (cell, classes, slacks, count of the cell) dealt by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            per = pc.list_value_length(batch.column(1)).to_numpy()
            cls, slack = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            cell, cnt = (np.repeat(batch.column(i).to_numpy(), per) for i in (0, 3))
            cnt = cnt | 1 << _COUNT_BITS
            yield _by_class([cls, cell, cnt, slack], buckets)

    return run


def _known(buckets: int):
    """Classes (class, component, size, short sketch) dealt by class, under the names of entries, with no bytes for slacks of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cls, comp, size = (batch.column(i).to_numpy() for i in range(3))
                sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), U64).reshape(batch.num_rows, -1)
                yield dealt(bucket_of(mix(cls.view(U64)), buckets), [cls, comp, size, sketch], _ENTRY)

    return run


def _decide(buckets: int, most: int, only: int | None = None):
    """Entries and classes of the same buckets -> entries (key, class, component, size, sketch) dealt by cell.

    Of a class's shared cells, rarest first, it leaves the last p - d - 1, and all when it has no more: two similar classes
    share p - d or more, so the rarest that they share is in what either keeps. With ``only``, it takes part in so many of
    these cells. A cell of more than ``most`` classes is cut
    into packs; each pair of packs is a key of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[pa.RecordBatch] = []
        classes_: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column(1)
            for flag, part in ((0, entries), (1, classes_)):
                mine = batch.filter(pc.equal(of, flag))
                if mine.num_rows:
                    part.append(mine.drop_columns(["kind"]))
        cls, cell, cnt, slack = gathered(iter(entries), [np.int64] * 4)
        known, comp, size, sketch = gathered(iter(classes_), [np.int64, np.int64, np.int64, (U64, _SHORT_BITS // 64)])
        if not len(cls):
            return
        order = np.argsort(known)
        known, comp, size, sketch = known[order], comp[order], size[order], sketch[order]
        weight, cnt = cnt >> _COUNT_BITS, cnt & (1 << _COUNT_BITS) - 1
        order = np.lexsort((cell, cnt, cls))
        cls, cell, cnt, slack, weight = cls[order], cell[order], cnt[order], slack[order], weight[order]
        fresh = np.concatenate([[True], (cls[1:] != cls[:-1]) | (cell[1:] != cell[:-1])])
        cls, cell, cnt, slack, weight = cls[fresh], cell[fresh], cnt[fresh], slack[fresh], weight[fresh]
        starts, sizes = runs(cls)
        total = np.add.reduceat(weight, starts)
        upto = np.cumsum(weight)
        before = upto - weight - np.repeat(upto[starts] - weight[starts], sizes)
        inside = before < np.repeat(total - np.maximum(slack[starts], 0), sizes)
        keep = np.add.reduceat(inside.astype(np.int64), starts)  # the first so many of each class
        if only is None:
            at = np.arange(int(keep.sum())) - np.repeat(np.cumsum(keep) - keep, keep) + np.repeat(starts, keep)
        else:  # so many of them, at even distances
            some = np.flatnonzero(keep)
            at = np.unique(np.concatenate([starts[some] + np.maximum(keep[some] * (j + 1) // only - 1, 0) for j in range(only)]))
        cls, cell, cnt = cls[at], cell[at].view(U64), cnt[at]
        packs = np.maximum(-(-cnt // most), 1)
        own = (mix(cls.view(U64) ^ _CLASS) >> U64(33)).astype(np.int64) % packs
        again = np.repeat(np.arange(len(cls)), packs)
        other = np.arange(len(again)) - np.repeat(np.cumsum(packs) - packs, packs)
        low, high = np.minimum(own[again], other), np.maximum(own[again], other)
        key = mix(cell[again] ^ mix((low * packs[again] + high).astype(U64)))
        cls = cls[again]
        of = np.searchsorted(known, cls)
        yield dealt(bucket_of(key, buckets), [key, cls, comp[of], size[of], sketch[of]], ["key", "cls", "comp", "size", "sketch"])

    return run


def _odd(num: int, light: int, buckets: int, nearest: int | None = None):
    """Pairs of a cell's classes in different components that sizes and sketches allow, packed and dealt by pair.

    In small groups all across components, in others those outside the main component with all. ``nearest``: for each class
    only the so many of nearest sketch.
    """

    def allowed(i: np.ndarray, j: np.ndarray, comp: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j]))
        i, j = i[keep], j[keep]
        apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
        keep = apart <= (100 - num) * (size[i] + size[j]) // (100 + num)
        i, j, apart = i[keep], j[keep], apart[keep]
        if nearest is not None and len(i):
            order = np.lexsort((apart, i))
            i, j = i[order], j[order]
            starts, sizes = runs(i)
            few = np.arange(len(i)) - np.repeat(starts, sizes) < nearest
            i, j = i[few], j[few]
        return i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cls, comp, size, sketch = gathered(batches, [U64, np.int64, np.int64, np.int64, (U64, _SHORT_BITS // 64)])
        order = np.lexsort((size, key))
        key, cls, comp, size, sketch = key[order], cls[order], comp[order], size[order], sketch[order]
        if not len(key):
            return
        starts, sizes = runs(key)
        mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        out: list[np.ndarray] = []

        def add(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(i):
                out.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], 1))
            if sum(map(len, out)) > 200_000:
                yield _pairs(out, buckets)
                out.clear()

        small = np.repeat(mixed & (sizes <= light), sizes)
        left = np.where(small, np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1, 0)  # members that follow in the same group
        ends = np.cumsum(left)
        for a in range(0, int(ends[-1]), 2_000_000):  # so many pairs at a time
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(ends, min(a + 2_000_000, int(ends[-1])), "left") + 1
            per = left[lo:hi].copy()
            i = np.repeat(np.arange(lo, hi), per)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(per) - per, per)
            yield from add(*allowed(i, j, comp, size, sketch))
        for a, m in zip(starts[mixed & (sizes > light)].tolist(), sizes[mixed & (sizes > light)].tolist()):
            kinds, counts = np.unique(comp[a : a + m], return_counts=True)
            n = size[a : a + m]
            for i in np.flatnonzero(comp[a : a + m] != kinds[counts.argmax()]).tolist():
                lo, hi = np.searchsorted(100 * n, num * n[i], "left"), np.searchsorted(num * n, 100 * n[i], "right")
                yield from add(*allowed(np.full(hi - lo, a + i), np.arange(a + lo, a + hi), comp, size, sketch))
        if out:
            yield _pairs(out, buckets)

    return run


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without repeats."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[fresh], b[fresh]


def _pairs(parts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    both = np.concatenate(parts)
    a, b = _once(both[:, 0], both[:, 1])
    return dealt(bucket_of(mix(a.view(U64) ^ mix(b.view(U64))), buckets), [a, b], ["a", "b"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs of whole buckets -> a row per pair: one that shares many cells is met in as many tasks."""
    a, b = _once(*gathered(batches, [np.int64, np.int64]))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _close(num: int):
    """Rows whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            most = (100 - num) * (batch.column(6).to_numpy() + batch.column(7).to_numpy()) // (100 + num)
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U64).reshape(batch.num_rows, -1) for c in (8, 9))
            keep = np.flatnonzero(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in range(8)], names=batch.schema.names[:8])

    return run


def _verify(num: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def set_of(c: int, column: pa.Array, i: int) -> np.ndarray:
            if c not in kept:
                if len(kept) > 256:
                    kept.clear()
                data, offsets = textkit.buffers(column.slice(i, 1))
                kept[c] = next(sets_of(data, offsets, k))
            return kept[c]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i in range(len(a)):
                x, y = set_of(a[i], batch.column(2), i), set_of(b[i], batch.column(3), i)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= num * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(j).take(pa.array(good, pa.int64())) for j in (0, 1)], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, reps: DataFrame, texts: DataFrame, num: int, k: int) -> DataFrame:
    """The pairs (a, b) of classes that link. ``texts``: (id, th, text); a class is read from its least (id, th)."""
    pair = ["a", "b", "ia", "ta", "ib", "tb", "na", "nb"]
    close = lambda df: df.select(*pair, "sa", "sb").mapInArrow(tidy(_close(num)), ", ".join(f"{c} long" for c in pair))
    side = lambda x: reps.select(F.col("cls").alias(x), F.col("rep.i").alias(f"i{x}"), F.col("rep.t").alias(f"t{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = materialise(close(both.where(F.lit(100) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb"))), "close")
    # the wide sketches travel only for the pairs that the narrow ones leave
    large = F.least("na", "nb") > _WIDE_FROM
    wide = lambda x: reps.where("wide is not null").select(F.col("cls").alias(x), F.col("wide").alias(f"s{x}"))
    both = both.where(~large).union(close(both.where(large).join(wide("a"), "a").join(wide("b"), "b")))
    both = materialise(both.select("a", "b", "ia", "ta", "ib", "tb"), "candidates")
    needed = materialise(both.select(F.col("ia").alias("id"), F.col("ta").alias("th")).union(both.select("ib", "tb")).distinct(), "needed")
    rows = needed.count()
    used = texts.join(small_or_plain(needed, rows, 1_000_000), ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    one = used.select(F.col("id").alias("ia"), F.col("th").alias("ta"), F.col("text").alias("xa"))
    two = used.select(F.col("id").alias("ib"), F.col("th").alias("tb"), F.col("text").alias("xb"))
    full = both.join(one, ["ia", "ta"]).join(two, ["ib", "tb"])
    return materialise(full.select("a", "b", "xa", "xb").mapInArrow(tidy(_verify(num, k)), "a long, b long"), "links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, light: int = 48, pack: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, th, n, cls), a row per row of docs; links (a, b), pairs of class ids that link.

    th is xxhash64 of the text. Links hold all that components need: each pair of linking classes is listed or connected
    through listed ones.
    """
    spark = docs.sparkSession
    ship(spark)
    bands = Bands(percent)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    table = materialise(rows.mapInArrow(tidy(_profile(k, bands)), "id long, th long, n long, cls long, minima array<long>, sketch binary, wide binary, short binary"), "members")
    members = table.select("id", "th", "n", "cls")
    reps = materialise(table.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.coalesce("id", F.lit(_NO_ID)).alias("i"), F.col("th").alias("t"))).alias("rep"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), F.first("short").alias("short")), "classes")
    total = members.agg(F.sum("n")).first()[0] or 0
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, total // 4_000_000 + 1)
    packed = rows.select("text").mapInArrow(tidy(_cells(k, bands, buckets, light)), "bucket int, cls binary, slack binary, counts binary, cells binary, heavy_cell long, heavy_cls array<long>, heavy_slack array<long>")
    spread = packed.repartition(buckets, F.coalesce("bucket", F.xxhash64("heavy_cell", "heavy_cls")))
    entry = ", ".join(f"{c} binary" for c in _ENTRY)
    found = materialise(spread.mapInArrow(tidy(_groups(light, buckets)), f"bucket int, {entry}, heavy_cell long, heavy_cls array<long>, heavy_slack array<long>"), "cells")
    heavy = found.where("heavy_cell is not null").select("heavy_cell", "heavy_cls", "heavy_slack")
    counts = heavy.groupBy("heavy_cell").agg(F.sum(F.size("heavy_cls")).alias("cnt"))
    turned = heavy.join(counts, "heavy_cell").select("heavy_cell", "heavy_cls", "heavy_slack", "cnt").mapInArrow(tidy(_turn(buckets)), f"bucket int, {entry}")
    entries = materialise(found.where("bucket is not null").select("bucket", *_ENTRY).union(turned), "entries").select("bucket", F.lit(0).alias("kind"), *_ENTRY)
    texts = rows.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    # stars: classes of equal minima around their least one
    least = reps.select("cls", F.posexplode("minima").alias("f", "u"))
    centres = least.groupBy("f", "u").agg(F.min("cls").alias("o"), F.max("cls").alias("last")).where("o <> last").select("f", "u", "o")
    alike = least.join(centres, ["f", "u"]).where("o <> cls").select(F.least("o", "cls").alias("a"), F.greatest("o", "cls").alias("b")).distinct()
    links = _linked(alike, reps, texts, percent, k)
    # what the stars left open: first each class with its nearest, in a few cells and in all, then all
    for only, nearest in ((4, 2), (None, 2), (None, None)):
        comp = components(links)
        known = reps.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "n", "short")
        known = known.mapInArrow(tidy(_known(buckets)), f"bucket int, {entry}").select("bucket", F.lit(1).alias("kind"), *_ENTRY)
        met = entries.union(known).repartition(buckets, "bucket").mapInArrow(tidy(_decide(buckets, pack, only)), "bucket int, key binary, cls binary, comp binary, size binary, sketch binary")
        pairs = met.repartition(buckets, "bucket").mapInArrow(tidy(_odd(percent, light, buckets, nearest)), "bucket int, a binary, b binary")
        pairs = pairs.repartition(buckets, "bucket").mapInArrow(tidy(_distinct), "a long, b long")
        links = links.union(_linked(pairs, reps, texts, percent, k))
    return members, links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, light: int = 48, pack: int = 50_000) -> DataFrame:
    """(id_col, text_hash, n_shingles, class_id, component_id), a row per row of docs.

    class_id is the digest of the document's set, null when empty; component_id the least id reachable by links.
    """
    members, links = classes(docs, id_col, text_col, k, percent, light, pack)
    comp = components(links)
    least = members.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"))
    named = least.join(comp.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = named.join(lowest, "comp").select("cls", "comp", "component_id")
    out = members.join(by_class, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.col("comp").alias("group_id"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without near copies: of each group the row of least (id, text hash) stays, null ids last; its own columns only.

    Rows without shingles stay. Rows that repeat the id and text that stay are copies of each other: one of them stays, of
    those the least in the order of their columns' hash.
    """
    id_, th = F.col(id_col).cast("long"), F.xxhash64(text_col)
    found = materialise(near_duplicates(docs, id_col, text_col, **how).where("group_id is not null").select(F.col(id_col).alias("i"), F.col("text_hash").alias("t"), "group_id"), "near_groups")
    best = found.groupBy("group_id").agg(F.min(F.struct(F.col("i").isNull().alias("n"), "i", "t")).alias("b"), F.count(F.lit(1)).alias("rows"))
    lost = found.join(best, "group_id").where(~(F.col("i").eqNullSafe(F.col("b.i")) & (F.col("t") == F.col("b.t")))).select("i", "t").distinct()
    twice = materialise(found.groupBy("i", "t").count().where("count > 1").select("i", "t"), "near_repeats")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_.alias("i"), th.alias("t"))
    same = lambda x: keyed["i"].eqNullSafe(x["i"]) & (keyed["t"] == x["t"])
    kept = keyed.join(lost, same(lost), "left_anti")
    if not twice.isEmpty():
        again = kept.join(twice, kept["i"].eqNullSafe(twice["i"]) & (kept["t"] == twice["t"]), "left_semi")
        again = again.groupBy("i", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row", "i", "t")
        kept = kept.join(twice, kept["i"].eqNullSafe(twice["i"]) & (kept["t"] == twice["t"]), "left_anti").unionByName(again)
    return kept.select("row.*")
