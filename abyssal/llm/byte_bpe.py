"""Operator 1: byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised and uses no regular expression: every code point gets a class from a table, classes of
neighbours make a symbol, and each symbol is a transition function on eight states. The functions are composed by a
blocked associative scan: the functions of each block are composed side by side, the blocks' products are chained, and
the states inside all blocks follow at once. Token boundaries are read off the (state, symbol) pairs. Slices go
through a cache of merged byte pairs; the byte offset of every id is kept, and decoding places bytes by offsets.

Defined results: a null or empty text has no ids and decodes to no bytes; rows with equal or null ids are independent;
extra columns are ignored; an empty table gives an empty table; a slice of any length is merged with a heap.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abyssal.llm import textkit
from abyssal.llm.common import ship, tidy

# The White_Space code points of Unicode.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols. SP: a space before a non-space; WS: other white space before a non-space; W: white space before white space
# or at the end; Q2, Q3: an apostrophe that a contraction of two or three characters may begin with.
L, N, O, SP, WS, W, Q2, Q3 = range(8)
# States after a character: nothing open, letters, digits, others, a space that joins what follows, white space, one or
# two characters of a contraction to come.
FRESH, LETTER, DIGIT, OTHER, SPACE, WHITE, C1, C2 = range(8)

_NEXT = np.zeros((8, 8), np.uint8)  # [state, symbol] -> state
_CUT = np.ones((8, 8), bool)  # [state, symbol] -> a token begins here
for _s in range(8):
    _NEXT[_s] = [LETTER, DIGIT, OTHER, SPACE, FRESH, WHITE, C1, C2]
for _s, _sym in ((LETTER, L), (DIGIT, N), (OTHER, O), (WHITE, W), (SPACE, L), (SPACE, N), (SPACE, O)):
    _CUT[_s, _sym] = False
for _s in (OTHER, SPACE):
    _NEXT[_s, [Q2, Q3]] = OTHER
    _CUT[_s, [Q2, Q3]] = False
_NEXT[C2], _CUT[C2] = C1, False
_NEXT[C1], _CUT[C1] = FRESH, False
_WITH_RESET = np.concatenate([_NEXT, np.tile(_NEXT[FRESH], (8, 1))], 1)  # symbols 8 to 15: the same at a text's beginning
_FLAT = _WITH_RESET.reshape(-1)
_BY_SYMBOL = np.ascontiguousarray(_WITH_RESET.T).astype(np.int64)

_CLASS_L, _CLASS_N, _CLASS_O, _CLASS_S = range(4)
_classes: list[np.ndarray] = []

# Letters and numbers that Unicode 16.0 added to 15.1, first and last code points. Python's own table is of 15.1.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def classes() -> np.ndarray:
    """Class of each code point: letter, number, other, white space."""
    if not _classes:
        of = {"L": _CLASS_L, "N": _CLASS_N}
        table = np.fromiter((of.get(unicodedata.category(chr(c))[0], _CLASS_O) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        for kind, ranges in ((_CLASS_L, NEW_LETTERS), (_CLASS_N, NEW_NUMBERS)):
            for a, b in ranges:
                table[a : b + 1] = kind
        table[WHITE_SPACE] = _CLASS_S
        _classes.append(table)
    return _classes[0]


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols of concatenated texts that begin at ``starts``; nothing looks across a beginning."""
    kind = classes()[points]
    n = len(points)
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = True
    last[-1] = True
    white = kind == _CLASS_S
    out = kind.copy()  # L, N, O agree with their classes
    before_text = np.zeros(n, bool)
    before_text[:-1] = ~white[1:]
    before_text &= ~last
    out[white] = np.where(before_text[white], np.where(points[white] == 0x20, SP, WS), W)
    # contractions: an apostrophe and what follows it in the same text
    q = np.flatnonzero((points == 0x27) & ~last)
    one = points[q + 1]
    out[q[np.isin(one, [ord(c) for c in "stmd"])]] = Q2
    longer = ~last[q + 1]
    q, one = q[longer], one[longer]
    two = points[q + 2]
    out[q[np.logical_or.reduce([(one == ord(x)) & (two == ord(y)) for x, y in ("re", "ve", "ll")])]] = Q3
    return out


def states_before(sym: np.ndarray, starts: np.ndarray, width: int = 64) -> np.ndarray:
    """State before each position, by a blocked associative scan; what it says at ``starts`` has no meaning.

    A block's function is composed from its end towards its beginning, and only as far as it still depends on the state
    that enters: most compositions are constant after a few symbols.
    """
    n = len(sym)
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint8)
    padded[:n] = sym
    padded[starts] += 8  # the variant that forgets what went before
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    through = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    open_ = np.arange(blocks)
    for t in range(width - 1, -1, -1):
        new = np.take_along_axis(through[open_], _BY_SYMBOL[grid[t][open_]], 1)
        through[open_] = new
        open_ = open_[(new != new[:, :1]).any(1)]
        if not len(open_):
            break
    entry = np.empty(blocks, np.uint8)
    now = FRESH
    for i, f in enumerate(through.tolist()):
        entry[i] = now
        now = f[now]
    out = np.empty((width, blocks), np.uint8)
    state = entry
    for t in range(width):
        out[t] = state
        state = _FLAT.take(state * 16 + grid[t])
    return out.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions at which tokens begin in concatenated non-empty texts."""
    sym = symbols(points, starts)
    before = states_before(sym, starts)
    cut = _CUT.reshape(-1).take(before * 8 + sym)
    cut[starts] = True
    return np.flatnonzero(cut)


def load_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}


_NONE = 1 << 60


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merge``, by a plain scan of the pairs' ranks; quicker on a slice of usual length."""
    edges = list(range(len(piece) + 1))
    pairs = [ranks.get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != _NONE:
        i = pairs.index(least)
        del edges[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(piece[edges[i] : edges[i + 2]], _NONE)
        if i:
            pairs[i - 1] = ranks.get(piece[edges[i - 1] : edges[i + 1]], _NONE)
    return [ranks[piece[a:b]] for a, b in zip(edges, edges[1:])]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: always join the adjacent pair of lowest rank, leftmost first."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 48:
        return _merge_short(piece, ranks)
    ends = list(range(1, n + 1))  # ends[i]: where the part that starts at i ends; -1 once it is swallowed
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = ends[i]
        if mid < 0 or mid >= n or ends[mid] != to:
            continue
        ends[i], ends[mid] = to, -1
        if to < n:
            before[to] = i
            if (r := ranks.get(piece[i : ends[to]])) is not None:
                heapq.heappush(heap, (r, i, ends[to]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class _Cache(dict):
    """Slice -> its ids as little-endian 32-bit words. Bounded: it starts anew when it is full."""

    def __init__(self, ranks: dict[bytes, int], most: int = 250_000):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, lines: bytes):
        self.ranks = load_ranks(lines)
        self.cache = _Cache(self.ranks)
        size = max(self.ranks.values()) + 1
        parts = [b""] * size
        for piece, i in self.ranks.items():
            parts[i] = piece
        self.lengths = np.fromiter(map(len, parts), np.int64, size)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        full = [i for i, t in enumerate(texts) if t]
        out = [b""] * len(texts)
        if not full:
            return out
        whole = "".join(texts[i] for i in full)
        sizes = np.fromiter((len(texts[i]) for i in full), np.int64, len(full))
        starts = np.cumsum(sizes) - sizes
        cuts = boundaries(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), starts)
        edges = cuts.tolist()
        edges.append(len(whole))
        pieces = [whole[a:b] for a, b in zip(edges, edges[1:])]
        firsts = np.searchsorted(cuts, starts).tolist()
        firsts.append(len(pieces))
        get = self.cache.__getitem__
        for k, i in enumerate(full):
            out[i] = b"".join(map(get, pieces[firsts[k] : firsts[k + 1]]))
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each id begins, and the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        sizes = np.diff(offsets)
        return self.bytes[np.repeat(self.places[ids] - offsets[:-1], sizes) + np.arange(offsets[-1])].tobytes()


_codecs: dict[int, Codec] = {}


def _codec(lines: bytes) -> Codec:
    if (key := hash(lines)) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(lines)
    return _codecs[key]


def encode(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False, with_decoded: bool = False) -> DataFrame:
    """(id_col, ids, [offsets], [decoded]): ids and offsets packed as little-endian unsigned 32-bit integers.

    ``ranks_file`` is a rank file on the driver; its bytes (under 1 MB, a fixed vocabulary) are broadcast. ``offsets``
    has the byte offset of each id and the end. ``decoded`` are the bytes that the ids give back.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_file, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    fields = [f"`{id_col}` {dict(docs.dtypes)[id_col]}", "ids binary"] + ["offsets binary"] * with_offsets + ["decoded binary"] * with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            _, at = textkit.buffers(batch.column(1))
            for a, b in textkit.steps(at):
                part = batch.slice(a, b - a)
                packed = codec.encode(part.column(1).to_pylist())
                columns = [part.column(0), pa.array(packed, pa.binary())]
                if with_offsets or with_decoded:
                    ids = [np.frombuffer(x, "<u4") for x in packed]
                    offs = [codec.offsets(x) for x in ids]
                    if with_offsets:
                        columns.append(pa.array([o.astype("<u4").tobytes() for o in offs], pa.binary()))
                    if with_decoded:
                        columns.append(pa.array([codec.decode(x, o) for x, o in zip(ids, offs)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids"] + ["offsets"] * with_offsets + ["decoded"] * with_decoded)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), ", ".join(fields))


def decode(encoded: DataFrame, ranks_file: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, decoded) from packed ids; null ids decode to no bytes."""
    spark = encoded.sparkSession
    ship(spark)
    with open(ranks_file, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x, codec.offsets(x)) for x in ids], pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(tidy(run), f"`{id_col}` {dict(encoded.dtypes)[id_col]}, decoded binary")


def digests(docs: DataFrame, ranks_file: str) -> DataFrame:
    """The contract's columns, from one pass that encodes each text and decodes its ids."""
    done = encode(docs, ranks_file, with_decoded=True)
    return done.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
