"""Operator 9: quality classifier, a generalised additive model with pairwise interactions.

Features of a text are computed in numpy from Arrow buffers. The model is boosted cyclically: round after round, each
feature in turn gets a shallow tree fitted to the logistic gradient of the histogram of its bins, and the trees of a
feature add up to one lookup table. Then the pairs of features that explain most of what is left get two-way tables in
the same way. Scoring adds one table entry per feature and pair, vectorised over rows.

The fit uses at most ``max_labelled`` labelled ids (those of least xxhash64(doc_id)), one text of each; that bound is the
only limit, and only their features, 8 bytes times 18 a row, come to the driver. Every row is scored over its whole text.

Defined results: null and empty texts have all features 0 and a score like any other; equal texts score equally; null
labels are left out; without any labelled row the score is 0.5; rows repeat independently; other columns pass through
where asked for, and a column named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from abyssal.llm import textkit
from abyssal.llm.common import carried, ship, tidy

FEATURES = ["log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "pipes", "shouts", "stops", "lines", "non_ascii", "distinct", "repeats", "top_word", "same_shingles", "short_words", "long_words", "line_words"]

_KINDS = np.zeros((9, 256), bool)
_KINDS[0, 65:91] = True  # capitals
_KINDS[1, 48:58] = True  # digits
_KINDS[2, [ord(c) for c in "#$%&*@^~=+<>{}[]\\/_"]] = True
_KINDS[3, ord("|")] = True
_KINDS[4, ord("!")] = True
_KINDS[5, [ord("."), ord(","), ord(";"), ord("?")]] = True
_KINDS[6, 10] = True
_KINDS[7, 128:] = True
_KINDS[8, 65:91] = _KINDS[8, 97:123] = True  # letters


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    rows = len(offsets) - 1
    b = data[int(offsets[0]) : int(offsets[-1])]
    at = offsets - offsets[0]
    n = np.diff(at).astype(float)
    counts = np.zeros((len(_KINDS), rows))
    for i, kind in enumerate(_KINDS):
        hit = np.flatnonzero(kind[b])
        counts[i] = np.diff(np.searchsorted(hit, at))
    hashed, per = textkit.words(data, offsets)
    ends = np.cumsum(per)
    some = np.maximum(n, 1)
    words = np.maximum(per, 1)
    grams, gper = textkit.shingles(hashed, per)
    gends = np.cumsum(gper)
    distinct, repeats, top, same = (np.zeros(rows) for _ in range(4))
    for r in range(rows):
        if per[r]:
            w = hashed[ends[r] - per[r] : ends[r]]
            repeats[r] = np.count_nonzero(w[1:] == w[:-1]) / per[r]
            s = np.sort(w)
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[r] = (len(edge) - 1) / per[r]
            top[r] = np.diff(edge).max() / per[r]
            g = np.sort(grams[gends[r] - gper[r] : gends[r]])
            same[r] = np.count_nonzero(g[1:] == g[:-1]) / gper[r]
    sep = textkit._SEP[b]
    gaps = np.flatnonzero(sep)
    # lengths of runs between separators or texts' ends, as shares of short and long words
    cuts = np.unique(np.concatenate([at, gaps, gaps + 1]))
    begins, length = cuts[:-1], np.diff(cuts)
    ink_run = ~sep[begins] if len(b) else np.zeros(0, bool)
    begins, length = begins[ink_run], length[ink_run]
    of = np.searchsorted(at, begins, "right") - 1
    short = np.bincount(of[length <= 3], minlength=rows)[:rows] if len(of) else np.zeros(rows)
    long_ = np.bincount(of[length >= 12], minlength=rows)[:rows] if len(of) else np.zeros(rows)
    ink = n - np.diff(np.searchsorted(gaps, at))
    return np.stack([np.log1p(n), np.log1p(per), ink / words, counts[0] / np.maximum(counts[8], 1), counts[1] / some, counts[2] / words, counts[3] / words, counts[4] / words, counts[5] / words, counts[6] / words, counts[7] / some, distinct, repeats, top, same, short / words, long_ / words, per / (counts[6] + 1)], 1)


def with_features(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep columns and ``_x``, the features as an array."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.buffers(batch.column(0))
            for a, b in textkit.steps(offsets):
                x = features(data, offsets[a : b + 1])
                flat = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * len(FEATURES), x.reshape(-1))
                yield pa.RecordBatch.from_arrays([*[batch.column(i + 1).slice(a, b - a) for i in range(len(keep))], flat], names=[*keep, "_x"])

    return rows.select(text_col, *keep).mapInArrow(tidy(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_x array<double>"]))


def _tree(g: np.ndarray, h: np.ndarray, lam: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Values of a tree of up to three leaves over ordered bins."""

    def cut(a: int, b: int) -> tuple[float, int]:
        gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gt, ht = g[a:b].sum(), h[a:b].sum()
        gain = gl**2 / (hl + lam) + (gt - gl) ** 2 / (ht - hl + lam) - gt**2 / (ht + lam)
        gain[(hl < least) | (ht - hl < least)] = -1
        i = int(np.argmax(gain)) if len(gain) else 0
        return (float(gain[i]), a + i + 1) if len(gain) else (-1.0, a)

    edges = [0, len(g)]
    for _ in range(2):
        best = max((cut(a, b) for a, b in zip(edges, edges[1:])), default=(-1.0, 0))
        if best[0] <= 0:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, lam: float = 4.0) -> np.ndarray:
    """Values of a tree of two levels over a grid: one cut along an axis, then one along the other in each half."""
    best, out = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for i in range(1, gg.shape[0]):
            gain, now = 0.0, np.zeros_like(gg)
            for a, b in ((0, i), (i, gg.shape[0])):
                gl, hl = np.cumsum(gg[a:b].sum(0)), np.cumsum(hh[a:b].sum(0))
                each = gl[:-1] ** 2 / (hl[:-1] + lam) + (gl[-1] - gl[:-1]) ** 2 / (hl[-1] - hl[:-1] + lam)
                j = int(np.argmax(each)) + 1
                gain += float(each[j - 1])
                now[a:b, :j] = gl[j - 1] / (hl[j - 1] + lam)
                now[a:b, j:] = (gl[-1] - gl[j - 1]) / (hl[-1] - hl[j - 1] + lam)
            if gain > best:
                best, out = gain, now.T if turned else now
    return out


class Model:
    """Bin edges and lookup tables. Plain arrays of a size that does not grow with the data."""

    def __init__(self, edges: list[np.ndarray], base: float, tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]], coarse: list[np.ndarray]):
        self.edges, self.base, self.tables, self.pairs, self.coarse = edges, base, tables, pairs, coarse

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, f], "right")]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for p in self.pairs for f in p[:2]}
        for a, b, t in self.pairs:
            z += t[bins[a], bins[b]]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, bins: int = 48, coarse_bins: int = 10, rate: float = 0.15) -> Model:
    """Boosted lookup tables for the log odds of y = 1."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    cuts = lambda n: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) if len(y) else np.zeros(0) for f in range(k)]
    edges, coarse = cuts(bins), cuts(coarse_bins)
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y):
        return Model(edges, base, tables, [], coarse)
    binned = [np.searchsorted(edges[f], x[:, f], "right") for f in range(k)]
    z = np.full(len(y), base)
    for _ in range(rounds):
        for f in range(k):
            p = 1 / (1 + np.exp(-z))
            size = len(tables[f])
            t = rate * _tree(np.bincount(binned[f], y - p, size), np.bincount(binned[f], p * (1 - p), size))
            tables[f] += t
            z += t[binned[f]]
    small = [np.searchsorted(coarse[f], x[:, f], "right") for f in range(k)]
    width = [len(c) + 1 for c in coarse]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        cell, n = small[a] * width[b] + small[b], width[a] * width[b]
        return np.bincount(cell, y - p, n).reshape(width[a], width[b]), np.bincount(cell, p * (1 - p), n).reshape(width[a], width[b])

    found = []
    for a in range(k):
        for b in range(a + 1, k):
            if width[a] > 1 and width[b] > 1:
                g, h = grids(a, b)
                found.append((-float((g**2 / (h + 4)).sum()), a, b))
    chosen = [(a, b, np.zeros((width[a], width[b]))) for _, a, b in sorted(found)[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, table in chosen:
            t = rate * _tree2(*grids(a, b))
            table += t
            z += t[small[a], small[b]]
    return Model(edges, base, tables, chosen, coarse)


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> Model:
    """Fit on at most ``max_labelled`` labelled rows that are not held out."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("_y"))
    picked = F.broadcast(rows.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))  # at most max_labelled ids
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(picked, "_id")
    found = with_features(found.select("_id", "_y", "_text", F.xxhash64("_text").alias("_th")), "_text", ["_id", "_y", "_th"])
    found = found.groupBy("_id").agg(F.min_by(F.struct("_y", "_x"), "_th").alias("r")).select("_id", "r.*")  # ids that repeat: the text of least hash
    got = found.toPandas().sort_values("_id")  # a row per picked id
    x = np.array(got["_x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["_y"].to_numpy(float))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (or the ``keep`` columns of it) with the probability of label 1."""
    ship(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    rows = docs.select(F.col(text_col).alias("text"), carried(docs.select(*[f"`{c}`" for c in keep])).alias("row"))
    schema = StructType([rows.schema["row"], StructField("score", DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.buffers(batch.column(0))
            for a, b in textkit.steps(offsets):
                s = held.value.score(features(data, offsets[a : b + 1]))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(s)], names=["row", "score"])

    return rows.mapInArrow(tidy(run), schema).select(*[F.col(f"row.`{c}`") for c in keep], F.col("score").alias(out_col))


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The contract's columns."""
    scored = score(docs, train(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
