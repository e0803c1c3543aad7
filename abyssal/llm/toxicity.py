"""Operator 11: toxic passages by maximum-scoring segments over token log-odds.

Tokens. A word is a run of ASCII letters and bytes from 0x80 on, in lower case (ASCII and Latin-1 letters). It stands for
itself and for its beginnings of 4 to 7 bytes, so that inflected forms share what is known of them.

Log-odds. From labelled documents, each token's number of toxic and of other documents, with a Dirichlet prior in
proportion to its number of documents in the whole corpus (``prior`` pseudo-counts in all), gives a log-odds ratio and its
standard deviation. A token counts with the lower bound, ``z`` deviations below, where that is over 0; a word with the best of
its tokens. All other words cost the same small ``drift``, so that clean text has a negative expectation.

Segments. All maximal scoring segments of a text (Ruzzo and Tompa) are found in time linear in its words, over its scoring
words only: what lies between two of these is one difference of positions.

Calibration. In clean text, scores of segments over a level fall off exponentially and their number grows with the words:
E = k * words * exp(-rate * score), fitted to the clean labelled documents. A segment with E up to ``level`` is significant. A
document's evidence is the sum of -ln(E) of these; a logistic curve of it, fitted to the labelled documents, is its score.
For these fits each labelled document is scored without its own count in the log-odds.

The fit uses at most ``max_labelled`` labelled ids (those of least xxhash64(doc_id)), one text of each, and keeps at most
``max_terms`` tokens: the model's size. Token counts of the prior cover the whole corpus.

Defined results: null and empty texts, and texts without words, have no segment and the score of no evidence; equal texts
score equally; null labels and null ids are left out of the fit; an id with several labels is toxic if one of them is; an
id with several texts trains with the text of least hash; without any labelled row the score is 0.5, without a toxic or a
clean one the smoothed share of toxic rows; rows repeat independently; other columns pass through where asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from abyssal.llm import textkit
from abyssal.llm.common import carried, discard, materialise, ship, tidy
from abyssal.llm.quality import held_out
from abyssal.llm.textkit import U64, mix

#: Bytes of the beginnings of a word that are tokens beside it.
BEGINNINGS = (4, 5, 6, 7)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_BASE = U64(0x9FB21C651E98DF25)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, words per row): a row of hashes per word, itself and its beginnings, 0 where it is no longer than one."""
    base, rows = int(offsets[0]), len(offsets) - 1
    b = _LOWER[data[base : int(offsets[-1])]]
    capital = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)) + 1
    b[capital] += 0x20
    inside = _LETTER[b]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets - base
    firsts = at[:-1][at[:-1] < len(b)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros((0, 1 + len(BEGINNINGS)), U64), starts, starts, np.zeros(rows, np.int64)
    stops = ~inside
    stops[at[1:-1][at[1:-1] < len(b)]] = True
    stops = np.append(np.flatnonzero(stops), len(b))
    ends = stops[np.searchsorted(stops, starts, "right")]
    place = np.zeros(len(b), np.int64)
    place[starts] = starts
    place = np.minimum(np.arange(len(b)) - np.maximum.accumulate(place), 1 << 16)
    power = np.full(int(place.max()) + 1, _BASE, U64)
    power[0] = 1
    total = np.concatenate([np.zeros(1, U64), np.cumsum(np.where(inside, _VALUE[b], U64(0)) * np.multiply.accumulate(power)[place], dtype=U64)])
    out = np.zeros((len(starts), 1 + len(BEGINNINGS)), U64)
    out[:, 0] = mix(total[ends] - total[starts])
    for i, n in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(ends - starts > n)
        out[longer, i] = mix((total[starts[longer] + n] - total[starts[longer]]) ^ U64(n))
    return out, starts + base, ends + base, np.diff(np.searchsorted(starts, at, "left"))


def presence(hashes: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each token once for each row that has it."""
    row = np.repeat(np.repeat(np.arange(len(per)), per), hashes.shape[1])
    flat = hashes.reshape(-1)
    row, flat = row[flat != 0], flat[flat != 0]
    order = np.lexsort((flat, row))
    row, flat = row[order], flat[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])]) if len(flat) else np.zeros(0, bool)
    return flat[fresh], row[fresh]


def lower_log_odds(t: np.ndarray, c: np.ndarray, df: np.ndarray, totals: tuple[float, float, float], prior: float, z: float) -> np.ndarray:
    """The log-odds ratio of tokens in t toxic and c other documents with a Dirichlet prior after df, less z deviations; 0 if that is not over 0."""
    n_t, n_c, n_df = totals
    a = prior * np.maximum(df, 1) / max(n_df, 1.0)
    t, c = np.maximum(t, 0), np.maximum(c, 0)
    ratio = np.log((t + a) / np.maximum(n_t + prior - t - a, 1e-9)) - np.log((c + a) / np.maximum(n_c + prior - c - a, 1e-9))
    return np.maximum(ratio - z * np.sqrt(1 / (t + a) + 1 / (c + a)), 0.0)


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first, last, score): scoring words at ``at``, each word between them costs ``drift``.

    first and last number the scoring words. Ruzzo and Tompa's algorithm; ``back`` leads past segments that cannot be joined any
    more, so the time is linear.
    """
    gain = np.cumsum(score)
    right = gain - drift * (at - np.arange(len(at)))
    left = right - score
    kept: list[list] = []  # first, last, total before, total after, the nearest segment before with a lesser total before
    for i, (lo, hi) in enumerate(zip(left.tolist(), right.tolist())):
        new = [i, i, lo, hi, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new = [kept[j][0], i, kept[j][2], hi, -1]
            del kept[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


class Model:
    """Tokens with their scores, and the two calibrations. A size bounded by ``max_terms``."""

    def __init__(self, terms: np.ndarray, value: np.ndarray, drift: float = 0.05, rate: float = 1.0, k: float = 1e-3, level: float = 0.05, curve: tuple[float, float] = (0.0, 0.0)):
        order = np.argsort(terms)
        self.terms, self.value = terms[order], value[order]
        self.drift, self.rate, self.k, self.level, self.curve = drift, rate, k, level, curve

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """The score of each word: its best token's, 0 where none counts."""
        if not len(self.terms) or not len(hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.terms, hashes.reshape(-1)), len(self.terms) - 1)
        found = np.where(self.terms[at] == hashes.reshape(-1), self.value[at], 0.0)
        return found.reshape(hashes.shape).max(1)

    def e_value(self, score: float, words: int) -> float:
        return self.k * words * math.exp(-min(self.rate * score, 700.0))

    def evidence(self, found: list[tuple[int, int, float]], words: int) -> float:
        return sum(-math.log(max(e, 1e-300)) for e in (self.e_value(s, words) for _, _, s in found) if e <= self.level)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(evidence))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(a, b) of the logistic curve a + b * x by Newton's method, b not under 0."""
    w = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0])
    both = np.stack([np.ones(len(x)), x], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(both @ w, -30, 30)))
        step = np.linalg.solve((both * (p * (1 - p))[:, None]).T @ both + ridge * np.eye(2), both.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[1] > 0 else (math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0)


def _texts(batch: pa.RecordBatch, column: int):
    """Steps of a batch: (first row, end row, hashes, starts, ends, words per row, offsets)."""
    data, offsets = textkit.buffers(batch.column(column))
    for a, b in textkit.steps(offsets):
        yield (a, b, *tokens(data, offsets[a : b + 1]), offsets)


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) -> (token, toxic, other documents of the batch)."""
    for batch in batches:
        y = batch.column(1).to_numpy()
        for a, b, hashes, _, _, per, _ in _texts(batch, 0):
            h, row = presence(hashes, per)
            each, at = np.unique(h, return_inverse=True)
            t = np.bincount(at, y[a:b][row], len(each)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(t), pa.array(np.bincount(at, minlength=len(each)) - t)], names=["h", "t", "c"])


def _corpus_counts(terms: np.ndarray):
    """(text) -> (number of the term, documents with it in this task); the last number stands for tokens of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for _, _, hashes, _, _, per, _ in _texts(batch, 0):
                h, _ = presence(hashes, per)
                n[-1] += len(h)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                    n[:-1] += np.bincount(at[terms[at] == h], minlength=len(terms))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["i", "n"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, max_terms: int = 200_000, prior: float = 10_000.0, z: float = 1.96, least: int = 2, level: float = 0.05) -> Model:
    """Fit on labelled rows that are not held out; the prior counts all ``docs``."""
    ship(docs.sparkSession)
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("_y"))
    picked = F.broadcast(rows.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))  # at most max_labelled ids
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(picked, "_id")
    labelled = materialise(found.groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_text", "_y"), "labelled")
    counts = labelled.mapInArrow(tidy(_label_counts), "h long, t long, c long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = materialise(counts, "label_counts")
    n_t, n_c = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c")).first())
    # tokens that can count; where the model would be too large, those of most toxic documents
    likely = counts.where((F.col("t") >= least) & (F.col("t") * F.lit(max(n_c, 1.0)) > F.col("c") * F.lit(max(n_t, 1.0))))
    got = likely.orderBy(F.col("t").desc(), "c", "h").limit(max_terms).toPandas().sort_values("h")
    h, t, c = got["h"].to_numpy(np.int64).view(U64), got["t"].to_numpy(float), got["c"].to_numpy(float)
    order = np.argsort(h)
    h, t, c = h[order], t[order], c[order]
    df = np.zeros(len(h) + 1)
    for i, n in docs.select(F.col(text_col)).mapInArrow(tidy(_corpus_counts(h)), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # at most max_terms + 1 rows
        df[i] = n
    totals = (n_t, n_c, float(df[-1]))
    odds = lambda dt, dc: lower_log_odds(t - dt, c - dc, df[:-1], totals, prior, z)
    full = odds(0, 0)
    keep = np.flatnonzero(full > 0)
    model = _calibrated(Model(h[keep], full[keep], level=level), labelled, [odds(0, 1)[keep], odds(1, 0)[keep]])
    for x in (labelled, counts):
        discard(x)
    return model


def _calibrated(model: Model, labelled: DataFrame, without: list[np.ndarray]) -> Model:
    """The model with drift, tail and curve. ``without``: scores of the terms less one other, and less one toxic document."""
    models = [Model(model.terms, v) for v in without]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, words, gain = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b, hashes, _, _, per, _ in _texts(batch, 0):
                of = np.repeat(np.arange(a, b), per)
                s = np.where(y[of] > 0, models[1].words(hashes), models[0].words(hashes))
                words[a:b] += per
                gain += np.bincount(of, s, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words), pa.array(gain)], names=["y", "words", "gain"])

    sums = {r["y"]: r for r in labelled.mapInArrow(tidy(hits), "y int, words long, gain double").groupBy("y").agg(F.sum("words").alias("words"), F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("n")).collect()}
    clean = sums.get(0)
    if clean is None or 1 not in sums:  # nothing to tell apart
        n = sum(r["n"] for r in sums.values())
        toxic = sums[1]["n"] if 1 in sums else 0
        model.curve = (math.log((toxic + 1) / (n - toxic + 1)), 0.0)
        return model
    model.drift = drift = max(0.02, 2.0 * clean["gain"] / max(clean["words"], 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, words, out = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for a, b, hashes, _, _, per, _ in _texts(batch, 0):
                of = np.repeat(np.arange(a, b), per)
                s = np.where(y[of] > 0, models[1].words(hashes), models[0].words(hashes))
                words[a:b] += per
                for r, found in _found(s, per, drift):
                    out[a + r] = sorted((x for _, _, x in found), reverse=True)[:100]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words), pa.array(out, pa.list_(pa.float64()))], names=["y", "words", "s"])

    got = labelled.mapInArrow(tidy(scored), "y int, words long, s array<double>").toPandas()  # a row per labelled id, up to 100 scores each
    quiet = got[got["y"] == 0]
    every = np.concatenate([np.zeros(0), *[np.asarray(s, float) for s in quiet["s"]]])
    edge = float(np.quantile(every, 0.9)) if len(every) else 0.0
    over = every[every >= edge] - edge
    model.rate = float((len(over) + 1) / (over.sum() + 1.0))  # the mean excess, with one of 1 as prior
    model.k = float((len(over) + 0.5) / max(quiet["words"].sum(), 1) * math.exp(min(model.rate * edge, 700.0)))
    x = np.array([model.evidence([(0, 0, s) for s in ss], w) for ss, w in zip(got["s"], got["words"])])
    model.curve = logistic(np.log1p(x), got["y"].to_numpy(float))
    return model


def _found(score: np.ndarray, per: np.ndarray, drift: float) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(row, its segments by number of scoring word) for the rows that have any."""
    at = np.flatnonzero(score > 0)
    ends = np.cumsum(per)
    row = np.searchsorted(ends, at, "right")
    for r in np.unique(row).tolist():
        lo, hi = np.searchsorted(row, r, "left"), np.searchsorted(row, r, "right")
        yield r, segments(at[lo:hi] - (ends[r] - per[r]), score[at[lo:hi]], drift)


#: One significant passage: its byte range in the text, its number of words, score and E.
PASSAGE = StructType([StructField("begin", LongType()), StructField("end", LongType()), StructField("words", LongType()), StructField("score", DoubleType()), StructField("e_value", DoubleType())])


def passages(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all) with ``score``, ``evidence`` and ``passages``, every significant toxic passage of the whole text.

    Columns named like these three are replaced.
    """
    ship(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "evidence", "passages")]
    rows = docs.select(F.col(text_col).alias("text"), carried(docs.select(*[f"`{c}`" for c in keep])).alias("row"))
    schema = StructType([rows.schema["row"], StructField("score", DoubleType()), StructField("evidence", DoubleType()), StructField("passages", ArrayType(PASSAGE))])
    held = docs.sparkSession.sparkContext.broadcast(model)  # max_terms tokens at most
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for a, b, hashes, starts, ends, per, offsets in _texts(batch, 0):
                evidence, out = np.zeros(b - a), [[] for _ in range(b - a)]
                s = m.words(hashes)
                at, firsts = np.flatnonzero(s > 0), np.cumsum(per) - per
                for r, found in _found(s, per, m.drift):
                    n = int(per[r])
                    evidence[r] = m.evidence(found, n)
                    first = np.searchsorted(at, firsts[r])
                    for i, j, x in found:
                        if (e := m.e_value(x, n)) <= m.level:
                            i, j = at[first + i], at[first + j]
                            out[r].append({"begin": int(starts[i] - offsets[a + r]), "end": int(ends[j] - offsets[a + r]), "words": int(j - i + 1), "score": x, "e_value": e})
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(m.score(evidence)), pa.array(evidence), pa.array(out, kind)], names=["row", "score", "evidence", "passages"])

    return rows.mapInArrow(tidy(run), schema).select(*[F.col(f"row.`{c}`") for c in keep], "score", "evidence", "passages")


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The contract's columns, and the number of significant passages."""
    scored = passages(docs, train(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
