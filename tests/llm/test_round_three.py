"""Toxic passages, divergence of sources and centroid clustering against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from abyssal.llm import centroids, divergence, textkit, toxicity

# ---- toxicity


def all_maximal(x):
    """Every maximal scoring segment by the definition: the best run (the shortest of equals, the first), then left and right of it."""
    best = max(((sum(x[i:j]), i - j, -i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    return all_maximal(x[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in all_maximal(x[j:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(0, 24)
        x = [rng.choice([-1, -1, -1, rng.randint(1, 4)]) for _ in range(n)]
        at = np.flatnonzero(np.array(x) > 0)
        got = [(int(at[i]), int(at[j]) + 1, round(s)) for i, j, s in toxicity.segments(at, np.array(x, float)[at], 1.0)]
        assert got == all_maximal(x), x


def test_segments_take_linear_time():
    at = np.arange(0, 400_000, 2)
    falling = np.linspace(2.0, 1.1, len(at))
    assert len(toxicity.segments(at, falling, 1.0)) == 1
    assert len(toxicity.segments(at * 5, falling, 1.0)) == len(at)


def plain_tokens(text):
    out = []
    for w in re.findall(rb"[a-z\x80-\xff]+", b"".join(c.lower().encode() if c.isascii() or "À" <= c <= "Þ" else c.encode() for c in text or "")):
        out.append([w, *[w[:n] for n in toxicity.BEGINNINGS if len(w) > n]])
    return out


def test_tokens_follow_the_definition():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZÉéÞß× .,9\n日") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "ab", "x" * 100_000]
    import pyarrow as pa

    data, offsets = textkit.buffers(pa.array(texts, pa.string()))
    hashes, starts, ends, per = toxicity.tokens(data, offsets)
    want = [plain_tokens(t) for t in texts]
    assert per.tolist() == [len(w) for w in want]
    known: dict = {}
    flat = [w for t in want for w in t]
    for row, w, a, b in zip(hashes.tolist(), flat, starts.tolist(), ends.tolist()):
        assert b - a == len(w[0])
        longer = [n for n in toxicity.BEGINNINGS if len(w[0]) > n]
        assert [x != 0 for x in row] == [True, *[n in longer for n in toxicity.BEGINNINGS]]
        for x, name in zip([x for x in row if x], [(w[0], 0), *[(w[0][:n], n) for n in longer]]):
            assert known.setdefault(name, x) == x
    assert len(set(known.values())) == len(known)


def test_log_odds_with_a_prior():
    t, c, df = np.array([5.0, 1.0, 0.0]), np.array([0.0, 9.0, 4.0]), np.array([8.0, 20.0, 9.0])
    got = toxicity.lower_log_odds(t, c, df, (100.0, 900.0, 2000.0), 50.0, 1.0)
    for i in range(3):
        a = 50 * df[i] / 2000
        r = math.log((t[i] + a) / (150 - t[i] - a)) - math.log((c[i] + a) / (950 - c[i] - a))
        assert got[i] == pytest.approx(max(r - math.sqrt(1 / (t[i] + a) + 1 / (c[i] + a)), 0))


def toxic_corpus(seed=4, n=700):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(300)]
    bad = ["zorkish", "zorkful", "vlempt", "quazzle", "quazzled"]
    out = []
    for i in range(n):
        t = [rng.choice(common) for _ in range(rng.randint(5, 150))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(2, 5)):
                t.insert(rng.randint(0, len(t)), rng.choice(bad).title())
        elif rng.random() < 0.02:
            t.insert(3, rng.choice(bad))  # a single one in a clean document
        out.append((i, " ".join(t), int(toxic)))
    return out


def test_toxicity_on_held_out_documents(spark):
    data = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x", 1.0, "p") for i, t, _ in data], "doc_id long, text string, score string, evidence double, passages string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in data if i % 4], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.predictions(docs.repartition(5), labels).collect()}
    assert len(got) == len(data)
    right = Counter()
    for i, _, y in data:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
        right[i % 4 == 0 or got[i].held_out, y, got[i].predicted] += 1
    for y in (0, 1):
        assert right[True, y, y] >= 0.95 * (right[True, y, 0] + right[True, y, 1]), right
    again = {r.doc_id: r.score for r in toxicity.predictions(docs.repartition(3), labels).collect()}
    assert all(again[i] == pytest.approx(got[i].score, abs=1e-9) for i in again)


def test_passages_lie_where_the_toxic_words_are(spark):
    data = toxic_corpus()
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string"), labels)
    filler = " ".join(data[1][1].split()[:60])
    text = f"{filler} É zorkish vlempt, quazzle! {' '.join([filler] * 40)} Zorkful vlempt zorkish {filler}"
    odd = [(1, text, 1.0), (2, None, 1.0), (3, "", 1.0), (4, " .,! 12 ", 1.0), (5, text, 1.0), (None, filler, 1.0)]
    got = toxicity.passages(spark.createDataFrame(odd, "doc_id long, text string, score double"), model).collect()
    assert [c for c in got[0].asDict()] == ["doc_id", "text", "score", "evidence", "passages"]
    by = {r.doc_id: r for r in got}
    assert [text.encode()[p.begin : p.end].decode().lower() for p in by[1].passages] == ["zorkish vlempt, quazzle", "zorkful vlempt zorkish"]
    assert by[1].score == by[5].score > 0.5 and by[1].passages == by[5].passages
    assert by[2].score == by[3].score == by[4].score == by[None].score < 0.5 and not by[2].passages
    assert all(p.e_value <= model.level for p in by[1].passages)


def test_toxicity_with_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "c"), (None, "d")], "doc_id long, text string")
    schema = "doc_id long, toxic int"
    assert {r.score for r in toxicity.predictions(docs, spark.createDataFrame([], schema)).collect()} == {0.5}
    for y in (0, 1):
        found = toxicity.predictions(docs, spark.createDataFrame([(1, y), (2, None), (None, 1), (2, y), (2, y)], schema)).collect()
        assert len(found) == 4 and len({r.score for r in found}) == 1 and (found[0].score > 0.5) == bool(y)
    assert toxicity.predictions(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1)], schema)).count() == 0


# ---- divergence


def plain_audit(data, least=10, top=10):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    docs = [(lang or "", source or "", words(text or "")) for lang, source, text in data]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in docs:
        df[lang].update(set(w))
        n[lang, source].update(w)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, c in df[lang].items() if c >= least)
        groups = {s: [c[t] for t in kept] for (g, s), c in n.items() if g == lang}
        ps = lambda x: [1 + 10**9 * (c + 2) // (sum(x) + 2 * len(kept)) for c in x]
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: ps(x) for s, x in groups.items()}, ps([sum(x) for x in zip(*groups.values())])
        for s in groups:
            pair = sorted((-sum(map(f, p[s], p[o])), o.encode(), o) for o in groups if o != s)
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pair, 1)]
            term = sorted((-f(a, b), t.encode(), t) for t, c, a, b in zip(kept, groups[s], p[s], q) if c and a > b)
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(term[:top], 1)]
    return Counter(out)


def odd_sources(seed=2, n=900):
    rng = random.Random(seed)
    vocabulary = ["sea", "Sea", "floor", "été", "Été", "İ", "naïve", "日本", "x'y", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]]
    rows = []
    for _ in range(n):
        source = rng.choice(["a", "b", "c", None, "é", "", "hot", "hot", "hot"])
        some = vocabulary[: rng.choice([5, 40, 309])]
        rows.append((rng.choice(["en", "de", None]), source, " ".join(rng.choice(some) + rng.choice(["", ".", "1", "\n", "\x00"]) for _ in range(rng.randint(0, 80)))))
    rows += [("en", "quiet", None), ("en", "quiet", ""), ("en", "mute", "1 2 3"), ("one", "only", "a b"), ("rare", "x", "q"), ("rare", "y", None), ("en", "a", "sea " * 3000 + "y" * 5000)]
    return rows + rows[:5]


def test_divergence_against_a_plain_version(spark, monkeypatch):
    data = odd_sources()
    docs = spark.createDataFrame([(*r, 1, "t") for r in data], "lang string, source string, text string, rank int, item string").repartition(5)
    want = plain_audit(data)
    assert Counter(map(tuple, divergence.audit(docs).collect())) == want
    monkeypatch.setattr(divergence, "_PIECE", 50)
    assert Counter(map(tuple, divergence.audit(docs, block_terms=64, pack=2).collect())) == want
    assert divergence.audit(docs.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("create table documents (lang varchar, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", data)
    assert Counter(con.execute(divergence.ORACLE).fetchall()) == want


def test_joint_cells_by_popcount():
    rng = np.random.default_rng(4)
    for _ in range(30):
        terms = int(rng.integers(1, 300))
        counts = rng.poisson(0.8, (2, terms)) * rng.integers(1, 3, (2, terms))
        p = counts * 1000 + 7
        sides = []
        for c, q in zip(counts, p):
            rows = sorted({(i // 64, int(n)) for i, n in enumerate(c) if n})
            bits = [sum(1 << int(i % 64) for i in np.flatnonzero(c == n) if i // 64 == w) for w, n in rows]
            b = np.array(bits, np.uint64)
            sides.append({"p0": 7, "word": np.array([w for w, _ in rows], np.int64), "p": np.array([n * 1000 + 7 for _, n in rows], np.int64), "bits": b, "size": np.bitwise_count(b).astype(np.int64)})
        assert divergence.joint(*sides, terms) == int(((p[0] - p[1]) ** 2 // (p[0] + p[1])).sum())


# ---- centroids


def plain_clusters(data, k, rounds, width, scale=256, seed="2"):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in data if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "null" if i is None else str(i)
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{name(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, q)), n) for n, q in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        c = [[sum(x) // len(of[n]) for x in zip(*of[n])] if n in of else q for n, q in enumerate(c)]
    found = [(i, *near(v)) for i, v in kept]
    each = Counter()
    for _, d, n in found:
        each[n] += d
    long = lambda x: x if x < 1 << 63 else None
    return Counter((i, n, long(d), long(each[n]), long(sum(each.values())), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in found)


@pytest.mark.parametrize("width", [1, 5, 64])
def test_clusters_against_a_plain_version(spark, width):
    rng = random.Random(width)
    centre = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(9)]
    data = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centre)]) for i in range(400)]
    data += [(1000 + i, data[0][1]) for i in range(50)]  # many equal ones
    data += [(1, None), (2, []), (3, [0.5] * (width - 1)), (4, [0.5] * (width + 1)), (5, [None] * width), (6, [math.nan] * width), (7, [math.inf] * width), (7, [0.25] * width), (7, [-0.25] * width), (None, [0.0] * width)]
    docs = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, cluster string").repartition(4)
    for k in (12, 1000):
        assert Counter(map(tuple, centroids.cluster(docs, k=k, rounds=3, width=width).collect())) == plain_clusters(data, k, 3, width)
    assert centroids.cluster(docs.limit(0), width=width).count() == 0


def test_clusters_of_huge_components(spark):
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1) * rng.choice([1.0, 1e6, 1e9, 1e200]) for _ in range(4)]) for i in range(60)]
    got = centroids.cluster(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3), k=5, rounds=2, width=4)
    assert Counter(map(tuple, got.collect())) == plain_clusters(data, 5, 2, 4)


def test_search_eliminates_only_strictly_worse_centroids():
    rng = np.random.default_rng(1)
    for m in (1, 2, 8, 64):
        c = rng.integers(-3, 4, (20, m))
        c[7] = c[3]  # ties
        x = np.concatenate([rng.integers(-3, 4, (300, m)), c])
        k, d = centroids.Search(c.tolist()).small(x)
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (k == full.argmin(1)).all() and (d == full.min(1)).all()
    rows = centroids.hadamard(np.eye(8, dtype=np.int64)).T[centroids.coarse_to_fine(8)]
    assert (rows[:, 1:] != rows[:, :-1]).sum(1).tolist() == list(range(8))
