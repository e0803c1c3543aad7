"""The corpus pipeline against a plain version of all its stages, and each stage on odd tables."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from abyssal.llm import byte_bpe, quality
from abyssal.llm.common import materialise
from abyssal.llm.registry import RANKS
from tests.llm.test_operators import plain_sets, plain_targets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_features(text):
    raw = (text or "").encode()
    words = [w.encode() for w in WORD.findall(text or "")]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n, m = len(raw), max(len(words), 1)
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    capitals, small = count(range(65, 91)), count(range(97, 123))
    grams = [tuple(low[i : i + 5]) for i in range(len(low) - 4)] if len(low) >= 5 else [tuple(low)] if low else []
    top = max(Counter(low).values(), default=0)
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / m, capitals / max(capitals + small, 1), count(range(48, 58)) / max(n, 1), count(map(ord, "#$%&*@^~=+<>{}[]\\/_")) / m, count(b"|") / m, count(b"!") / m,
        count(b".,;?") / m, count(b"\n") / m, count(range(128, 256)) / max(n, 1), len(set(low)) / m, sum(a == b for a, b in zip(low, low[1:])) / m, top / m, (len(grams) - len(set(grams))) / max(len(grams), 1),
        sum(len(w) <= 3 for w in words) / m, sum(len(w) >= 12 for w in words) / m, len(words) / (count(b"\n") + 1),
    ]


def plain_score(model, text):
    """Sum of one table entry per feature and per pair."""
    x = plain_features(text)
    place = lambda edges, v: sum(e <= v for e in edges)
    z = model.base + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x))
    z += sum(t[place(model.coarse[a], x[a]), place(model.coarse[b], x[b])] for a, b, t in model.pairs)
    return 1 / (1 + math.exp(-z))


def test_quality_scores_are_sums_of_lookups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "  \n"), (-4, "UP! " * 3000), (-5, "é" * 50_000)], "doc_id long, text string")
    for r in quality.score(docs.select("doc_id", "text").union(odd), model).collect():
        assert r.score == pytest.approx(plain_score(model, r.text), abs=1e-9)


def plain_lines(docs):
    seen, out = set(), []
    for d, text in docs:
        lines = text.split("\n")
        cut = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip(" "):
                if w in seen:
                    cut |= {p, p + 1, p + 2}
                seen.add(w)
        if len(cut) < len(lines):
            out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in cut)))
    return out


def plain_components(docs):
    sets = {d: plain_sets(t) for d, t in docs}
    comp = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((comp[a], comp[b]))
            comp = {d: low if c == high else c for d, c in comp.items()}
    return comp


def plain_mix(docs, source):
    size = {d: len(WORD.findall(t)) for d, t in docs}
    total = Counter()
    for d in size:
        total[source[d]] += size[d]
    goal, out = plain_targets(dict(total)), Counter()
    for s in total:
        key = {}
        for d, t in docs:
            if source[d] == s:
                u = (int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                weight = max(0.05, sum(c not in "!#$%&*|" for c in t) / len(t)) if t else 1.0
                key[d] = -math.log(u) / weight
        epochs = int(goal[s] // total[s]) if total[s] else 0
        rest, before = goal[s] - epochs * total[s], 0
        for d in sorted(key, key=key.get):
            out[d] = epochs + (before + size[d] / 2 <= rest)
            before += size[d]
    return +out


def test_whole_pipeline_against_a_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test_{name}")
        seen.append(docs.collect())
        assert name == "byte_bpe" or docs.columns == names
    start, good, lines, one, mixed, encoded = seen
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = sorted((r.doc_id, r.text) for r in start if plain_score(model, r.text) >= pipeline.THRESHOLD)
    assert 0 < len(want) < len(start) and sorted((r.doc_id, r.text) for r in good) == want
    want = plain_lines(want)
    assert sorted((r.doc_id, r.text) for r in lines) == want
    text = {r.doc_id: r.text for r in start}
    assert all(r.n_chars == len(r.text) for r in lines if r.text != text[r.doc_id])
    comp = plain_components(want)
    want = [(d, t) for d, t in want if comp[d] == d]
    assert sorted((r.doc_id, r.text) for r in one) == want
    taken = plain_mix(want, {r.doc_id: r.source for r in start})
    assert Counter(r.doc_id for r in mixed) == taken
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(open(public_tokenizers.path(RANKS), "rb").read()), special_tokens={})
    by, ids = dict(want), {d: np.array(enc.encode_ordinary(t), "<u4") for d, t in want}
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in encoded) == Counter({(d, len(ids[d]), ids[d].tobytes()): n for d, n in taken.items()})
    for r in encoded:
        ends = np.frombuffer(r.offsets, "<u4")
        assert len(ends) == r.n_tokens + 1 and ends[0] == 0 and ends[-1] == len(by[r.doc_id].encode())


CLASHING = ["row", "_size", "_source", "_key", "_id", "_th", "_o", "_t", "_p", "_co", "_cov", "_l", "_kept", "_n", "score", "target", "source_size", "n_docs", "i", "t", "n_lines", "n_removed", "_lines", "_removed", "group_id", "_bucket", "_copies", "_c", "_classified", "ids", "k"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null, empty, long and repeated texts, null and repeated ids, and a column for each name that the stages use."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    copy = " ".join(f"c{i}" for i in range(60))
    data = [(1, copy), (1, copy), (2, copy + " more"), (None, copy), (3, None), (3, None), (4, ""), (5, " \n "), (6, long), (7, long + " end"), (8, "a\nb\nc\nd"), (9, "x\na\nb\nc"), (None, "alone here"), (1, "another text of the same id")]
    rows = [(i, t, "en", [None, "b", "a"][n % 3], len(t or ""), *[7] * len(CLASHING)) for n, (i, t) in enumerate(data)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(rows, schema), data, str(folder)


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:-1]], ids=[n for n, _ in pipeline.STAGES[:-1]])
def test_a_stage_on_odd_rows(spark, odd, stage):
    docs, data, folder = odd
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == 7 for r in got for c in CLASHING)
    none = stage(spark, docs.where("1 = 0"), folder)
    assert none.columns == docs.columns and none.count() == 0
    have = Counter((r.doc_id, r.text) for r in got)
    if stage is pipeline.classify:
        assert have <= Counter(data)
    elif stage is pipeline.drop_repeated_lines:
        assert have == Counter([x if x != (9, "x\na\nb\nc") else (9, "x") for x in data])
    elif stage is pipeline.drop_near_copies:
        assert have == Counter([x for x in data if x not in ((2, data[2][1]), (None, data[3][1]), (7, data[9][1]))]) - Counter([data[0]])
    else:
        assert set(have) <= set(data)


def test_the_last_stage_on_odd_rows(spark, odd):
    docs, data, folder = odd
    got = pipeline.tokenise(spark, docs, folder).collect()
    assert len(got) == len(data) and all(len(r.ids) == 4 * r.n_tokens and len(r.offsets) == len(r.ids) + 4 for r in got)
    assert pipeline.tokenise(spark, docs.where("1 = 0"), folder).count() == 0
