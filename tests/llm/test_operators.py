"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from abyssal.llm import bm25, byte_bpe, fingerprints, jaccard_join, line_dedup, mixing, passages, quality, sharding, textkit, url_filter
from abyssal.llm.components import components
from abyssal.llm.registry import RANKS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string, score string, _x string"


def prose(rng, n):
    return " ".join(rng.choice(["The", "sea", "floor", "is", "deep", "a", "été", "naïve", "x1", "22"]) + rng.choice(["", "", ",", "'s"]) + str(rng.randint(0, 60)) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(25)]
    near = [" ".join(w if rng.random() > 0.02 else "changed" for w in base[i].split(" ")) for i in range(12)]
    texts = [*base, *near, base[0], base[0], None, "", " \n\t ", "one two", "one two", "a" * 3000, "\n".join(["same line"] * 6), "x\n\n\n\n\ny", prose(rng, 3000)]
    out = [(i * 3, t, "en", [None, "b", "a", "c"][i % 4], len(t or ""), 7, "x", "y", "z") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, base[5], "en", "a", 1, 7, "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def test_byte_bpe(docs, none):
    path = public_tokenizers.path(RANKS)
    ranks = byte_bpe.load_ranks(open(path, "rb").read())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows():
        ids = np.array(enc.encode_ordinary(r[1] or ""), "<u4")
        want[(r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, byte_bpe.digests(docs, path).collect())) == want
    back = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((r[0], (r[1] or "").encode()) for r in rows())
    with_offsets = byte_bpe.encode(docs.where("doc_id = 3"), path, with_offsets=True).first()
    assert np.frombuffer(with_offsets.offsets, "<u4")[-1] == len(rows()[1][1].encode())
    assert byte_bpe.digests(none, path).count() == 0


def test_byte_bpe_boundaries():
    codec = byte_bpe.Codec(open(public_tokenizers.path(RANKS), "rb").read())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice("abst'rvelmd  \n\t\r\u3000é1²٣!.-\U0001f600中\x1c") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["'s's'll 've\n\n's", "ab" * 500]
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), t


def plain_bm25(data, asked):
    """For each asked row the scores of all rows that share a word with it, as (score, row)."""
    words = [Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t in data]
    held = [w for w in words if w]
    n, avg = len(held), sum(sum(w.values()) for w in held) / len(held)
    df = Counter(t for w in held for t in w)
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    score = lambda q, w: sum(c * idf[t] * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * sum(w.values()) / avg)) for t, c in q.items() if t in w)
    return {i: sorted(((x, j) for j, w in enumerate(words) if (x := score(words[i], w)) > 0), key=lambda x: -x[0]) for i in asked}


def check_bm25(got, data, asked, k):
    """Scores as the plain ones, rank by rank; each document with its own score; ties of alike texts by id, null first."""
    want = plain_bm25(data, asked)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    assert want and set(by) == {data[i][0] for i, x in want.items() if x}
    text = {}
    for d, t in data:
        text.setdefault(d, t)
    for i, scores in want.items():
        mine = sorted(by.get(data[i][0], []))
        assert [n for n, _, _ in mine] == list(range(1, min(k, len(scores)) + 1))
        assert [x for _, _, x in mine] == pytest.approx([x for x, _ in scores[:k]])
        of = {}
        for x, j in scores:
            of.setdefault(data[j][0], []).append(x)
        assert all(any(math.isclose(x, y) for y in of[d]) for _, d, x in mine)
        for (_, d, x), (_, e, y) in zip(mine, mine[1:]):
            if text[d] == text[e] and x == y:
                assert e is not None and (d is None or d <= e)
        last = mine[-1][2] if mine else 0
        inside = {d for _, d, _ in mine}
        for _, d, x in mine:  # of alike texts, none of a lower id is left out
            if math.isclose(x, last):
                assert all(e in inside for e, t in data if t == text[d] and (e is None or d is not None and e < d))


def test_bm25(docs, none, spark):
    data = [(r[0], r[1]) for r in rows()]
    asked = [i for i, (d, _) in enumerate(data) if d is None or d % 9 == 0]
    for shard_docs, block in ((16, 2000), (8192, 16 << 20)):
        got = bm25.search(docs, docs.where("doc_id is null or doc_id % 9 = 0"), k=5, shard_docs=shard_docs, block_bytes=block).collect()
        check_bm25(got, data, asked, 5)
    assert bm25.search(none, none).count() == 0
    assert bm25.search(docs, none).count() == 0


def test_bm25_prunes_exactly(spark):
    rng = random.Random(7)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(4000)]
    data = [(i, " ".join(rng.choices(common, k=rng.randint(5, 60)) + rng.choices(rare, k=rng.randint(0, 12)))) for i in range(1500)]
    data += [(2000 + i, data[i * 7][1]) for i in range(60)]  # ties
    asked = list(range(0, len(data), 25))
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = bm25.search(frame, frame.where(F.col("doc_id").isin({data[i][0] for i in asked})), shard_docs=200).collect()
    check_bm25(got, data, asked, 10)


def test_every_code_point_has_the_librarys_class():
    """A piece goes on after a letter, a digit or another character only with its own class, which shows as one id."""
    own = byte_bpe.classes()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        some = points[at : at + 4096]
        ranks = {bytes([i]): i for i in range(256)}
        for c in some:
            for lead in (b"a", b"1", b"!"):
                piece = lead
                for x in chr(c).encode():
                    piece += bytes([x])
                    ranks.setdefault(piece, len(ranks))
        enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for c in some:
            joined = [len(enc.encode_ordinary(lead + chr(c))) == 1 for lead in "a1!"]
            assert own[c] == (joined.index(True) if any(joined) else byte_bpe._CLASS_S), hex(c)


def test_newer_letters_are_encoded_as_the_library_does():
    codec = byte_bpe.Codec(open(public_tokenizers.path(RANKS), "rb").read())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    points = [c for ranges in (byte_bpe.NEW_LETTERS, byte_bpe.NEW_NUMBERS) for a, b in ranges for c in (a, b)] + list(range(0xA0, 0x3000, 7))
    texts = [t for c in points for t in (f"a{chr(c)}a", chr(c) * 2, f" {chr(c)}1")]
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), t


def test_jaccard_join(docs, none):
    data = [(r[0], plain_sets(r[1])) for r in rows()]
    comp = list(range(len(data)))
    for a, b in itertools.combinations(range(len(data)), 2):
        x, y = data[a][1], data[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            old, new = comp[b], comp[a]
            comp = [new if c == old else c for c in comp]
    lowest = {c: min((data[i][0] for i in range(len(data)) if comp[i] == c and data[i][0] is not None), default=None) for c in comp}
    want = Counter((d, len(s), lowest[c]) for (d, s), c in zip(data, comp))
    for light in (48, 2):  # 2: heavy cells everywhere
        got = jaccard_join.near_duplicates(docs, light=light).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, got)) == want
    assert jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_join_large_group(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    data = []
    for i in range(150):  # a chain of copies that drift, with a common passage in unlike texts
        base = [w if rng.random() > 0.004 else f"e{rng.random()}" for w in base]
        data.append((i, " ".join(base)))
    shared = " ".join(f"s{i}" for i in range(60))
    data += [(1000 + i, shared + " " + " ".join(f"u{i}_{j}" for j in range(20 + i % 3))) for i in range(40)]
    sets = {i: plain_sets(t) for i, t in data}
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = {i: lo if c == hi else c for i, c in comp.items()}
    got = jaccard_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), light=6).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    bands = jaccard_join.Bands(80)
    for n in (1, 5, 100, 128, 300, 1000, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[max(1, n // 10) :], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        bits = np.unpackbits(np.frombuffer(jaccard_join.parity_sketch(a), np.uint8)) != np.unpackbits(np.frombuffer(jaccard_join.parity_sketch(b), np.uint8))
        assert bits.sum() <= apart
        for band, d in bands.roles(len(a)):
            assert len(jaccard_join.cell_hashes(a, band, bands.cells(band))) > d


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (150, 200), (300, 301)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100, 300: 300, 301: 300}


def plain_targets(sizes, pattern=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: pattern[i % 3] for i, s in enumerate(order)}
    open_, left, out = set(order), 1.5 * sum(sizes.values()), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    source = {}
    sizes = Counter()
    for r in rows():
        source.setdefault(r[0], r[3])
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    goal = plain_targets(dict(sizes))
    assert len(got) == len(rows())
    for s in sizes:
        mine = [r for r in got if (r.source_size, round(r.target, 6)) == (sizes[s], round(goal[s], 6))]
        assert mine and all(r.taken == r.copies * r.size <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - goal[s]) <= 3 * max(r.size for r in mine)
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    taken = Counter(r.doc_id for r in mixing.repeat(docs).collect())
    assert taken == Counter({d: n for d, n in Counter(itertools.chain.from_iterable([r.doc_id] * r.copies for r in got)).items()})
    assert mixing.repeat(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_mixing_buckets(spark):
    data = [(i, "w " * (i % 17 + 1), "hot" if i % 3 else f"s{i % 5}") for i in range(9000)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    for goal, n in Counter({(r.source_size, r.target): 0 for r in got}).items():
        mine = [r for r in got if (r.source_size, r.target) == goal]
        assert abs(sum(r.taken for r in mine) - goal[1]) <= 17


def test_passages(spark, none):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    near = [w if i % 29 else word() for i, w in enumerate([word() for _ in range(120)])]
    edited = [w if i not in (40, 90) else word() for i, w in enumerate(near)]
    fill = lambda n: [word() for _ in range(n)]
    data = [(i, " ".join(fill(80))) for i in range(20)]
    data += [(100 + i, " ".join(fill(10 * i) + passage + fill(30))) for i in range(6)]
    data += [(200, " ".join(near)), (201, " ".join(fill(15) + edited)), (300, None), (301, ""), (302, " ".join(passage[:30])), (303, " ".join(fill(20000)))]
    got = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_id) for r in got} == {(100 + i, 100) for i in range(1, 6)} | {(201, 200)}
    for r in got:
        if r.doc_id < 200:
            n = 10 * (r.doc_id - 100)
            assert abs(r.start_word - n) <= 8 and abs(r.stop_word - n - 60) <= 8
    assert passages.repeated_passages(none).count() == 0


def test_passages_within_a_text_copies_nulls_and_clashing_names(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    fill = lambda n: [word() for _ in range(n)]
    passage, other = fill(60), fill(90)
    data = [(1, fill(40) + passage + fill(100) + passage + fill(30)), (2, other), (3, other), (None, other), (3, other), (4, ["same", "line", "again"] * 40), (5, None), (6, [])]
    frame = spark.createDataFrame([(i, None if t is None else " ".join(t), 1, "x") for i, t in data], "doc_id long, text string, id int, th string")
    got = {tuple(r) for r in passages.repeated_passages(frame).collect()}
    copies = {g for g in got if g[0] in (2, 3)}
    assert copies == {(2, None, 0, 90, 0, 90), (3, None, 0, 90, 0, 90)}
    own = [g for g in got if g[0] == g[1] == 1]
    assert len(own) == 1 and all(abs(x - y) <= 8 for x, y in zip(own[0][2:], (200, 260, 40, 100)))
    for g in got:
        if g[0] == g[1]:
            assert g[5] <= g[2] + 4 and g[3] - g[2] == g[5] - g[4]  # places do not overlap; 5-word shingles share their rims
    assert {g[0] for g in got} <= {1, 2, 3, 4}


def test_passages_with_heavy_signatures(spark):
    """The same passages however few windows make a signature heavy, and wherever rows lie."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    fill = lambda n: [word() for _ in range(n)]
    passage = fill(70)
    data = [(i, fill(10 + i % 9) + passage + fill(20)) for i in range(60)] + [(100 + i, fill(120)) for i in range(20)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in data], "doc_id long, text string")
    for light, parts in ((64, 2), (4, 5)):
        got = passages.repeated_passages(frame.repartition(parts), light=light).collect()
        assert {r.doc_id for r in got} == set(range(1, 60))
        for i in range(1, 60):
            assert min(r.start_word for r in got if r.doc_id == i) <= 10 + i % 9 + 2 and max(r.stop_word for r in got if r.doc_id == i) >= 10 + i % 9 + 68


def test_heavy_rows_are_chained_over_their_edges(spark):
    n = 9
    columns = [np.full(n, 8, passages.U64), np.arange(n), 100 + np.arange(n), np.full(n, 3), 10 + np.arange(n), np.full(n, 90)]
    columns = [c.astype(k) for c, k in zip(columns, passages._ENTRY_KINDS)]
    found = passages._heavy(columns, 2)  # rows of two windows
    rows = [(b"".join(x), h, f) for x, h, f in zip(zip(*(found.column(i).to_pylist() for i in range(1, 7))), found.column(7).to_pylist(), found.column(8).to_pylist())]
    hot = spark.createDataFrame(rows, "windows binary, heavy long, first struct<id: long, th: long, c: long, l: long, r: long>").repartition(3)
    met = passages._chained(hot).mapInArrow(passages._heavy_couples(20, 4), "bucket int, " + ", ".join(f"{c} binary" for c in passages._PAIR)).collect()
    pairs = {(a, b) for r in met for a, b in zip(np.frombuffer(r["id"], np.int64).tolist(), np.frombuffer(r["fid"], np.int64).tolist())}
    assert pairs == {(i, 0) for i in range(1, n)} | {(i, i - 1) for i in range(1, n)}


def test_supported_windows():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 80))
        pair = np.sort(rng.integers(0, 3, n))
        pair = np.unique(pair, return_inverse=True)[1]
        l, fl = rng.integers(0, 200, n), rng.integers(0, 200, n)
        w = rng.integers(0, 30, (4, n))
        a = np.stack([l, l + w[0], l + w[0] + w[1], fl, fl + w[2], fl + w[2] + w[3]], 1).astype(np.int32)
        f = rng.integers(0, 3, n)
        before, after = np.minimum(w[0], w[2]), np.minimum(w[1], w[3])
        holds = [before[i] + after[i] + 1 >= 10 for i in range(n)]
        for side in (1, 4):
            begins = [set(range(a[i, side] - before[i], a[i, side] + after[i] - 8)) for i in range(n)]
            holds = [holds[i] and any(len({int(f[j]) for j in range(n) if pair[j] == pair[i] and s in begins[j] and holds[j]}) >= 2 for s in begins[i]) for i in range(n)]
        assert passages.supported(pair, a, f, 10, 2).tolist() == holds


def test_compact_windows_are_all_ranges():
    rng = np.random.default_rng(1)
    per = np.array([0, 40, 7, 60])
    h = rng.integers(0, 50, per.sum()).astype(np.uint64)
    got, of = passages.compact_windows(h, per, 8)
    want, at = set(), 0
    for d, n in enumerate(per):
        x = h[at : at + n]
        for i in range(n - 7):
            c = i + int(x[i : i + 8].argmin())
            left = c
            while left > 0 and x[left - 1] > x[c]:
                left -= 1
            right = c
            while right < n - 1 and x[right + 1] >= x[c]:
                right += 1
            want.add((d, left, c, right))
        at += n
    assert {(d, *w) for d, w in zip(of.tolist(), map(tuple, got.tolist()))} == want


def test_url_filter(spark):
    urls = ["http://example.com/en/1", "https://www.EXAMPLE.com/en/x?y", "https://a.b.net/es/", "https://b.net/es", "http://net/fr/z#q", "ftp://foo.org/en/", None, "no scheme", "http://example.com", "://x.com/", "http://com/a://b/", "http://example.com/en/1"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0].lower()
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, *(max(fits)[1:] if fits else (None, "allow"))), u
    with pytest.raises(ValueError):
        url_filter.rule_table(spark, [("block", "a.b", "/x")])


def test_url_filter_on_odd_rows(spark):
    rules = url_filter.rule_table(spark, url_filter.RULES)
    schema = "page_id long, url string, _h string, _p string, row string, rule string, _url string, _u string, _s string"
    long = "http://" + ".".join(["a"] * 2000) + ".net/fr/" + "/".join(["b"] * 5000)
    data = [(None, "http://net/es/", *"abcdefg"), (1, long, *"abcdefg"), (1, long, *"abcdefg"), (2, None, *"abcdefg")]
    got = url_filter.judge(spark.createDataFrame(data, schema), rules).collect()
    assert sorted(((r.page_id, r.rule, r.verdict, r._h, r._p, r.row, r._url, r._u, r._s) for r in got), key=str) == sorted(
        [(None, "net/es/", "block", *"abcefg"), (1, "net/fr/", "block", *"abcefg"), (1, "net/fr/", "block", *"abcefg"), (2, None, "allow", *"abcefg")], key=str)
    assert url_filter.judge(spark.createDataFrame([], schema), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame(data, schema), rules.where("1 = 0"), default="block").collect()} == {"block"}


@pytest.mark.parametrize("act", [lambda d: line_dedup.dedup(d), lambda d: mixing.repeat(d), lambda d: sharding.with_slots(sharding.shard(d, [1.0, 1.0], [1.0, 1.0, 1.0])), lambda d: quality.score(d, quality.fit(np.zeros((0, 18)), np.zeros(0)))], ids=["line_dedup", "mixing", "sharding", "quality"])
def test_clashing_columns_pass_through(spark, act):
    names = ["row", "_size", "_source", "_key", "_id", "_th", "_o", "_t", "_p", "_a", "_b", "_co", "_ct", "_cov", "_l", "_kept", "_n", "_text", "_s", "_h", "_nb", "_sh", "_sb", "_from", "_r", "_bucket", "_copies", "n_docs", "target", "source_size"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names)
    data = [(i, t, "s", *range(100, 100 + len(names))) for i, t in enumerate(["a\nb\nc\nd", "a\nb\nc", None, "", "w " * 40])]
    got = act(spark.createDataFrame(data, schema)).collect()
    assert got and all([r[c] for c in names] == list(range(100, 100 + len(names))) for r in got)


def test_sharding(docs, none):
    got = sharding.assignment(docs, 5).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.grown_shard in (r.shard, 5) and 0 <= r.shard < 5
    for s, part in itertools.groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert [r.slot for r in part] == list(range(sum(r.shard == s for r in got)))
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.assignment(none).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(docs, [1, 2], [2, 1, 1])


def test_sharding_choice(docs):
    def unit(key, i):
        return (int(hashlib.md5(f"shard:{i}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)

    for r in sharding.assignment(docs, 5).collect():
        key = "null" if r.doc_id is None else str(r.doc_id)
        score = [-1 / math.log(unit(key, i)) for i in range(6)]
        assert (r.shard, r.grown_shard) == (score.index(max(score[:5])), score.index(max(score)))


def test_sharding_weights(spark):
    many = spark.range(20000).selectExpr("id as doc_id", "'x' as text")
    n = Counter(r.shard for r in sharding.shard(many, [1, 3]).select("shard").collect())
    assert 0.72 < n[1] / 20000 < 0.78


def test_sharding_of_keys_that_many_rows_share(spark, monkeypatch):
    """Slots stay gapless, and no bucket holds many rows, when null and one id fill most of the table."""
    monkeypatch.setattr(sharding, "_BUCKET_ROWS", 20)
    data = [(None, f"n {i}") for i in range(700)] + [(5, f"five {i}") for i in range(500)] + [(i, "x") for i in range(10, 400)]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sharding.assignment(table, 2).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32(t.encode())) for i, t in data)
    for s in range(2):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    hashed = lambda r: int(hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16)
    assert all([hashed(r) for r in part] == sorted(hashed(r) for r in part) for part in (sorted((r for r in got if r.shard == s), key=lambda r: r.slot) for s in range(2)))
    assert {(r.doc_id, r.text_crc32, r.slot) for r in got} == {(r.doc_id, r.text_crc32, r.slot) for r in sharding.assignment(table.repartition(5), 2).collect()}


def test_mixing_of_null_ids_in_number(spark):
    """Null ids have keys of their own texts: as many of them are taken as the target asks for."""
    data = [(None, f"w{i} " * (i % 5 + 1), "hot") for i in range(900)] + [(i, "a b c", f"s{i % 4}") for i in range(600)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    assert len(got) == len(data)
    mine = [r for r in got if r.doc_id is None]
    assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(table.repartition(7)).collect()))


def test_line_dedup(docs, none):
    seen, want = {}, []
    for key, text in sorted({(r[0] if r[0] is not None else 1 << 63, r[1]) for r in rows() if r[1] is not None}, key=lambda x: x[0]):
        lines = text.split("\n")
        cut = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip(" "):
                if seen.setdefault(w, (key, p)) != (key, p):
                    cut |= {p, p + 1, p + 2}
        want.append((key, "\n".join(x for i, x in enumerate(lines) if i not in cut), len(lines), len(cut)))
    want = {(k, *r) for k, *r in want} | {(r[0], None, 0, 0) for r in rows() if r[1] is None}
    got = line_dedup.dedup(docs).collect()
    assert len(got) == len(rows())
    assert {(r.doc_id if r.doc_id is not None else 1 << 63, r.text, r.n_lines, r.n_removed) for r in got} == want
    assert line_dedup.dedup(none).count() == 0


def test_line_dedup_across_documents(spark):
    block = "a\nb\nc\nd"
    data = [(5, "x\n" + block + "\ny"), (2, block), (9, "a\nb\nq"), (7, block + "\nz\n" + block)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {2: block, 5: "x\ny", 9: "a\nb\nq", 7: "z"}


def test_quality(spark, none):
    rng = random.Random(2)
    good = [prose(rng, rng.randint(20, 200)) for _ in range(300)]
    bad = ["!! ".join(prose(rng, 40).upper().split()) for _ in range(100)] + [" ".join([rng.choice("abc") * 3] * 50) for _ in range(100)]
    texts = good + bad
    docs = spark.createDataFrame([*[(i, t, "s") for i, t in enumerate(texts)], (900, None, "x"), (901, "", "x"), (0, good[0], "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*[(i, int(i < 300)) for i in range(len(texts))], (5, None), (None, 1)], "doc_id long, quality int")
    got = quality.predictions(docs, labels).collect()
    assert len(got) == len(texts) + 3 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert held and np.mean([r.predicted == (r.doc_id < 300) for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1 and len({r.score for r in got if r.doc_id == 0}) == 1
    assert {r.score for r in quality.predictions(docs, labels.where("quality = 7")).collect()} == {0.5}
    assert quality.predictions(none, labels).count() == 0


def plain_chunks(raw):
    """Digest -> length by the definition: a hash of the last 32 bytes at each position, one boundary after the other."""
    gear = [int(x) for x in fingerprints._GEAR]
    out, at = {}, 0
    while at < len(raw):
        end, h = len(raw), 0
        for i in range(max(0, at - 64), len(raw)):
            h = ((h << 1) + gear[raw[i]]) & 0xFFFFFFFF
            n = i - at + 1
            if n < 32 or i + 1 >= len(raw):
                continue
            if (h >> 24 == 0) if n < 96 else (h >> 27 == 0):
                end = i + 1
                break
            if n >= 384:
                end = i + 1
                break
        if len(raw) - at <= 32:
            end = len(raw)
        out[hashlib.blake2b(raw[at:end], digest_size=8).digest()] = end - at
        at = end
    return out


def test_fingerprints(docs, none, spark):
    data = sorted(((r[0], r[1] or "") for r in rows() if r[0] is not None and r[0] != 9), key=lambda x: x[0])
    got = {r.doc_id: r for r in fingerprints.successions(docs.where("doc_id is not null and doc_id <> 9")).collect()}
    assert len(got) == len(data)
    text_of = lambda fp: ",".join(f"{d.hex()}:{n}" for d, n in sorted(fp.items()))
    for (i, t), (_, nxt) in zip(data, [*data[1:], data[0]]):
        half = len(t) // 2
        edited = (t[: len(t) - half] + nxt[:half]).encode()
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited).hexdigest())
        mine, new, after = plain_chunks(t.encode()), plain_chunks(edited), plain_chunks(nxt.encode())
        assert (r.fingerprint, r.edited_fingerprint) == (text_of(mine), text_of(new))
        for other, near, within in ((new, r.near_edited, r.in_edited), (after, r.near_next, r.in_next)):
            both = sum(n for d, n in mine.items() if d in other)
            assert near == pytest.approx(both / max(sum(mine.values()), sum(other.values())) if mine and other else float(not mine and not other))
            assert within == pytest.approx(both / sum(mine.values()) if mine else 1.0)
    assert fingerprints.successions(docs).count() == len(rows())
    assert fingerprints.successions(none).count() == 0
    assert fingerprints.successions(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first().near_next == 1.0
    text = prose(random.Random(8), 3000)
    assert fingerprints.likeness(fingerprints.chunks(text.encode()), fingerprints.chunks(("new start " + text).encode())) > 0.95
    assert fingerprints.containment(fingerprints.chunks(text[5000:9000].encode()), fingerprints.chunks(text.encode())) > 0.8
    stored = fingerprints.fingerprint(docs).where("doc_id = 0").first()
    assert sum(c.length for c in stored.fingerprint) == len(rows()[0][1].encode())


def test_fingerprints_of_null_and_repeated_ids(spark):
    """Many null ids are cut into ranges of their own; each row still has one successor."""
    data = [(None, prose(random.Random(i), 30)) for i in range(60)] + [(i, prose(random.Random(1000 + i), 20)) for i in range(20)] + [(7, "again"), (7, "again")]
    got = fingerprints.successions(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t in data)
    # each row's edited text shows its successor: every row is that of one, and ids go up to the nulls
    next_of = {}
    for i, t in data:
        h = len(t) // 2
        next_of.setdefault((i, len(t)), []).append({hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest(): (j, u) for j, u in data})
    found = [(r.doc_id, r.n_chars, [m[r.edited_sha256] for m in next_of[r.doc_id, r.n_chars] if r.edited_sha256 in m]) for r in got]
    assert all(hits for _, _, hits in found)
    after = Counter(hits[0] for _, n, hits in found if n > 5)  # the two short rows show too little of theirs
    assert len(data) - 2 == sum(after.values()) and not after - Counter(data)
    place = {i: n for n, i in enumerate([*range(20), None])}
    assert all(place[j] - place[i] in (0, 1) for i, n, hits in found if n > 5 and i is not None for j, _ in hits[:1])
    assert sum(i is None and hits[0][0] is not None for i, n, hits in found if n > 5) == 1  # the last one's is the first


def test_fingerprint_ranges_cut_an_id_that_many_rows_share(spark):
    """Ranges follow (id, text hash), nulls last, each with the next one's first row; a repeated id has several."""
    data = [(None, f"n{i}") for i in range(300)] + [(7, f"seven {i}") for i in range(500)] + [(i, f"t{i}") for i in range(-100, 200)]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = fingerprints.ranged(table, "doc_id", "text", range_bytes=500).collect()
    own = [r for r in got if not r.look]
    assert Counter((r.id, r.text) for r in own) == Counter(data)
    ranges = {}
    for r in got:
        ranges.setdefault(r.b, []).append(r)
    assert len({r.b for r in own if r.id == 7}) > 2 and len({r.b for r in own if r.id is None}) > 2
    order = sorted(ranges)
    place = lambda r: (r.id is None, r.id or 0)
    assert [place(r) for b in order for r in ranges[b] if not r.look] == sorted(place(r) for r in own)
    for b, after in zip(order, [*order[1:], order[0]]):
        assert [(r.id, r.text) for r in ranges[b] if r.look] == [(ranges[after][0].id, ranges[after][0].text)]
        assert ranges[b][-1].look


def test_words_and_shingles_follow_the_definition():
    import pyarrow as pa

    texts = [r[1] for r in rows()]
    data, offsets = textkit.buffers(pa.array(texts))
    hashed, per = textkit.words(data, offsets)
    assert per.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    grams, gper = textkit.shingles(hashed, per)
    ends = np.cumsum(gper)
    assert [len(set(grams[e - n : e].tolist())) for e, n in zip(ends, gper)] == [len(plain_sets(t)) for t in texts]
