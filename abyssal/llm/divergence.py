"""Operator 12: source divergence audit by count-level bitmaps.

Each language keeps the terms of at least ``least`` of its documents. A group, (lang, source), has for each count that a kept
term has in it a bitset of the ids of these terms. For a pair of groups of a language, AND and popcount of two levels give
the number of terms with these two counts, which is multiplied by f of the two counts; terms that only one of the two has
are its level's bits less the joint ones, and terms that neither has are the complement.

Scale. Terms are counted in each batch, then by (lang, source, term). Kept terms fall into blocks by hash, in which ids go by
falling frequency, so that the terms of a 64-bit word have few different counts; only words that are not 0 are kept. Sources
are dealt to packs; a task meets two packs in one block, whose sizes are bounded by ``block_terms`` and ``pack``. Values of
blocks are summed. All numbers are integers.

Defined results: a null text, lang or source is ''; a group whose documents have no kept term has count 0 for all terms; with
no kept term in a language its pairs have value 0; a language of one source has no pairs; rows that repeat count as often;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abyssal.llm.common import materialise, ship, small_or_plain, tidy

TERM = re.compile(rb"[a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^a-z\x80-\xff]")
SCALE = 1_000_000_000
_PIECE = 1 << 20


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lower case, in lists of about a piece of text each."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + _PIECE)
        to = cut.end() if cut else len(text)
        yield TERM.findall(text, at, to)
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, occurrences, documents) of each batch."""
    for batch in batches:
        n: dict = defaultdict(Counter)
        docs: dict = defaultdict(Counter)
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own: Counter = Counter()
            for piece in terms_of(text.lower()):  # bytes: only A-Z change
                own.update(piece)
            n[lang, source].update(own)
            docs[lang, source].update(own.keys())
        rows = [(lang, source, term, c, docs[lang, source][term]) for (lang, source), own in n.items() for term, c in own.items()]
        kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()}
        columns = list(zip(*rows)) or [()] * 5
        columns[2] = [t.decode("utf-8", "replace") for t in columns[2]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def p_of(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact; 1 where there are no terms."""
    wide = lambda c: c.cast("decimal(38,0)")
    over = F.when(v > 0, wide(total) + F.lit(2) * wide(v))
    return F.coalesce(F.call_function("div", (F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")).cast("decimal(38,0)"), over.cast("decimal(38,0)")), F.lit(0)) + 1


def f_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def joint(a: dict, b: dict, terms: int) -> int:
    """The sum of f over all terms of a block, from two groups' levels sorted by word.

    A group is p0, its p at count 0, and arrays word, p and bits, one entry per level and word.
    """
    lo, hi = np.searchsorted(b["word"], a["word"], "left"), np.searchsorted(b["word"], a["word"], "right")
    per = hi - lo
    i = np.repeat(np.arange(len(per)), per)
    j = np.repeat(lo, per) + np.arange(len(i)) - np.repeat(np.cumsum(per) - per, per)
    both = np.bitwise_count(a["bits"][i] & b["bits"][j]).astype(np.int64)
    some = both > 0
    i, j, both = i[some], j[some], both[some]
    value = int((both * _f(a["p"][i], b["p"][j])).sum())
    only_a = a["size"] - np.bincount(i, both, len(a["p"])).astype(np.int64)
    only_b = b["size"] - np.bincount(j, both, len(b["p"])).astype(np.int64)
    value += int((only_a * _f(a["p"], np.int64(b["p0"]))).sum()) + int((only_b * _f(b["p"], np.int64(a["p0"]))).sum())
    neither = terms - int(a["size"].sum()) - int(only_b.sum())
    return value + neither * int(_f(np.int64(a["p0"]), np.int64(b["p0"])))


def _pairs(table: pa.Table) -> pa.Table:
    """All pairs of two packs' groups in one block: (lang, a, b, value), a before b."""
    lang, terms = table["lang"][0].as_py(), table["terms"][0].as_py()
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    groups = []
    for row in table.select(["source", "pack", "p0", "word", "p", "bits"]).to_batches():
        for k in range(row.num_rows):
            get = lambda c: row.column(c)[k].values.to_numpy(zero_copy_only=False) if row.column(c)[k].is_valid else np.zeros(0, np.int64)  # noqa: E731, B023
            word = get("word")
            order = np.argsort(word, kind="stable")
            bits = get("bits")[order].view(np.uint64)
            groups.append({"source": row.column("source")[k].as_py(), "pack": row.column("pack")[k].as_py(), "p0": row.column("p0")[k].as_py(), "word": word[order], "p": get("p")[order], "bits": bits, "size": np.bitwise_count(bits).astype(np.int64)})
    groups.sort(key=lambda g: g["source"].encode())
    out = [(x["source"], y["source"], joint(x, y, terms)) for n, x in enumerate(groups) for y in groups[n + 1 :] if {x["pack"], y["pack"]} == {low, high}]
    a, b, value = zip(*out) if out else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def kept_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 10) -> DataFrame:
    """(lang, term, total, by): terms of at least ``least`` documents of the language, with (source, n) for each source that has it."""
    ship(docs.sparkSession)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(word(lang_col).alias("lang"), word(source_col).alias("source"), word(text_col).cast("binary").alias("text"))
    counts = rows.mapInArrow(tidy(_counted), "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))
    return terms.where(F.col("df") >= least).select("lang", "term", "total", "by")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 10, top: int = 10, block_terms: int = 16_384, pack: int = 32) -> DataFrame:
    """(lang, source, part, item, value, rank): the contract's rows."""
    word = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    kept = materialise(kept_terms(docs, lang_col, source_col, text_col, least), "kept_terms")
    by = kept.select("lang", "term", "total", F.explode("by").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    sums = by.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_words"))
    groups = docs.select(word(lang_col, "lang"), word(source_col, "source")).distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = materialise(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("v", "words", "lang_words")]), "groups")
    small = small_or_plain(groups, groups.count(), 100_000)

    # part 'term': a language's p against the group's, for the terms that the group has
    p = by.join(small, ["lang", "source"]).select("lang", "source", "term", p_of(F.col("n"), F.col("words"), F.col("v")).alias("p"), p_of(F.col("total"), F.col("lang_words"), F.col("v")).alias("q")).where("p > q")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    by_term = ranked(p.select("lang", "source", F.col("term").alias("item"), f_of(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top)

    # part 'pair': levels as bitsets in blocks
    blocks = F.greatest(F.ceil(F.col("v") / block_terms), F.lit(1)).cast("long")
    v_of = groups.groupBy("lang").agg(F.max("v").alias("v"), F.greatest(F.ceil(F.count(F.lit(1)) / pack), F.lit(1)).cast("long").alias("packs"))
    v_of = small_or_plain(v_of, v_of.count(), 100_000)
    ids = kept.select("lang", "term", "total", "by").join(v_of.select("lang", "v"), "lang").select("lang", "term", "total", "by", F.pmod(F.xxhash64("term"), blocks).alias("block"))
    ids = ids.withColumn("id", F.row_number().over(W.partitionBy("lang", "block").orderBy(F.col("total").desc(), "term")) - 1)
    ids = materialise(ids.select("lang", "block", "id", "by"), "term_ids")
    sizes = ids.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("terms"))
    levels = ids.select("lang", "block", F.expr("id div 64").alias("word"), F.expr("shiftleft(1L, cast(id % 64 as int))").alias("bit"), F.explode("by").alias("e"))
    levels = levels.groupBy("lang", "block", F.col("e.source").alias("source"), F.col("e.n").alias("n"), "word").agg(F.bit_or("bit").alias("bits"))
    levels = levels.join(small, ["lang", "source"]).select("lang", "block", "source", "word", p_of(F.col("n"), F.col("words"), F.col("v")).alias("p"), "bits")
    levels = levels.groupBy("lang", "block", "source").agg(F.collect_list(F.struct("word", "p", "bits")).alias("l"))
    every = groups.join(v_of.select("lang", "packs"), "lang").select("lang", "source", F.pmod(F.xxhash64("source"), F.col("packs")).alias("pack"), "packs", p_of(F.lit(0), F.col("words"), F.col("v")).alias("p0"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    every = every.join(sizes, ["lang", "block"], "left").join(levels, ["lang", "block", "source"], "left")
    met = every.select("lang", "block", "source", "pack", "p0", F.coalesce("terms", F.lit(0)).cast("long").alias("terms"), *[F.col(f"l.{c}").alias(c) for c in ("word", "p", "bits")], F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1)).alias("other"))
    met = met.select("*", F.least("pack", "other").alias("low"), F.greatest("pack", "other").alias("high")).drop("other")
    values = met.groupBy("lang", "block", "low", "high").applyInArrow(_pairs, "lang string, a string, b string, value long")
    values = materialise(values.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pair_values")
    both = values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(values.select("lang", "b", "a", "value"))
    by_pair = ranked(both)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return out(by_pair, "pair").union(out(by_term, "term"))


ORACLE = r"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from w group by lang, term having count(distinct rid) >= 10),
v as (select lang, count(k.term) as v from (select distinct lang from d) left join k using (lang) group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by lang, source, term),
s as (select lang, source, coalesce(sum(n), 0) as words from g left join c using (lang, source) group by lang, source),
a as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k using (lang) left join c using (lang, source, term)),
p as (select a.lang, a.source, a.term, a.n, 1 + (cast(1000000000 as hugeint) * (a.n + 2)) // (s.words + 2 * v.v) as p from a join s using (lang, source) join v using (lang)),
l as (select lang, term, sum(n) as n from a group by lang, term),
q as (select l.lang, l.term, 1 + (cast(1000000000 as hugeint) * (l.n + 2)) // ((select sum(n) from l as m where m.lang = l.lang) + 2 * v.v) as q from l join v using (lang)),
x as (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by x.lang, x.source, y.source),
pair as (select g.lang, g.source, h.source as item, coalesce(x.value, 0) as value from g join g h on g.lang = h.lang and g.source <> h.source left join x on x.lang = g.lang and x.source = g.source and x.item = h.source),
term as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p join q using (lang, term) where n > 0 and p > q),
u as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pair
  union all select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from term) where rank <= 10)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from u
"""
