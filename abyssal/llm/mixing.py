"""Operator 4: mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Each document gets an exponential key, -ln(u) / w, from a hash of its doc_id and its quality weight. A source with a
target takes complete epochs first (target div source size), then the documents of least keys until the rest of the
budget is used: a document counts as taken when at least half of it fits, so a source misses its target by at most half
of one document.

The order within a source is cut into buckets by the key's logarithm, so no task sorts a whole source: bucket sizes are
summed first, and only the one bucket of each source in which the budget ends is sorted and prefix-summed. What is left
is one row per source, against which documents are compared by (bucket, key, doc_id, text hash).

Targets: sources in code-point order, null last, weigh by a repeating pattern and share a budget; no target exceeds
``most`` times its source's size and the excess is reshared by weight. The water level is closed-form: sources sorted by
size / weight, prefix sums of the capped ones.

Defined results: null text has size 0; documents of size 0 are taken 0 words; a null source is a source of its own; a
null doc_id hashes by its text, so that many of them do not share one key; rows alike in doc_id and text are taken alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abyssal.llm.common import WORD, carried, materialise

_BUCKET_ROWS = 2000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def clean_share(text: Column) -> Column:
    """A quality weight in [0.05, 1]: the share of characters that are not symbols of markup or shouting."""
    n = F.char_length(text).cast("double")
    rest = F.char_length(F.translate(text, "!#$%&*|", "")).cast("double")
    return F.when(n > 0, F.greatest(F.lit(0.05), rest / n)).otherwise(F.lit(1.0))


def sampling_key(id_: Column, weight: Column, otherwise: Column, seed: str = "mix") -> Column:
    """-ln(u) / weight with u hashed from the id; from ``otherwise`` where it is null."""
    name = F.coalesce(id_.cast("string"), F.concat(F.lit("null:"), otherwise.cast("string")))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def targets(stats: DataFrame, pattern: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """stats(source, source_size, n_docs) with weight and target. One row per source goes through one window."""
    ranked = stats.withColumn("_i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in pattern]), (F.col("_i") % len(pattern) + 1).cast("int"))
    capped = ranked.withColumn("_w", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    capped = capped.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by = W.orderBy("_ratio", "_i")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(0, W.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    capped = capped.withColumn("_level", level)
    # the level rises while sources below it are capped and falls afterwards
    water = F.max("_level").over(W.partitionBy())
    return capped.select("source", "source_size", "n_docs", F.least(F.col("_cap"), water * F.col("_w")).alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None) -> DataFrame:
    """(row, _size, _source, _key, _id, _th); row holds the columns of docs."""
    text = F.col(text_col)
    weight = clean_share(text) if weight is None else F.greatest(F.lit(0.001), F.coalesce(weight, F.lit(0.001)))
    key = sampling_key(F.col(id_col), weight, F.xxhash64(text))
    return docs.select(carried(docs).alias("row"), n_words(text).alias("_size"), F.col(source_col).alias("_source"), key.alias("_key"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"))


def _bucket() -> Column:
    """Rises with the key, in equal steps of its logarithm, finer for larger sources: whatever the weights, a bucket holds few documents."""
    return F.floor(F.log2("_key") * F.ceil(F.col("n_docs") / _BUCKET_ROWS)).cast("long")


def _order() -> Column:
    return F.struct(F.col("_key").alias("k"), F.col("_id").cast("string").alias("i"), F.col("_th").alias("t"))


def plan(small: DataFrame, **how) -> DataFrame:
    """From (_id, _source, _size, _key, _th): one row per source with its target, complete epochs and where the rest ends."""
    stats = small.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = targets(stats, **how).withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = materialise(goal.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")), "mix_targets")
    rows = small.join(goal, small["_source"].eqNullSafe(goal["source"])).withColumn("_bucket", _bucket())
    sums = rows.groupBy("source", "_bucket").agg(F.sum("_size").alias("_s"), F.first("_rest").alias("_rest"))
    sums = sums.withColumn("_from", F.sum("_s").over(W.partitionBy("source").orderBy("_bucket")) - F.col("_s"))
    ends = sums.where("_from <= _rest").groupBy("source").agg(F.max(F.struct("_bucket", "_from")).alias("_e")).select(F.col("source").alias("_es"), F.col("_e._bucket").alias("_end"), F.col("_e._from").alias("_from"))
    last = rows.join(ends, rows["source"].eqNullSafe(ends["_es"]) & (rows["_bucket"] == ends["_end"]))
    run = W.partitionBy("source").orderBy(_order()).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = last.withColumn("_before", F.col("_from") + F.sum("_size").over(run) - F.col("_size")).where(F.col("_before") + F.col("_size") / 2 <= F.col("_rest"))
    cut = last.groupBy("source").agg(F.max(_order()).alias("_cut")).withColumnRenamed("source", "_cs")
    out = goal.join(ends.drop("_from"), F.col("source").eqNullSafe(F.col("_es")), "left").join(cut, F.col("source").eqNullSafe(F.col("_cs")), "left")
    return materialise(out.select(F.col("source").alias("_ps"), "source_size", "n_docs", "target", "_epochs", "_end", "_cut"), "mix_plan")


def copies(rows: DataFrame, planned: DataFrame, out_col: str = "copies") -> DataFrame:
    """rows of ``sized`` with source_size, target and how often the mix takes each."""
    at = rows.join(planned, F.col("_source").eqNullSafe(F.col("_ps"))).withColumn("_bucket", _bucket())
    chosen = (F.col("_bucket") < F.col("_end")) | ((F.col("_bucket") == F.col("_end")) & (_order() <= F.col("_cut")))
    return at.withColumn(out_col, F.col("_epochs") + F.coalesce(chosen.cast("int"), F.lit(0))).drop("_ps", "n_docs", "_epochs", "_end", "_cut", "_bucket")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, **how) -> DataFrame:
    """(id_col, size, source_size, target, copies, taken) of each document."""
    small = materialise(sized(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, weight).select("_id", "_source", "_size", "_key", "_th"), "mix_sizes")
    done = copies(small, plan(small, **how))
    return done.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).cast("long").alias("taken"))


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, **how) -> DataFrame:
    """docs as the mix takes them: each row as many times as it is taken, only its own columns, whatever their names.

    ``weight`` is a quality weight, as a classifier's score; null and what is under 0.001 count as 0.001.
    """
    rows = sized(docs, id_col, text_col, source_col, weight)
    small = materialise(rows.select("_id", "_source", "_size", "_key", "_th"), "mix_sizes")
    return copies(rows, plan(small, **how), "_copies").where("_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


ORACLE = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
  case when length(text) > 0 then greatest(cast(0.05 as double), cast(length(translate(text, '!#$%&*|', '')) as double) / cast(length(text) as double)) else cast(1 as double) end as w,
  (cast(cast('0x' || substr(md5('mix:' || cast(doc_id as varchar)), 1, 13) as bigint) as double) + cast(0.5 as double)) / cast(4503599627370496 as double) as u from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source),
c as (select *, cast([3, 1, 2][i % 3 + 1] as double) as wt, cast(2 as double) * source_size as cap from s),
r as (select *, cap / wt as ratio from c),
v as (select *, (cast(1.5 as double) * (select sum(source_size) from s)::bigint - coalesce(sum(cap) over (order by ratio, i rows between unbounded preceding and 1 preceding), cast(0 as double)))
  / sum(wt) over (order by ratio, i rows between current row and unbounded following) as level from r),
t as (select source, source_size, least(cap, (select max(level) from v) * wt) as target from v),
e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
p as (select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
  sum(d.size) over (partition by d.source order by -ln(u) / w, doc_id rows between unbounded preceding and current row) - d.size as before
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, cast((epochs + case when before + size / cast(2 as double) <= rest then 1 else 0 end) as int) as copies,
  cast((epochs + case when before + size / cast(2 as double) <= rest then 1 else 0 end) * size as bigint) as taken from p
"""
