"""Operator 7: sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair hashes to u in (0, 1); a record goes to the shard with the largest -weight / ln(u). A shard's
scores do not depend on the other shards, so one more shard only takes records, in proportion to its weight.

Slots number a shard's records without gaps. A shard is cut into buckets by the record's hash, so that no task sorts a
whole shard: buckets are counted, their counts prefix-summed, and slots are offset plus rank within the bucket. A key that
many rows share, as null may be, is cut further by the texts' checksums.

Defined results: a null text has no bytes and checksum 0; a null key hashes as 'null'; rows that repeat a key share its
shard and have slots of their own; an empty table gives no rows; columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abyssal.llm.common import carried, materialise, small_or_plain

_BUCKET_ROWS = 20_000


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null"))


def unit(key: Column, shard: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), shard.cast("string"), F.lit(":"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def scores(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """Array of (score, -shard)."""
    held = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda i: F.struct((-held[i] / F.log(unit(key, i, seed))).alias("s"), (-i).alias("i")))


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: str = "shard") -> DataFrame:
    """docs with size, text_crc32, shard, slot, and grown_shard for the longer list of weights ``grown``."""
    if grown is not None and list(grown[: len(weights)]) != list(weights):
        raise ValueError("grown must begin with weights")
    key = _key(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    new = ("size", "text_crc32", "shard", "grown_shard")
    full = list(grown or weights)
    rows = docs.select(carried(docs).alias("row"), F.octet_length(text).cast("long").alias("size"), F.crc32(text).cast("long").alias("crc"), scores(key, full, seed).alias("s"))
    first = lambda x: (-F.array_max(x).getField("i")).cast("int")
    return rows.select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c not in new], (F.col("size") + 8).alias("size"), F.col("crc").alias("text_crc32"),
        first(F.slice("s", 1, len(weights))).alias("shard"), (first(F.col("s")) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )


def with_slots(sharded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A gapless slot from 0 within each shard, in the order of (hash of the key, key, checksum).

    A key with more than _BUCKET_ROWS rows is cut into pieces by the checksum. The table is read several times: pass one that
    is written, or cheap to compute.
    """
    total = sharded.groupBy(F.col("shard").alias("sh")).agg(F.ceil(F.count(F.lit(1)) / _BUCKET_ROWS).alias("nb"))
    hashed = F.conv(F.substring(F.md5(_key(id_col)), 1, 8), 16, 10).cast("long")
    rows = sharded.select(carried(sharded, ("slot",)).alias("row"), F.col("shard").alias("s"), hashed.alias("h"), F.col(id_col).alias("id"), F.col("text_crc32").alias("crc"))
    rows = rows.join(total, F.col("s") == F.col("sh")).withColumn("b", F.floor(F.col("h") * F.col("nb") / float(1 << 32)).cast("long")).drop("sh", "nb")
    # keys that many rows share, as null may be: of the few overfull buckets, those alone are counted by key
    full = rows.groupBy(F.col("s").alias("fs"), F.col("b").alias("fb")).count().where(F.col("count") > 4 * _BUCKET_ROWS).select("fs", "fb")
    hot = rows.join(full, (F.col("s") == F.col("fs")) & (F.col("b") == F.col("fb"))).groupBy("s", "b", "h").count().where(F.col("count") > _BUCKET_ROWS)
    hot = hot.groupBy(F.col("s").alias("hs"), F.col("b").alias("hb")).agg(F.collect_list(F.struct("h", F.ceil(F.col("count") / _BUCKET_ROWS).alias("cuts"))).alias("hot"))
    hot = materialise(hot, "hot_keys")
    rows = rows.join(small_or_plain(hot, hot.count(), 100_000), (F.col("s") == F.col("hs")) & (F.col("b") == F.col("hb")), "left")
    cuts = F.get(F.filter("hot", lambda x: x["h"] == F.col("h")), F.lit(0)).getField("cuts")
    below = F.when(F.col("hot").isNull(), 0).otherwise(2 * F.size(F.filter("hot", lambda x: x["h"] < F.col("h"))) + cuts.isNotNull().cast("int"))
    piece = F.coalesce(F.floor(F.col("crc") * cuts / float(1 << 32)), F.lit(0)).cast("long")
    rows = rows.select("row", "s", "h", "id", "crc", F.struct("b", below.alias("q"), piece.alias("p")).alias("b"))
    sums = rows.groupBy(F.col("s").alias("sh"), F.col("b").alias("sb")).agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("sh", "sb", (F.sum("n").over(W.partitionBy("sh").orderBy("sb")) - F.col("n")).alias("from"))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("s", "b").orderBy("h", "id", "crc")) - 1)
    rows = rows.join(sums, (F.col("s") == F.col("sh")) & (F.col("b") == F.col("sb")))
    return rows.select(*[F.col(f"row.`{c}`") for c in sharded.columns if c != "slot"], (F.col("from") + F.col("r")).cast("long").alias("slot"))


def assignment(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The contract's columns."""
    rows = shard(docs.select("doc_id", "text"), [1.0] * n_shards, [1.0] * (n_shards + 1)).drop("text")
    return with_slots(materialise(rows, "sharded")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The same in DuckDB: md5 gives the hash units, the largest -1 / ln(u) wins, ties to the lower shard. The checksum is
#: reduced byte by byte over a table of 256 remainders, eight shifts each.
_SHIFT = "case when {0} & 1 = 1 then xor({0} >> 1, 3988292384) else {0} >> 1 end"
ORACLE = r"""
with recursive steps as (select cast(i as bigint) as i, cast(i as bigint) as r, 0 as n from range(256) t(i) union all select i, {shift}, n + 1 from steps where n < 8),
crcs as (select list(r order by i) as t from steps where n = 8),
c as (select doc_id, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda p: cast(cast('0x' || p as int) as bigint))),
  lambda a, b: xor(a >> 8, t[cast(xor(a, b) & 255 as int) + 1])), cast(4294967295 as bigint)) as crc from documents, crcs),
d as (select doc_id, coalesce(cast(doc_id as varchar), 'null') as key, coalesce(text, '') as text from documents),
s as (select doc_id, key, i, cast(-1 as double) / ln((cast(cast('0x' || substr(md5('shard:' || cast(i as varchar) || ':' || key), 1, 13) as bigint) as double) + cast(0.5 as double)) / cast(4503599627370496 as double)) as score from (select distinct doc_id, key from d), range(25) r(i)),
b as (select key, min_by(i, struct_pack(a := -score, b := i)) filter (i < 24) as shard, min_by(i, struct_pack(a := -score, b := i)) as grown_shard from s group by key),
p as (select d.*, cast(b.shard as int) as shard, cast(b.grown_shard as int) as grown_shard, cast('0x' || substr(md5(d.key), 1, 8) as bigint) as h from d join b using (key))
select doc_id, cast(strlen(text) + 8 as bigint) as size, crc as text_crc32, 'key' as law, shard, row_number() over (partition by shard order by h, doc_id) - 1 as slot, grown_shard from p join c using (doc_id)
""".replace("{shift}", _SHIFT.format("r"))
