"""Operator 6: URL filters by hashed host-suffix and path-prefix expressions. DataFrame functions only.

Each distinct URL becomes its host suffixes times its path prefixes, as long as rules are at most. Expressions meet rules in an equi-join on a short
prefix of their SHA-256; the full digest then confirms, and of a URL's rules the longest wins.

Distinct URLs pre-aggregate, so a URL or host with a third of all rows is judged once; the join back to pages has one row
per URL on one side. Rules are broadcast only while their counted rows stay within a bound.

Defined results: a null URL or one without '://' has an empty host and path and no rule; a URL without a rule gets the
default verdict; rule paths begin and end with '/'; rules that repeat count once, and of rules alike in host and path
'block' wins; a longer rule wins, then the longer host; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abyssal.llm.common import carried, small_or_plain

_PREFIX = 8  # hex digits of the short hash
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    # 1: host, 2: what follows up to ? or #
    parts = lambda i: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(parts(1), _CAPITALS, _SMALL), parts(2)


def expressions(host: Column, path: Column, most_labels: int = 1 << 30, most_parts: int = 1 << 30) -> Column:
    """Array of (host suffix, path prefix) of up to so many labels and slashes. A path's prefixes end at its slashes."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit(most_labels) + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path, "/", -1)
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(most_parts))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    paths = F.when(F.size(parts) > 1, paths).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) -> the table of rules."""
    rows = [(v, h.lower(), p) for v, h, p in rules]
    if bad := [r for r in rows if not (r[2].startswith("/") and r[2].endswith("/")) or r[0] not in ("allow", "block")]:
        raise ValueError(f"a rule is allow or block, and its path begins and ends with '/': {bad[0]}")
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", most_broadcast: int = 100_000) -> DataFrame:
    """pages with host, path, rule and verdict; columns named like these are replaced."""
    digest = lambda h, p: F.sha2(F.concat(h, p), 256)
    held = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    held = held.select(F.col("host").alias("_rh"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_v"), digest(F.col("host"), F.col("path")).alias("_rd"))
    held = held.withColumn("_rs", F.substring("_rd", 1, _PREFIX))
    urls = pages.select(F.col(url_col).alias("_u")).distinct()
    host, path = host_and_path(F.col("_u"))
    urls = urls.select("_u", host.alias("_h"), path.alias("_p"))
    # no rule has more labels or slashes, so longer expressions fit none
    most = rules.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.max(F.size(F.split("path", "/", -1)) - 1).alias("parts")).first()
    parts = urls.where("_h <> ''").select("_u", F.explode(expressions(F.col("_h"), F.col("_p"), most.labels or 1, most.parts or 1)).alias("e")).select("_u", digest(F.col("e.h"), F.col("e.p")).alias("_d"))
    # the short prefix is the join's key; the full digest is confirmed on what meets
    hits = parts.withColumn("_s", F.substring("_d", 1, _PREFIX)).join(small_or_plain(held, most.n, most_broadcast), F.col("_s") == F.col("_rs"))
    hits = hits.where(F.struct("_d") == F.struct(F.col("_rd").alias("_d")))
    best = hits.groupBy("_u").agg(F.max(F.struct(F.length("_rule").alias("a"), F.length("_rh").alias("b"), F.col("_rule").alias("rule"), F.col("_v").alias("v"))).alias("_b"))
    best = best.select(F.col("_u").alias("_bu"), F.col("_b.rule").alias("_rule"), F.col("_b.v").alias("_v"))
    host, path = host_and_path(F.col(url_col))
    new = ("host", "path", "rule", "verdict")
    rows = pages.select(carried(pages).alias("row"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    out = rows.join(best, F.col("_url") == F.col("_bu"), "left")
    return out.select(*[F.col(f"row.`{c}`") for c in pages.columns if c not in new], "host", "path", F.col("_rule").alias("rule"), F.coalesce("_v", F.lit(default)).alias("verdict"))


#: The contract's rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

ORACLE = r"""
with u as (select page_id, case when url like '%://%' then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
  case when url like '%://%' then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from pages),
r as (select * from (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) as r(h, p, v)),
m as (select u.*, r.h || r.p as rule, v, length(r.h || r.p) as n from u left join r on (u.host = r.h or u.host like '%.' || r.h) and starts_with(u.path, r.p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m
qualify row_number() over (partition by page_id order by n desc nulls last, rule) = 1
"""
