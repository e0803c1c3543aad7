"""Operator 8: line dedup over overlapping three-line windows. DataFrame functions only.

Every three consecutive lines of a text are hashed (128 bits). A window that occurs more than once has a first
occurrence, the least (doc_id, text hash, position); each later occurrence covers its three lines, covered positions
merge, and covered lines are removed. Windows of three blank lines do not count.

Only hashes and positions are grouped and joined; texts move once, in the join with the covered positions, whose key
is a document. Counting a window pre-aggregates, so a window that a third of all documents share is no hot group, and
the join that finds later occurrences has one row per window on its other side, so Spark may split its large partitions.

Defined results: a null text stays null with 0 lines; an empty text is one empty line; texts under three lines have no
window and stay; null doc_ids come last and are told apart by their texts; rows that repeat both doc_id and text are one
document and get one result; other columns pass through, and columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abyssal.llm.common import carried

_LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_o, _t, _p, _a, _b): document key, position, and the 128-bit hash of each window."""
    lines = _lines(F.col(text_col))
    keyed = docs.select(_key(id_col).alias("_o"), F.xxhash64(text_col).alias("_t"), lines.alias("_l")).where(F.size("_l") >= 3)
    w = F.transform(
        F.sequence(F.lit(0), F.size("_l") - 3),
        lambda i: F.struct(
            i.alias("p"),
            F.xxhash64(F.col("_l")[i], F.col("_l")[i + 1], F.col("_l")[i + 2]).alias("a"),
            F.xxhash64(F.lit(3), F.col("_l")[i], F.col("_l")[i + 1], F.col("_l")[i + 2]).alias("b"),
            (F.length(F.trim(F.concat(F.col("_l")[i], F.col("_l")[i + 1], F.col("_l")[i + 2]))) > 0).alias("ok"),
        ),
    )
    return keyed.select("_o", "_t", F.explode(w).alias("w")).where("w.ok").select("_o", "_t", F.col("w.p").alias("_p"), F.col("w.a").alias("_a"), F.col("w.b").alias("_b"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """docs with ``text_col`` without its repeated lines, its number of lines before, and the number removed."""
    names = [c for c in docs.columns if c not in (lines_col, removed_col)]
    found = windows(docs, id_col, text_col)
    first = found.groupBy("_a", "_b").agg(F.min(F.struct("_o", "_t", "_p")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_a", "_b", "_first")
    later = found.join(first, ["_a", "_b"]).where(F.struct("_o", "_t", "_p") != F.col("_first"))
    covered = later.groupBy("_o", "_t").agg(F.collect_set("_p").alias("_w"))
    covered = covered.select(F.col("_o").alias("_co"), F.col("_t").alias("_ct"), F.flatten(F.transform("_w", lambda p: F.array(p, p + 1, p + 2))).alias("_cov"))
    keyed = docs.select(carried(docs).alias("row"), F.col(text_col).alias("_text"), _key(id_col).alias("_o"), F.xxhash64(text_col).alias("_t"))
    joined = keyed.join(covered, (F.col("_o") == F.col("_co")) & (F.col("_t") == F.col("_ct")), "left")
    lines, hit = _lines(F.col("_text")), F.col("_cov").isNotNull()
    total = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_cov"))
    joined = joined.select("row", "_text", total.alias("_n"), F.when(hit, kept).alias("_kept"), F.when(hit, lines).alias("_l"))
    removed = F.when(F.col("_kept").isNotNull(), F.col("_n") - F.size("_kept")).otherwise(0)
    text = F.when(F.col("_kept").isNotNull(), F.array_join(F.transform("_kept", lambda i: F.col("_l")[i]), "\n")).otherwise(F.col("_text"))
    own = [text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names]
    return joined.select(*own, F.col("_n").alias(lines_col), removed.alias(removed_col))


#: The same in DuckDB: text as the window key.
ORACLE = r"""
with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
w as (select doc_id, ls, unnest(range(1, len(ls) - 1)) as p from l where len(ls) >= 3),
k as (select doc_id, p, ls[p] || chr(10) || ls[p+1] || chr(10) || ls[p+2] as key from w where length(trim(ls[p] || ls[p+1] || ls[p+2])) > 0),
r as (select doc_id, p, row_number() over (partition by key order by doc_id, p) as rn from k),
c as (select doc_id, list(distinct q) as cov from (select doc_id, unnest([p, p+1, p+2]) as q from r where rn > 1) group by doc_id),
u as (select l.doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i, cov from l left join c using (doc_id)),
kept as (select doc_id, string_agg(line, chr(10) order by i) as text, count(*) as n from u where cov is null or not list_contains(cov, i) group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(kept.text, '') end as text,
  cast(coalesce(len(l.ls), 0) as int) as n_lines, cast(coalesce(len(l.ls), 0) - coalesce(kept.n, 0) as int) as n_removed
from documents d left join l using (doc_id) left join kept using (doc_id)
"""
