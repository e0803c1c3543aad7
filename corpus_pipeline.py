"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of ``documents``. Rejected documents go, repeated lines go (with the documents of which nothing is left), one document of
each group of near copies stays, documents are repeated as their sources' targets ask, and the rest is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abyssal.llm import byte_bpe, jaccard_join, line_dedup, mixing, quality
from abyssal.llm.common import carried, discard, materialise, read
from abyssal.llm.registry import RANKS

THRESHOLD = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts are scored like others; rows that repeat are judged alike."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(carried(docs).alias("row"), "text")
    return quality.score(rows, model, keep=["row"]).where(F.col("score") >= THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated three-line windows, n_chars to match; a document that is emptied by this goes.

    A null or empty text stays as it is, and so does a document none of whose windows occurred before.
    """
    rows = docs.select(carried(docs).alias("row"), "doc_id", "text")
    done = line_dedup.dedup(rows).where("n_removed = 0 or n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("row.n_chars")).cast("long")
    new = {"text": F.col("text"), "n_chars": n_chars}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row of least (doc_id, text hash), null ids last; texts without words stay."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; texts without words weigh nothing and are taken with complete epochs."""
    return mixing.repeat(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, and the ids and their byte offsets (and the end) packed as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Rows that the mix repeats are encoded as often.
    """
    keyed = docs.select(F.struct("doc_id", "lang", "source").alias("k"), "text")
    ids = byte_bpe.encode(keyed, public_tokenizers.path(RANKS), id_col="k", with_offsets=True)
    return ids.select("k.*", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", "offsets")


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The classifier and the join are not SQL. A test compares all stages with a plain version, row for row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
