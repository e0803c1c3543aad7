"""Rows that keep their own columns whatever an operator adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carried(df: DataFrame) -> Column:
    """The row's own columns as one struct, so that no name of ours meets one of theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def restored(df: DataFrame, like: DataFrame, row: str, **added: Column) -> DataFrame:
    """The columns of ``like`` out of the struct ``row``, and the added ones; a column of the same name is replaced."""
    own = [F.col(f"{row}.`{c}`").alias(c) for c in like.columns if c not in added]
    return df.select(*own, *[v.alias(k) for k, v in added.items()])
