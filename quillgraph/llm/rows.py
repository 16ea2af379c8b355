"""Whole rows as one private column, so that no name of an operator's own columns can clash with theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "boxed"


def boxed(docs: DataFrame, **own: Column) -> DataFrame:
    """The rows of docs as a struct, BOX, beside the named columns only."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(BOX), *[c.alias(name) for name, c in own.items()])


def unboxed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The boxed rows again; changed columns from what stands beside the box."""
    return rows.select(*[(changed[c] if c in changed else F.col(BOX).getField(c)).alias(c) for c in columns])
