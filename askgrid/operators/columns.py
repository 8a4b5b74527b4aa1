"""Operators on a table's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed


def _filled(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Those of the columns that have a value in some row."""
    row = df.agg(*(F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in columns)).first()
    return {c for c in columns if row[c]}


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Leave out the columns that are null in every row, which one pass over all of them tells."""
    filled = _filled(df, df.columns)
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in filled))


def move_last(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Put the given columns at the far right, in the given order."""
    return df.select(*(c for c in df.columns if c not in columns), *columns)


def has_index_fields(
    df: DataFrame,
    vector: str = fixed.INDEX_VECTOR_FIELD,
    content: str = fixed.INDEX_CONTENT_FIELD,
) -> bool:
    """Whether a chunk table has both the vector and the content field."""
    return {vector, content} <= set(df.columns)


def require_index_fields(
    df: DataFrame,
    vector: str = fixed.INDEX_VECTOR_FIELD,
    content: str = fixed.INDEX_CONTENT_FIELD,
) -> DataFrame:
    if not has_index_fields(df, vector, content):
        raise ValueError(f"the chunk table needs the fields {vector!r} and {content!r}; it has {df.columns}")
    return df


def index_field_report(
    df: DataFrame,
    vector: str = fixed.INDEX_VECTOR_FIELD,
    content: str = fixed.INDEX_CONTENT_FIELD,
) -> DataFrame:
    """One row: which fields are there, and in how many rows both are filled."""
    present = set(df.columns)
    filled = F.lit(False)
    if has_index_fields(df, vector, content):
        filled = F.col(vector).isNotNull() & F.col(content).isNotNull()
    return df.agg(
        F.lit(vector in present).alias("has_vector"),
        F.lit(content in present).alias("has_content"),
        F.lit(has_index_fields(df, vector, content)).alias("compatible"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(filled).alias("filled_rows"),
    )
