"""Listing responses of a document service, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed

RESPONSE_SCHEMA = (
    "status INT, `status text` STRING, querydata STRUCT<columns: ARRAY<STRING>, data: ARRAY<ARRAY<STRING>>>"
)


def _parsed(responses: DataFrame, column: str) -> DataFrame:
    return responses.withColumn("_r", F.from_json(F.col(column), RESPONSE_SCHEMA))


def _accepted() -> Column:
    return F.coalesce(F.col("_r.status") == fixed.ACCEPTED_STATUS, F.lit(False))


def _complete() -> Column:
    """The response names all the columns that are needed."""
    wanted = F.array(*map(F.lit, fixed.LISTING_FIELDS))
    found = F.array_intersect(F.col("_r.querydata.columns"), wanted)
    return F.coalesce(F.size(found) == len(fixed.LISTING_FIELDS), F.lit(False))


def _field(name: str) -> Column:
    """A row's value under a column name; if the name is there twice the last one counts."""
    columns = F.col("_r.querydata.columns")
    place = F.size(columns) - F.array_position(F.reverse(columns), F.lit(name)).cast("int")
    return F.when(F.array_contains(columns, F.lit(name)), F.get(F.col("_row"), place))


def parse_listing(
    responses: DataFrame, column: str = "response", strict: bool = True, max_rows: int | None = None
) -> DataFrame:
    """Rows `name, url, modification_date` of the accepted responses; values are found by name.

    Strict: a response with another status, or without one of the three columns, fails the
    job. Lenient: it is left out here and shown by `rejected_responses`. `max_rows` is the
    service's cap per listing (`fixed_values.LISTING_MAX_ROWS`); there is none by default.
    """
    parsed = _parsed(responses, column)
    if strict:
        status = F.coalesce(F.col("_r.status").cast("string"), F.lit("None"))
        reason = F.coalesce(F.col("_r.`status text`"), F.lit("None"))
        denied = F.raise_error(F.concat(F.lit("API returned status: "), status, F.lit(" - "), reason))
        missing = F.raise_error(F.lit(f"the listing lacks one of the columns {fixed.LISTING_FIELDS}"))
        usable = (
            F.when(~_accepted(), denied.cast("boolean"))
            .when(~_complete(), missing.cast("boolean"))
            .otherwise(F.lit(True))
        )
    else:
        usable = _accepted() & _complete()
    name, url, date = (_field(f) for f in fixed.LISTING_FIELDS)
    rows = (
        parsed.filter(usable)
        .withColumn("_row", F.explode(F.col("_r.querydata.data")))
        .select(name.alias("name"), url.alias("url"), date.alias("modification_date"))
    )
    return rows if max_rows is None else rows.limit(max_rows)


def rejected_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """The responses that a lenient parse leaves out, with their `status`, `status_text` and
    `reason`: another status than accepted (or no status at all), or a column missing.
    """
    return (
        _parsed(responses, column)
        .filter(~(_accepted() & _complete()))
        .withColumns(
            {
                "status": F.col("_r.status"),
                "status_text": F.col("_r.`status text`"),
                "reason": F.when(_accepted(), "columns").otherwise("status"),
            }
        )
        .drop("_r")
    )
