"""Which listed documents are new, where they go, and which stored files are no longer listed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.functions.text import target_file_name

_PIECE = 100_000


def exclude_documents(
    listing: DataFrame,
    prefix: str = fixed.EXCLUDED_NAME_PREFIX,
    parts: Sequence[str] = fixed.EXCLUDED_NAME_PARTS,
) -> DataFrame:
    """Leave out documents by name (case-sensitive). A document without a name is kept."""
    unwanted = F.startswith(F.col("name"), F.lit(prefix))
    for part in parts:
        unwanted = unwanted | F.contains(F.col("name"), F.lit(part))
    return listing.filter(~F.coalesce(unwanted, F.lit(False)))


def _wanted_file(match_on: str) -> Column:
    if match_on == "name":
        return F.concat(F.col("name"), F.lit(fixed.STORED_SUFFIX))
    if match_on == "target":
        return target_file_name(F.col("name"), F.col("url"))
    raise ValueError(f"match_on must be 'name' or 'target', not {match_on!r}")


def _not_among(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the others, of which each key is taken once.

    The others are reduced before the shuffle, which then also serves the join.
    """
    return rows.join(others.select(key).distinct(), key, "left_anti")


def new_documents(listing: DataFrame, stored: DataFrame, match_on: str = "name") -> DataFrame:
    """Named listing rows whose file is not stored; repeated names stay repeated.

    `match_on="name"` looks for the name plus `.pdf`, whatever the real type and with slashes
    kept. `match_on="target"` looks for the file name the download plan would write.
    """
    wanted = listing.filter(F.col("name").isNotNull()).withColumn("file_name", _wanted_file(match_on))
    return _not_among(wanted, stored, "file_name").drop("file_name")


def new_document_names(listing: DataFrame, stored: DataFrame, match_on: str = "name") -> DataFrame:
    """The names to fetch, in ascending code-point order; repeated names stay repeated.

    Repeats are counted before anything is shuffled and written out again after the sort, in
    pieces, so a name that most rows share is sorted as a few rows and ends up in several tasks.
    """
    named = listing.filter(F.col("name").isNotNull()).withColumn("file_name", _wanted_file(match_on))
    counted = named.groupBy("file_name", "name").agg(F.count(F.lit(1)).alias("n"))
    last_piece = F.floor((F.col("n") - 1) / _PIECE)
    return (
        _not_among(counted, stored, "file_name")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last_piece)))
        .orderBy("name", "piece")
        .withColumn("copies", F.least(F.col("n") - F.col("piece") * _PIECE, F.lit(_PIECE)))
        .select("name", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
        .select("name")
    )


def download_plan(
    listing: DataFrame, stored: DataFrame, folder: str = fixed.STORED_FOLDER, match_on: str = "name"
) -> DataFrame:
    """Each new document with its source URL and target path.

    The rows of the listing whose name is new are the rows of the anti join itself, so the
    listing is not joined a second time with the names.
    """
    return new_documents(listing, stored, match_on).withColumn(
        "target", F.concat(F.lit(f"{folder}/"), target_file_name(F.col("name"), F.col("url")))
    )


def orphaned_files(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files that no listed document accounts for. A plan only: nothing is deleted."""
    listed = listing.select(F.concat(F.col("name"), F.lit(fixed.STORED_SUFFIX)).alias("file_name"))
    return _not_among(stored, listed, "file_name")
