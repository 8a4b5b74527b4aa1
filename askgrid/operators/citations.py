"""Cited sources as a Markdown block of links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed


def first_urls(url_table: DataFrame) -> DataFrame:
    """One row per file name: the URL of its first row by `row_no`."""
    return url_table.groupBy("file_name").agg(F.min_by("file_url", "row_no").alias("file_url"))


def format_sources(answers: DataFrame, url_table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per answer (`key`, unique) the Markdown block of its `source_names`, null if there are none.

    Repeated names count once, where they first occur. A name in the URL table becomes a link.
    Names meet URLs in one equi-join, so a name that most answers cite can be split by the
    adaptive skew join; the URL side has one row per name. What is collected per answer is no
    more than the array its row held before.
    """
    names = answers.select(*key, F.posexplode(F.array_distinct("source_names")).alias("pos", "file_name"))
    urls = first_urls(url_table).select("file_name", "file_url", F.lit(True).alias("known"))
    link = F.when(
        F.col("known"),
        F.concat(F.lit("["), "file_name", F.lit("]("), F.coalesce("file_url", F.lit("nan")), F.lit(")")),
    ).otherwise(F.col("file_name"))
    present = F.struct("pos", link.alias("link"))
    links = F.transform(F.col("_links"), lambda x: x["link"])
    others = F.transform(F.slice(links, 2, F.greatest(F.size(links), F.lit(1))), lambda x: F.concat(F.lit("- "), x))
    block = F.concat(
        F.lit(fixed.FIRST_SOURCE_HEADING),
        F.get(links, F.lit(0)),
        F.when(F.size(links) > 1, F.concat(F.lit(fixed.OTHER_SOURCES_HEADING), F.array_join(others, "\n"))).otherwise(
            F.lit("")
        ),
    )
    # Only names meet URLs: answers without a source, and null names, would all have one key.
    linked = names.filter(F.col("file_name").isNotNull()).join(urls, "file_name", "left")
    linked = linked.select(*key, present.alias("present"))
    unnamed = names.filter(F.col("file_name").isNull()).select(
        *key, F.struct("pos", F.lit(None).cast("string").alias("link")).alias("present")
    )
    every = answers.select(*key, F.lit(None).cast("struct<pos: int, link: string>").alias("present"))
    return (
        every.union(unnamed).union(linked)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list("present")).alias("_links"))
        .select(*key, F.when(F.size("_links") > 0, block).alias("sources"))
    )
