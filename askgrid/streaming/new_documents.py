"""Pick up documents that are listed but not stored, as listings arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from askgrid.operators.docsync import download_plan, exclude_documents
from askgrid.session import work_folder


def write_plans(
    listing: DataFrame, stored: Callable[[], DataFrame], path: str, match_on: str = "name"
) -> StreamingQuery:
    """For each arriving part of the listing, write the plan of the documents not stored by then.

    `stored` reads the stored names anew each time. A repeated step replaces its own folder.
    """

    def plan(part: DataFrame, number: int) -> None:
        planned = download_plan(exclude_documents(part), stored(), match_on=match_on)
        planned.write.mode("overwrite").parquet(f"{path}/plans/step={number}")

    return (
        listing.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(plan)
        .trigger(availableNow=True)
        .start()
    )


def run_to_end(listing: DataFrame, stored: Callable[[], DataFrame], match_on: str = "name") -> DataFrame:
    """Process a listing stream's present rows and return the plans, with their `step`."""
    spark = listing.sparkSession
    path = work_folder(spark)
    query = write_plans(listing, stored, path, match_on)
    query.awaitTermination()
    return spark.read.parquet(f"{path}/plans")
