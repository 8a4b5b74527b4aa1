"""Files read and written: stored files, URL table, truth set, prompts, results, summaries."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions import fixed_values as fixed
from askgrid.operators.columns import require_index_fields

URL_TABLE_SCHEMA = ", ".join(f"`{c}` STRING" for c in fixed.URL_TABLE_COLUMNS)
TRUTH_SET_SCHEMA = (
    "Question STRING, `True Answer` STRING, File STRING, `Question Type` STRING, `Document Type` STRING, "
    "Unambiguous STRING"
)
RESULTS_SCHEMA = (
    f"{TRUTH_SET_SCHEMA}, Answer STRING, Correctness INT, Retrieval INT, Groundedness INT, "
    "`Document Match` BOOLEAN, `Retrieved Files` STRING, `Retrieved Contents` STRING"
)
_STRING_LIST = "array<string>"


def _listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Path of every file directly in the folders. The files' content is not read.

    Readers leave out names that start with a dot or an underscore; those few are listed apart.
    """
    hidden = []
    for folder in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/[._]*")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        hidden += [(s.getPath().toString(),) for s in system.globStatus(path) or [] if s.isFile()]
    listed = spark.read.format("binaryFile").load(list(paths)).select("path")
    return listed.union(spark.createDataFrame(hidden, "path STRING")) if hidden else listed


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the files in a folder, local or in an object store.

    A path that is missing or no folder gives no rows. Files in subfolders are not listed.
    """
    try:
        paths = _listed(spark, [folder])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file_name STRING")
    segments = F.split("path", "/")
    parent = F.array_join(F.slice(segments, 1, F.size(segments) - 1), "/")
    # Given a file, Spark lists the file itself.
    given = F.lit(folder.removeprefix("./").rstrip("/"))
    inside = F.endswith(parent, given) | ~F.endswith(F.col("path"), given)
    return paths.filter(inside).select(F.element_at(segments, -1).alias("file_name"))


def build_url_table(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Folder name, folder id, file name and URL of every file directly in the folders."""
    segments = F.split("path", "/")
    folder_id = F.array_join(F.slice(segments, 1, F.size(segments) - 1), "/")
    values = (F.element_at(segments, -2), folder_id, F.element_at(segments, -1), F.col("path"))
    table = _listed(spark, folders)
    return table.select(*(v.alias(c) for v, c in zip(values, fixed.URL_TABLE_COLUMNS)))


def write_url_table(table: DataFrame, path: str) -> None:
    """Write the table as CSV in place of what the path held before."""
    table.write.mode("overwrite").option("header", True).csv(path)


def read_url_table(spark: SparkSession, path: str) -> DataFrame:
    """File names and URLs, with `row_no` giving the order of the rows in the files."""
    table = _read_csv(spark, path, URL_TABLE_SCHEMA, multi_line=False)
    row_no = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return table.select(
        F.col("File Name").alias("file_name"), F.col("File URL").alias("file_url"), row_no.alias("row_no")
    )


def plain_names(df: DataFrame) -> DataFrame:
    """File headings as the column names used here: `True Answer` becomes `true_answer`."""
    return df.toDF(*(c.strip().lower().replace(" ", "_") for c in df.columns))


def with_headings(df: DataFrame) -> DataFrame:
    """Column names as file headings: `true_answer` becomes `True Answer`."""
    return df.toDF(*(c.replace("_", " ").title() for c in df.columns))


def prepare_truth_set(df: DataFrame) -> DataFrame:
    """A truth set as read, with plain names and a `row_id` in place of the rows' order."""
    return plain_names(df).withColumn("row_id", F.monotonically_increasing_id())


def write_chunk_table(chunks: DataFrame, path: str) -> None:
    """Keep chunks with their vectors as Parquet, one column per field, for later searches.

    Each task's chunks lie by document, so a row group holds few titles, and has a Bloom filter of its titles
    and ids: a search in some documents, or a fetch of some chunks, skips the others. Nothing is shuffled.
    """
    require_index_fields(chunks, fixed.CHUNK_VECTOR_FIELD, fixed.CHUNK_CONTENT_FIELD)
    layout = [c for c in ("title", "doc_id", "chunk_no") if c in chunks.columns]
    writer = chunks.sortWithinPartitions(*layout).write if layout else chunks.write
    for column in ("title", "chunk_id"):
        if column in chunks.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.mode("errorifexists").parquet(path)


def read_chunk_table(
    spark: SparkSession,
    path: str,
    vector: str = fixed.CHUNK_VECTOR_FIELD,
    content: str = fixed.CHUNK_CONTENT_FIELD,
) -> DataFrame:
    """The chunk table; fails if it lacks the vector or the content field."""
    return require_index_fields(spark.read.parquet(path), vector, content)


def read_truth_set(spark: SparkSession, path: str, schema: str = TRUTH_SET_SCHEMA) -> DataFrame:
    """The truth set from CSV (cells may hold line breaks) or, by its suffix, from Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return _read_csv(spark, path, schema)


def excel_sheet(content: bytes, sheet: str) -> pd.DataFrame:
    """One sheet of a workbook, all cells as text. Needs a package that pandas reads Excel with."""
    try:
        return pd.read_excel(io.BytesIO(content), sheet_name=sheet, dtype=str)
    except ImportError as error:
        raise ImportError("reading workbooks needs openpyxl; save the sheet as CSV instead") from error


def read_truth_workbook(
    spark: SparkSession,
    path: str,
    sheet: str = fixed.TRUTH_SHEET,
    schema: str = TRUTH_SET_SCHEMA,
    reader: Callable[[bytes, str], pd.DataFrame] = excel_sheet,
) -> DataFrame:
    """The truth set from a sheet of each workbook at the path, with columns found by name.

    A workbook is read in a task, not on the driver; the format holds at most 1,048,576 rows.
    Columns of the schema that a sheet lacks are null.
    """
    names = T.StructType.fromDDL(schema).names

    def sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = reader(bytes(content), sheet).reindex(columns=names)
                yield rows.astype(object).where(rows.notna(), None)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(sheets, schema)


def _read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, whose columns are found by name, in any order.

    Columns of the schema get its types, and are null if the file lacks them. Further columns of
    the file stay as text.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    rows = reader.csv(path)
    typed = {}
    for field in T.StructType.fromDDL(schema).fields:
        value = F.col(f"`{field.name}`") if field.name in rows.columns else F.lit(None)
        if isinstance(field.dataType, T.IntegerType):
            value = value.cast("double")  # whole numbers may be written as 7.0
        typed[field.name] = value.cast(field.dataType)
    return rows.withColumns(typed)


def write_results(results: DataFrame, path: str) -> None:
    """Write results as Parquet. An existing table is not overwritten."""
    results.write.mode("errorifexists").parquet(path)


def export_results(results: DataFrame, path: str) -> None:
    """Write results as CSV with header; arrays, which CSV cannot hold, become JSON texts."""
    columns = [
        F.to_json(c).alias(c) if kind.startswith("array") else F.col(f"`{c}`") for c, kind in results.dtypes
    ]
    writer = results.select(*columns).write.mode("errorifexists").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_results(
    spark: SparkSession, path: str, schema: str = RESULTS_SCHEMA, arrays: Sequence[str] = ("Retrieved Files", "Retrieved Contents")
) -> DataFrame:
    """Results exported by `export_results`, with the JSON texts as arrays again."""
    rows = _read_csv(spark, path, schema)
    return rows.withColumns({a: F.from_json(F.col(f"`{a}`"), _STRING_LIST) for a in arrays if a in rows.columns})


def write_summary(summary: DataFrame, path: str, key: Sequence[str]) -> None:
    """Write a summary (one row per group) as one CSV file, sorted, with the group key first."""
    rest = [c for c in summary.columns if c not in key]
    ordered = summary.select(*key, *rest).coalesce(1).sortWithinPartitions(*key)
    ordered.write.mode("overwrite").option("header", True).csv(path)


def read_prompts(spark: SparkSession, folder: str) -> dict[str, str]:
    """Prompt templates by file name without suffix. A handful of small files, read whole."""
    rows = spark.read.text(folder, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value"
    )
    return {r["file"].rsplit(".", 1)[0]: r["value"] for r in rows.collect()}
