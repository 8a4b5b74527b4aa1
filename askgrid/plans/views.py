"""Inputs of the registered queries, derived by Spark from the given tables.

Each view keeps every row of its table. The numbers in them only decide which of several shapes
a row takes (a slash in a name, a missing answer, a tool message); none leaves rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.session import spread, work_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def evaluation_results(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as scored answers of two models; one without a label is neither clear nor unclear."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, folder, "labels")
    doc = F.col("doc_id")
    retrieved = doc % 4 != 0
    return documents.join(labels, "doc_id", "left").select(
        doc.alias("row_id"),
        F.when(doc % 2 == 0, "model_a").otherwise("model_b").alias("model"),
        F.concat(F.lit(" "), F.col("lang"), F.lit(" ")).alias("document_type"),
        F.when(F.col("quality") == 1, "Positive").otherwise("Negative").alias("question_type"),
        F.when(F.col("toxic") == 0, "Yes").when(F.col("toxic") == 1, "No").alias("unambiguous"),
        (1 + F.col("n_chars") % 10).cast("int").alias("correctness"),
        F.when(retrieved, 1 + doc % 10).otherwise(0).cast("int").alias("retrieval"),
        F.when(retrieved, 1 + doc % 7).otherwise(0).cast("int").alias("groundedness"),
        (retrieved & (doc % 3 != 0)).alias("document_match"),
    )


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, one file or a folder of files, as a stream of its files."""
    # A stream takes a single file only by a pattern.
    pattern = f"{folder}/{name}.parque[t]"
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(pattern)


def arriving(spark: SparkSession, folder: str, name: str, order: str, steps: int = 4) -> DataFrame:
    """A given table as a stream that arrives in `steps` files, by ranges of a numeric column, one to a micro-batch."""
    rows = table(spark, folder, name)
    path = f"{work_folder(spark)}/{name}"
    least, most = rows.agg(F.min(order), F.max(order)).first()
    width = ((most or 0) - (least or 0)) // steps + 1
    for step in range(steps):
        part = rows.filter(F.coalesce(F.floor((F.col(order) - (least or 0)) / width), F.lit(0)) == step)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a listed file: unnamed, excluded, slashed and plain names."""
    return listing_of(table(spark, folder, "documents"))


def listing_of(documents: DataFrame) -> DataFrame:
    doc, number = F.col("doc_id"), _text("doc_id")
    name = (
        F.when(doc % 17 == 0, F.lit(None).cast("string"))
        .when(doc % 7 == 0, F.concat(F.lit("CCS "), number))
        .when(doc % 11 == 0, F.concat(F.lit("Market Strategy "), number))
        .when(doc % 13 == 0, F.concat(F.col("source"), F.lit(" Market Summary "), number))
        .when(doc % 10 == 0, F.concat(F.lit("Fact/Sheet "), number))
        .otherwise(F.concat(F.lit("Fact Sheet "), number))
    )
    suffix = F.when(doc % 5 == 0, ".docx").when(doc % 9 == 0, "").otherwise(".pdf")
    return documents.select(
        "doc_id",
        name.alias("name"),
        F.concat(F.lit("/files/v1.2/"), number, suffix).alias("url"),
        F.concat(F.lit("n"), _text("n_chars")).alias("modification_date"),
    )


def listing_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Every listed file inside a service response; column order and status vary."""
    doc = F.col("doc_id")
    name, url, date = F.col("name"), F.col("url"), F.col("modification_date")

    def strings(*values: str) -> Column:
        return F.array(*(F.lit(v) for v in values))

    swapped = doc % 2 == 0
    columns = F.when(swapped, strings("modifydate", "getfileurl", "name", "size")).otherwise(
        strings("name", "getfileurl", "modifydate")
    )
    row = F.when(swapped, F.array(date, url, name, F.lit("1"))).otherwise(F.array(name, url, date))
    return listing(spark, folder).select(
        "doc_id",
        F.to_json(
            F.struct(
                F.when(doc % 19 == 0, 401).otherwise(9001).alias("status"),
                F.when(doc % 19 == 0, "denied").alias("status text"),
                F.struct(columns.alias("columns"), F.array(row).alias("data")).alias("querydata"),
            )
        ).alias("response"),
    )


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """One stored file per document, a part of them under listed names."""
    doc = F.col("doc_id")
    return table(spark, folder, "documents").select(
        F.concat(
            F.when(doc % 3 == 0, "Fact Sheet ").otherwise("Archive "),
            _text("doc_id"),
            F.when(doc % 8 == 1, ".docx").otherwise(".pdf"),
        ).alias("file_name")
    )


def url_table(spark: SparkSession, folder: str) -> DataFrame:
    """A URL per document, so many rows per file name; the lowest `row_no` is the first."""
    return table(spark, folder, "documents").select(
        F.concat(F.col("source"), F.lit(".pdf")).alias("file_name"),
        F.concat(F.lit("https://docs.example/"), _text("doc_id")).alias("file_url"),
        F.col("doc_id").alias("row_no"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations as messages, a part of the assistant's as tool calls and tool results.

    A tool result's artifact holds one chunk per line of its text, and some hold none.
    """
    return messages_of(table(spark, folder, "conversations"))


def messages_of(conversations: DataFrame) -> DataFrame:
    mix = (F.col("conv_id") + F.col("turn")) % 3
    assistant = F.col("role") == "assistant"
    kind = (
        F.when(F.col("role") == "user", "human")
        .when(F.col("role") == "system", "system")
        .when(mix == 0, "tool")
        .otherwise("ai")
    )
    call = F.array(F.struct(F.lit("retrieve").alias("name"), F.col("text").alias("args")))
    no_call = F.expr("cast(array() as array<struct<name: string, args: string>>)")
    source = lambda i: F.concat(
        F.lit("src"), ((F.col("conv_id") + (i * i) % 7) % 23).cast("string"), F.lit(".pdf")
    )
    chunks = F.transform(
        F.split(F.col("text"), "\n"), lambda line, i: F.struct(source(i).alias("title"), line.alias("page_content"))
    )
    no_chunks = F.expr("cast(array() as array<struct<title: string, page_content: string>>)")
    return conversations.select(
        F.concat(F.lit("session"), (F.col("conv_id") % 4).cast("string")).alias("session_id"),
        F.col("conv_id").cast("string").alias("thread_id"),
        "turn",
        kind.alias("type"),
        F.col("text").alias("content"),
        F.when(assistant & (mix == 1), call).otherwise(no_call).alias("tool_calls"),
        F.when(assistant & (mix == 0) & (F.col("turn") % 4 != 3), chunks).otherwise(no_chunks).alias("artifact"),
    )


def answered_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn with the reply that follows it, if any, scored against the document of that number.

    A turn without a reply has an empty answer.

    Conversations whose document has no label stand for answers given without retrieval.
    """
    conversations = spread(table(spark, folder, "conversations"), "conv_id", "turn")
    asked = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    replied = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("conv_id"), F.col("text").alias("true_answer"), "source", "lang"
    )
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "conv_id")
    pdf, one_page = F.lit(".PDF"), F.lit("One Page ")
    wrong = F.concat(F.lit("not "), F.col("source"), F.lit(".pdf"))
    right = F.concat(one_page, F.col("source"), pdf, F.lit("\n"))
    files = F.when(F.col("quality") == 1, F.array(right, wrong)).when(
        F.col("quality") == 0, F.array(wrong, right)
    )
    return (
        asked.join(replied, ["conv_id", "turn"], "left")
        .join(documents, "conv_id", "left")
        .join(labels, "conv_id", "left")
        .select(
            "conv_id",
            "turn",
            "question",
            F.coalesce("answer", F.lit("")).alias("answer"),
            F.coalesce("true_answer", F.lit("")).alias("true_answer"),
            F.concat(F.lit("\t"), F.coalesce("source", F.lit("none")), F.lit(" ")).alias("file"),
            F.coalesce("lang", F.lit("none")).alias("document_type"),
            F.when(F.col("quality") == 0, "Negative").otherwise("Positive").alias("question_type"),
            F.when(F.col("toxic") == 1, "No").otherwise("Yes").alias("unambiguous"),
            F.coalesce(files, F.expr("cast(array() as array<string>)")).alias("retrieved_files"),
            F.when(F.col("quality").isNotNull(), F.split("true_answer", "\n"))
            .otherwise(F.expr("cast(array() as array<string>)"))
            .alias("retrieved_contents"),
        )
    )


def judge_replies(spark: SparkSession, folder: str) -> DataFrame:
    """A judge's raw reply per document: good scores, scores out of range, decimals and words."""
    number = F.col("n_chars") % 14
    reply = (
        F.when(number == 12, "seven")
        .when(number == 13, "7.0")
        .otherwise(F.concat(F.lit(" "), number.cast("string"), F.lit("\n")))
    )
    return table(spark, folder, "documents").select("doc_id", reply.alias("reply"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


def source_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(F.col("source"), F.lit(".pdf")).alias("title"), "lang", "text"
    )


def truth_set(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark as questions; the document of the same number holds the true answer."""
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("true_answer"), "source", "lang"
    )
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("question"))
    return asked.join(documents, "row_id", "left").select(
        "row_id",
        "question",
        "true_answer",
        F.concat(F.lit(" "), F.col("source"), F.lit("\n")).alias("file"),
        F.col("lang").alias("document_type"),
        F.lit(None).cast("string").alias("blank"),
    )
