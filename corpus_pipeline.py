"""The corpus pipeline: documents in, token ids out, through five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's `docs`. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askgrid.llm import byte_bpe, decontamination, jaccard, quality, substrings
from askgrid.session import materialise

#: SQL has no compressor and no tokenizer, so the pipeline is tested against brute force instead.
ORACLE_SQL = None

#: Near duplicates: words in a shingle, least similarity in percent.
SHINGLE, SIMILARITY = 5, 80


def _free(name: str, docs: DataFrame) -> str:
    """A column name that `docs` doesn't have."""
    name = f"_{name}"
    while name in docs.columns:
        name = f"_{name}"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts, as they are.

    Null and empty texts have a score like all others. Rows without an id are scored, too. Empty table:
    empty result.
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free("quality", docs)
    return quality.score_quality(docs, model, to=score).where(F.col(score) >= 0.5).drop(score)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id.

    Rows are told apart by id and text, so a row goes only if its own text is linked to a row that stays,
    whatever other rows have its id. Rows without an id come last; among equal ids the least digest stays,
    and of rows equal in id and text one.
    """
    own = [_free("id", docs), _free("digest", docs)]
    keyed = docs.withColumns(dict(zip(own, jaccard.row_key().values(), strict=True)))
    near = _free("near_copy", docs)
    copies = jaccard.copies(docs, words=SHINGLE, share=SIMILARITY)
    copies = copies.withColumnsRenamed(dict(zip(["id", "digest", "near_copy"], [*own, near], strict=True)))
    # A merge join at every size, since what goes grows with the documents; texts are shuffled once, for both cases.
    judged = keyed.join(materialise(copies, "copies").hint("merge"), own, "left")
    judged = judged.where(F.col(near).isNull() | ~F.col(near))
    number = F.row_number().over(Window.partitionBy(*own).orderBy(*docs.columns))
    first = F.when(F.col(near).isNull(), F.lit(1)).otherwise(number)
    place = _free("place", docs)
    return judged.withColumn(place, first).where(F.col(place) == 1).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus.

    A text that loses nothing stays as it is; one that loses words keeps the others, joined by blanks;
    one that loses all goes. n_chars is that of the new text.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.select("doc_id", "text", F.struct("doc_id", *others).alias("others"))
    cut = substrings.remove_repeats(carried, keep_text=True)
    cut = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    lost = F.col("n_removed") > 0
    new = {
        "doc_id": F.col("doc_id"),
        "text": F.when(lost, F.col("kept")).otherwise(F.col("text")),
        **{c: F.col("others")[c] for c in others},
    }
    if "n_chars" in others:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(lost, F.length("kept").cast(kind)).otherwise(new["n_chars"])
    return cut.select(*[new[c].alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark in them.

    Texts are told apart by their digest, so rows without an id are judged like all others.
    """
    digest = _free("digest", docs)
    keyed = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    leaks = decontamination.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=digest)
    leaks = materialise(leaks.select(digest).distinct(), "leaks")
    return keyed.join(leaks, digest, "left_anti").select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether the ids decode to the text again.

    Null and empty texts have no ids and count as decoded. Null ids stay null, repeated rows each give a
    row. Empty table: empty result.
    """
    decoded = byte_bpe.there_and_back(docs.select("doc_id", "text"), byte_bpe.public_vocabulary())
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`. Null values are treated as each stage says; an empty table
    gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage_{number}")
    return docs
