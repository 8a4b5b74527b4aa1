"""Summaries of evaluation results by document type, question type and model.

Inputs carry `document_type, question_type, unambiguous, correctness, retrieval,
groundedness, document_match`, and `model` where models are compared. Every summary is a
partial-then-final hash aggregation, so a group that holds most rows costs one partial row per
task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.functions.text import round_half_even, strip

MEASURES = ("correctness", "retrieval", "groundedness")


def usable_results(results: DataFrame) -> DataFrame:
    """Strip the two type columns and keep unambiguous questions (exact, unstripped)."""
    return results.filter(F.col("unambiguous") == fixed.UNAMBIGUOUS).withColumns(
        {"document_type": strip(F.col("document_type")), "question_type": strip(F.col("question_type"))}
    )


def tag_model(results: DataFrame, model: str) -> DataFrame:
    return results.withColumn("model", F.lit(model))


def combine_models(tagged: Mapping[str, DataFrame]) -> DataFrame:
    """Stack the results of several models by column name; a column missing in one run is null."""
    frames = [tag_model(df, model) for model, df in tagged.items()]
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    return combined


def scores_by_document_type(results: DataFrame, question_type: str) -> DataFrame:
    """Mean of the three scores by document type for one kind of control, to 2 decimals."""
    return (
        usable_results(results)
        .filter((F.col("question_type") == question_type) & F.col("document_type").isNotNull())
        .groupBy("document_type")
        .agg(*(round_half_even(F.avg(m)).alias(m) for m in MEASURES))
    )


def match_categories(match: Column) -> tuple[Column, Column]:
    """A boolean as its category name and that category's place in the order."""
    true_name, false_name = fixed.MATCH_CATEGORIES
    name = F.when(match, true_name).when(~match, false_name)
    return name, F.when(match, 0).when(~match, 1)


def place_in(value: Column, order: Sequence[str]) -> Column:
    """1-based place of a value in a fixed order; 0 if it is not in it."""
    return F.array_position(F.array(*(F.lit(o) for o in order)), value).cast("int")


def percentage_match(
    results: DataFrame,
    document_types: Sequence[str] = fixed.DOCUMENT_TYPES,
    question_types: Sequence[str] = fixed.QUESTION_TYPES,
) -> DataFrame:
    """Share of rows with the right document by model, question type and document type, in %."""
    share = round_half_even(F.avg(F.col("document_match").cast("int")) * 100)
    return (
        usable_results(results)
        .filter(F.col("model").isNotNull())
        .filter(F.col("document_type").isin(*document_types) & F.col("question_type").isin(*question_types))
        .groupBy("model", "question_type", "document_type")
        .agg(share.alias("document_match"))
        .withColumnRenamed("document_match", "percentage_match")
        .withColumns(
            {
                "label": F.when(
                    F.col("percentage_match") > 0, F.format_string("%.1f%%", F.col("percentage_match"))
                ),
                "document_type_order": place_in(F.col("document_type"), document_types),
                "question_type_order": place_in(F.col("question_type"), question_types),
            }
        )
    )


def response_counts(results: DataFrame, models: Mapping[str, str]) -> DataFrame:
    """Number of responses: all, one count per model (output name -> model) and per control."""
    per_model = [F.count_if(F.col("model") == tag).alias(name) for name, tag in models.items()]
    per_type = [F.count_if(F.col("question_type") == t).alias(t.lower()) for t in fixed.QUESTION_TYPES]
    return usable_results(results).agg(F.count(F.lit(1)).alias("total"), *per_model, *per_type)


def _mean_with_error(value: str) -> list[Column]:
    n = F.count(value)
    # Below two values Spark gives NULL for the deviation, and so for the error.
    return [
        F.avg(value).alias(f"mean_{value}"),
        (F.stddev_samp(value) / F.sqrt(n)).alias("standard_error"),
        n.alias("n"),
    ]


def correctness_by_model(results: DataFrame) -> DataFrame:
    return (
        usable_results(results)
        .filter(F.col("model").isNotNull())
        .groupBy("model")
        .agg(*_mean_with_error("correctness"))
    )


def correctness_by_facet(
    results: DataFrame,
    document_types: Sequence[str] = fixed.DOCUMENT_TYPES,
    question_types: Sequence[str] = fixed.QUESTION_TYPES,
) -> DataFrame:
    """Mean and standard error by question type, document type and model, in the given orders."""
    return (
        usable_results(results)
        .filter(F.col("model").isNotNull())
        .filter(F.col("document_type").isin(*document_types) & F.col("question_type").isin(*question_types))
        .groupBy("question_type", "document_type", "model")
        .agg(*_mean_with_error("correctness"))
        .withColumns(
            {
                "document_type_order": place_in(F.col("document_type"), document_types),
                "question_type_order": place_in(F.col("question_type"), question_types),
            }
        )
    )


def _in_facets(results: DataFrame, facets: Mapping[str, Sequence[str]]) -> DataFrame:
    wanted = F.lit(False)
    for question_type, document_types in facets.items():
        wanted = wanted | (
            (F.col("question_type") == question_type) & F.col("document_type").isin(*document_types)
        )
    return usable_results(results).filter(wanted)


def correctness_histogram(
    results: DataFrame,
    facets: Mapping[str, Sequence[str]] = fixed.HISTOGRAM_FACETS,
    integer_values: bool = False,
) -> DataFrame:
    """Histogram of correctness per facet in percent, with automatically chosen equal-width bins.

    The bin width is the smaller of Sturges' and the Freedman-Diaconis width, the latter at
    least half the square-root rule's; with `integer_values` bins are no narrower than 1. Rows
    are first counted per (facet, score). All later steps, quartiles included, work on those
    few counts. Only non-empty bins come out, as do only facets with rows.
    """
    facet = ["question_type", "document_type"]
    counts = (
        _in_facets(results, facets)
        .filter(F.col("correctness").isNotNull())
        .groupBy(*facet, "correctness")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    quartiles = F.percentile("correctness", [0.25, 0.75], F.col("count"))
    spans = counts.groupBy(*facet).agg(
        F.sum("count").alias("n"),
        F.min("correctness").cast("double").alias("low"),
        (F.max("correctness") - F.min("correctness")).cast("double").alias("span"),
        (quartiles[1] - quartiles[0]).alias("iqr"),
    )
    n = F.col("n").cast("double")
    freedman = F.lit(2.0) * F.col("iqr") / F.pow(n, F.lit(1.0 / 3.0))
    root = F.col("span") / F.sqrt(n) / 2
    sturges = F.col("span") / (F.log2(n) + 1)
    width = F.least(F.greatest(freedman, root), sturges)
    if integer_values:
        width = F.greatest(width, F.lit(1.0))
    bins = F.when(F.col("span") == 0, F.lit(1)).otherwise(F.ceil(F.col("span") / width)).cast("int")
    spans = spans.select(*facet, "n", "low", "span", bins.alias("bins"))
    place = F.when(F.col("span") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("correctness") - F.col("low")) * F.col("bins") / F.col("span")), F.col("bins") - 1)
    )
    # One value only: the bin reaches half a unit to both sides.
    start = F.when(F.col("span") == 0, F.col("low") - 0.5).otherwise(F.col("low"))
    step = F.when(F.col("span") == 0, F.lit(1.0)).otherwise(F.col("span") / F.col("bins"))
    return (
        counts.join(spans, facet)
        .withColumn("bin", place.cast("int"))
        .groupBy(*facet, "bin", "bins", (start + F.col("bin") * step).alias("bin_start"), "n")
        .agg(F.sum("count").alias("count"))
        .select(*facet, "bin", "bins", "bin_start", "count", (F.col("count") * 100.0 / F.col("n")).alias("percent"))
    )


def match_histogram(
    results: DataFrame, facets: Mapping[str, Sequence[str]] = fixed.HISTOGRAM_FACETS
) -> DataFrame:
    """Share of matched and unmatched documents per facet in percent."""
    facet = ["question_type", "document_type"]
    name, order = match_categories(F.col("document_match"))
    counts = (
        _in_facets(results, facets)
        .select(*facet, name.alias("document_match"), order.alias("match_order"))
        .filter(F.col("document_match").isNotNull())
        .groupBy(*facet, "document_match", "match_order")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy(*facet).agg(F.sum("count").alias("n"))
    return counts.join(totals, facet).select(
        *facet, "document_match", "match_order", "count", (F.col("count") * 100.0 / F.col("n")).alias("percent")
    )
