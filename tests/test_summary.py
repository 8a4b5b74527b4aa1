import math

import numpy as np
import pytest

from askgrid.operators import summary

SCHEMA = (
    "document_type STRING, question_type STRING, unambiguous STRING, correctness INT, retrieval INT, "
    "groundedness INT, document_match BOOLEAN"
)


@pytest.fixture
def results(spark):
    rows = [
        (" Fact Sheet\t", "Positive ", "Yes", 10, 10, 9, True),
        ("Fact Sheet", "Positive", "Yes", 9, 0, 0, False),
        ("Fact Sheet", "Positive", "Yes ", 1, 1, 1, False),  # not exactly Yes
        ("Market Report", "Positive", "Yes", 8, 7, 6, True),
        (None, "Positive", "Yes", 5, 5, 5, True),
        ("Doc Search", "Negative", "Yes", 4, 4, 4, None),
        ("Fact Sheet", "Negative", "Yes", 4, 4, 4, False),
        ("Other", "Negative", "Yes", 3, 3, 3, True),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_scores_by_document_type(results):
    got = {tuple(r) for r in summary.scores_by_document_type(results, "Positive").collect()}
    assert got == {("Fact Sheet", 9.5, 5.0, 4.5), ("Market Report", 8.0, 7.0, 6.0)}


def test_combine_models_keeps_duplicates_and_fills_columns(results):
    both = summary.combine_models({"a": results, "b": results.drop("groundedness")})
    assert both.count() == 16
    assert both.filter("model = 'b' and groundedness is null").count() == 8


def test_percentage_match(results):
    both = summary.combine_models({"a": results})
    got = {r["document_type"] + "/" + r["question_type"]: r for r in summary.percentage_match(both).collect()}
    assert got["Fact Sheet/Positive"]["percentage_match"] == 50.0
    assert got["Fact Sheet/Positive"]["label"] == "50.0%"
    assert got["Fact Sheet/Negative"]["label"] is None  # 0 %
    assert got["Doc Search/Negative"]["percentage_match"] is None
    assert got["Market Report/Positive"]["document_type_order"] == 2
    assert not any(key.startswith("Other") for key in got)


def test_counts(results):
    both = summary.combine_models({"a": results, "b": results.limit(2)})
    row = summary.response_counts(both, {"first": "a", "second": "b"}).first()
    assert row.asDict() == {"total": 9, "first": 7, "second": 2, "positive": 6, "negative": 3}


def test_standard_error(results):
    both = summary.combine_models({"a": results, "b": results.limit(1)})
    got = {r["model"]: r for r in summary.correctness_by_model(both).collect()}
    sample = [10, 9, 8, 5, 4, 4, 3]
    assert got["a"]["standard_error"] == pytest.approx(np.std(sample, ddof=1) / math.sqrt(len(sample)))
    assert got["b"]["standard_error"] is None and got["b"]["n"] == 1


@pytest.mark.parametrize("integer_values", [True, False])
@pytest.mark.parametrize("sample", [[7], [5, 5, 5], [1, 10], [1, 2, 2, 3, 9, 10, 10, 10, 4, 6], list(range(11)) * 7])
def test_histogram_equals_numpy(spark, sample, integer_values):
    rows = [("Fact Sheet", "Positive", "Yes", v, 0, 0, True) for v in sample]
    got = summary.correctness_histogram(spark.createDataFrame(rows, SCHEMA), integer_values=integer_values).collect()
    counts, edges = np.histogram(np.array(sample, dtype=int if integer_values else float), bins="auto")
    assert {r["bins"] for r in got} == {len(counts)}
    assert {r["bin"]: r["count"] for r in got} == {i: c for i, c in enumerate(counts) if c}
    for r in got:
        assert r["bin_start"] == pytest.approx(edges[r["bin"]])
        assert r["percent"] == pytest.approx(100 * r["count"] / len(sample))


def test_histograms_have_only_wanted_facets_with_rows(results):
    facets = {(r[0], r[1]) for r in summary.correctness_histogram(results).collect()}
    # Doc Search has no histogram for negative controls; no facet comes out without rows.
    assert facets == {("Positive", "Fact Sheet"), ("Positive", "Market Report"), ("Negative", "Fact Sheet")}


def test_match_histogram(results):
    got = {tuple(r)[:4]: r["percent"] for r in summary.match_histogram(results).collect()}
    assert got[("Positive", "Fact Sheet", "True", 0)] == 50.0
    assert got[("Negative", "Fact Sheet", "False", 1)] == 100.0
