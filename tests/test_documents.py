import json

import pytest
from pyspark.errors import PySparkException

from askgrid.operators import columns, docsync
from askgrid.sources import listing


def names(df):
    return [r["name"] for r in df.collect()]


@pytest.fixture
def listed(spark):
    rows = [
        (None, "/f/0.pdf"),
        ("ccs lower", "/f/1.pdf"),
        ("CCS x", "/f/2.pdf"),
        ("a Market Summary b", "/f/3.pdf"),
        ("Market Strategy", "/f/4.pdf"),
        ("market strategy", "/f/5.pdf"),
        ("A/B", "/f/6.pdf"),
        ("Twice", "/f/7.docx"),
        ("Twice", "/f/8.pdf"),
        ("Here", "/f/9.pdf"),
    ]
    return spark.createDataFrame(rows, "name STRING, url STRING")


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([("Here.pdf",), ("AB.pdf",), ("gone.pdf",), ("notes.txt",)], "file_name STRING")


def test_exclusion_keeps_unnamed_documents(listed):
    kept = names(docsync.exclude_documents(listed))
    assert kept == [None, "ccs lower", "market strategy", "A/B", "Twice", "Twice", "Here"]


def test_new_documents(listed, stored):
    kept = docsync.exclude_documents(listed)
    assert names(docsync.new_document_names(kept, stored)) == ["A/B", "Twice", "Twice", "ccs lower", "market strategy"]
    # A name with a slash never has a stored file of that very name; by target it has.
    by_target = names(docsync.new_document_names(kept, stored, match_on="target"))
    assert by_target == ["Twice", "Twice", "ccs lower", "market strategy"]
    with pytest.raises(ValueError):
        docsync.new_documents(kept, stored, match_on="size")


def test_names_repeated_beyond_a_piece(spark, stored, monkeypatch):
    monkeypatch.setattr(docsync, "_PIECE", 7)
    rows = [("hot", "/h.pdf")] * 50 + [("Here", "/x.pdf")] * 20 + [("z", "/z.pdf")] * 14 + [("b", "/b.pdf")]
    listing_ = spark.createDataFrame(rows, "name STRING, url STRING").repartition(4)
    assert names(docsync.new_document_names(listing_, stored)) == ["b"] + ["hot"] * 50 + ["z"] * 14


def test_download_plan(listed, stored):
    plan = docsync.download_plan(docsync.exclude_documents(listed), stored)
    targets = sorted(r["target"] for r in plan.collect())
    assert targets == sorted(
        ["raw_docs/AB.pdf", "raw_docs/Twice.docx", "raw_docs/Twice.pdf", "raw_docs/ccs lower.pdf", "raw_docs/market strategy.pdf"]
    )


def test_orphans(listed, stored):
    orphans = docsync.orphaned_files(docsync.exclude_documents(listed), stored)
    assert sorted(r["file_name"] for r in orphans.collect()) == ["AB.pdf", "gone.pdf", "notes.txt"]


def response(status, columns_, data, **more):
    return (json.dumps({"status": status, **more, "querydata": {"columns": columns_, "data": data}}),)


def test_parse_listing(spark):
    rows = [
        response(9001, ["name", "getfileurl", "modifydate"], [["a", "/a", "d1"], ["b", "/b", "d2"]]),
        response(9001, ["modifydate", "size", "name", "getfileurl"], [["d3", "1", "c", "/c"]]),
        response(9001, ["name", "name", "getfileurl", "modifydate"], [["old", "new", "/n", "d4"]]),
        response(9001, ["name", "getfileurl", "modifydate"], []),
    ]
    df = spark.createDataFrame(rows, "response STRING")
    got = sorted(tuple(r) for r in listing.parse_listing(df).collect())
    assert got == [("a", "/a", "d1"), ("b", "/b", "d2"), ("c", "/c", "d3"), ("new", "/n", "d4")]
    assert listing.parse_listing(df, max_rows=2).count() == 2


def test_rejected_listing(spark):
    bad = spark.createDataFrame(
        [response(401, [], [], **{"status text": "denied"}), response(9001, ["name", "getfileurl", "modifydate"], [["a", "/a", "d"]])],
        "response STRING",
    )
    assert listing.parse_listing(bad, strict=False).count() == 1
    rejected = listing.rejected_responses(bad).collect()
    assert [(r["status"], r["status_text"]) for r in rejected] == [(401, "denied")]
    with pytest.raises(PySparkException, match="API returned status: 401 - denied"):
        listing.parse_listing(bad).collect()


def test_listing_without_a_column(spark):
    df = spark.createDataFrame([response(9001, ["name"], [["a"]])], "response STRING")
    assert listing.parse_listing(df, strict=False).count() == 0
    unreadable = df.union(spark.createDataFrame([("no json",)], "response STRING"))
    assert sorted(r["reason"] for r in listing.rejected_responses(unreadable).collect()) == ["columns", "status"]
    with pytest.raises(PySparkException, match="lacks one of the columns"):
        listing.parse_listing(df).collect()


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None, "a.b"), (2, None, 5, None)], "a INT, b STRING, c INT, `d.e` STRING")
    assert columns.drop_empty_columns(df).columns == ["a", "c", "d.e"]
    # A value beyond the first rows keeps its column too.
    late = spark.range(5000, numPartitions=4).selectExpr("id", "if(id = 4999, 'x', null) as late", "cast(null as int) as never")
    assert columns.drop_empty_columns(late).columns == ["id", "late"]


def test_index_fields(spark):
    both = spark.createDataFrame([([1.0], "t"), (None, "u")], "content_vector ARRAY<FLOAT>, content STRING")
    assert columns.has_index_fields(both) is True
    assert columns.has_index_fields(both.select("content_vector")) is False
    assert columns.has_index_fields(spark.createDataFrame([], "other INT")) is False
    assert columns.has_index_fields(both, "text_vector", "chunk") is False
    report = columns.index_field_report(both).first()
    assert (report["compatible"], report["rows"], report["filled_rows"]) == (True, 2, 1)
    with pytest.raises(ValueError):
        columns.require_index_fields(both.select("content"))


def test_move_last(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a INT, b INT, c INT")
    assert columns.move_last(df, ["a", "b"]).columns == ["c", "a", "b"]


def test_chunks_of_a_long_text_take_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from askgrid.operators.chunking import split_documents

    def seconds(repeats):
        df = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("abcdefghij"), repeats).alias("text"))
        start = time.perf_counter()
        assert split_documents(df).count() == max(1, -(-(10 * repeats - 500) // 1500))
        split_documents(df).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(800_000) < 60


@pytest.mark.parametrize(("size", "overlap"), [(5, 0), (5, 2), (5, 4), (4, 3), (1, 0), (30, 7)])
def test_chunks_equal_slices(spark, size, overlap):
    from askgrid.operators.chunking import split_documents

    texts = ["", "a", "abcde", "äöü\nß🙂xyz" * 3, "0123456789" * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    got = sorted((r["doc_id"], r["chunk_no"], r["chunk"]) for r in split_documents(df, size=size, overlap=overlap).collect())
    step, expected = size - overlap, []
    for i, t in enumerate(texts):
        if t:
            number = max(1, -(-(len(t) - overlap) // step))
            expected += [(i, n, t[n * step : n * step + size]) for n in range(number)]
    assert got == expected
