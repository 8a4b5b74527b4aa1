import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from askgrid.functions import text


def test_strip_is_unicode(values):
    inputs = ["\t a b \n", " x ", "\x1cy\x1f", "", None, "in \n side", "z\u0085"]
    assert values(text.strip, inputs) == [i if i is None else i.strip() for i in inputs]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=30))
def test_strip_equals_python(values, inputs):
    inputs = [i.replace("\x00", "") for i in inputs]
    assert values(text.strip, inputs) == [i.strip() for i in inputs]


def test_round_half_even(spark):
    rows = [(0.125,), (0.135,), (2.5,), (1.005,), (None,)]
    df = spark.createDataFrame(rows, "v DOUBLE").select(text.round_half_even(F.col("v")))
    assert [r[0] for r in df.collect()] == [0.12, 0.14, 2.5, 1.0, None]


def test_file_type(values):
    inputs = ["/a/b.c/file", "/a/x.tar.gz", "/a/", "x.pdf?v=1", "plain", None]
    assert values(text.file_type, inputs) == ["file", "gz", "", "pdf?v=1", "plain", None]


def test_target_file_name(spark):
    df = spark.createDataFrame([("A/B", "/f/x.pdf"), ("C", "/f/y"), (None, "/f/z.pdf")], "name STRING, url STRING")
    got = df.select(text.target_file_name(F.col("name"), F.col("url"))).collect()
    assert [r[0] for r in got] == ["AB.pdf", "C.y", None]


def test_clean_document_name(values):
    inputs = ["x.PDF", "xApdf", "One Page A One Page B.pdf", "\tA.pdf ", "Foo.pdf\n", "one page C", " D ", ".pdf"]
    expected = ["x", "x", "A B", "A.pdf", "Foo", "one page C", "D", ".pdf"]
    # A suffix followed by a space is not at the end, so it stays; `.pdf` alone has no character before.
    expected[7] = ""
    assert values(text.clean_document_name, inputs) == expected


def test_nfc(values):
    inputs = ["é", "é", "plain", None]
    assert values(text.nfc, inputs) == [i if i is None else unicodedata.normalize("NFC", i) for i in inputs]


def test_parse_score(values):
    inputs = ["7", " 10\n", "0", "11", "7.0", "seven", "", "+3", "-1", "007", "1_0", "99999999999", None, "1 0"]
    assert values(text.parse_score, inputs) == [7, 10, None, None, None, None, None, 3, None, 7, 10, None, None, None]


def test_strict_score_shows_the_reply(values):
    assert values(text.parse_score_strict, ["1", "10"]) == [1, 10]
    with pytest.raises(PySparkException, match="unexpected score: 'seven'"):
        values(text.parse_score_strict, ["1", " seven "])


def test_python_literal(values):
    inputs = ["a", "it's", 'say "x"', "both ' and \"", "line\nbreak\t\\", " ​\x07", "é ü", "", "\U000e0001", None]
    assert values(text.python_literal, inputs) == [repr(i) for i in inputs]


def test_python_list_and_dict(spark):
    df = spark.createDataFrame([(["a", "it's", None], {"title": "x.pdf", "n": None})], "l ARRAY<STRING>, m MAP<STRING, STRING>")
    row = df.select(text.python_list(F.col("l")), text.python_dict(F.map_entries("m"))).first()
    assert row[0] == str(["a", "it's", None])
    assert row[1] in (str({"title": "x.pdf", "n": None}), str({"n": None, "title": "x.pdf"}))


def test_tokens(values):
    assert values(text.tokens, ["Hello, WORLD_2 été", " ..."]) == [["hello", "world", "2", "été"], []]


def test_fill_template(values):
    assert values(lambda x: text.fill_template("a {x} b {x}", {"x": x}), ["1"]) == ["a 1 b 1"]
