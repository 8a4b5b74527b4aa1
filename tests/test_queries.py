"""Every registered query against its DuckDB SQL, on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    assert oracle.difference(df, con, sql) is None
    assert oracle.type_difference(df, con, sql) is None


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Queries that run Python in tasks work where the workers cannot import the package."""
    names = ["retrieve_hybrid", "doc_match", "retrieve_topk", "batch_rag"]
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(Path(entry.__file__).parent)!r})\n"
        "import __spark_entry__ as entry\n"
        "from askgrid.session import local_session\n"
        "spark = local_session(2)\n"
        f"for name in {names!r}: assert entry.queries()[name](spark, {FOLDER!r}).count() > 0\n"
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=environment, check=True, timeout=300)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_check_sees_differences(spark, con):
    df = spark.sql("select 1L as a, 2.5D as b union all select 2L, null")
    assert oracle.difference(df, con, "select 1 as a, cast(2.5 as double) as b union all select 2, null") is None
    assert "rows" in oracle.difference(df, con, "select 1 as a, cast(2.6 as double) as b union all select 2, null")
    assert "columns" in oracle.difference(df, con, "select 1 as a, 2 as c")


def test_every_sql_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
