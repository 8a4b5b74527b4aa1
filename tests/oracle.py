"""Compare registered queries with their DuckDB SQL: rows, column names and values.

    python tests/oracle.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value)


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float",
    "VARCHAR": "string", "BOOLEAN": "boolean",
}


def type_difference(spark_df, con, sql: str) -> str | None:
    """None if both results have the same column types."""
    described = con.execute(f"describe {sql}").fetchall()
    theirs = {name: _TYPES.get(kind, kind) for name, kind, *_ in described}
    wrong = {n: (t, theirs.get(n)) for n, t in spark_df.dtypes if theirs.get(n) != t}
    return f"types (spark, sql): {wrong}" if wrong else None


def difference(spark_df, con, sql: str) -> str | None:
    """None if both results are equal, else what differs."""
    rows = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns: spark {sorted(spark_df.columns)}, sql {sorted(names)}"
    mine, theirs = _bag(spark_df.columns, rows), _bag(names, expected)
    if mine == theirs:
        return None if rows else "no rows on either side"
    extra, missing = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
    return f"{len(rows)} rows against {len(expected)}; columns {sorted(names)}\n  only spark: {extra}\n  only sql:   {missing}"


def main() -> int:
    import __spark_entry__ as entry
    from askgrid.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(folder)
    sql, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sql:
                result = difference(df, con, sql[name]) or type_difference(df, con, sql[name]) or "equal"
            else:
                result = f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        failed += not (result == "equal" or result.startswith("rows only"))
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
