"""Compare every registered query with its SQL on the same tables.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# DuckDB type of each Spark type.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def compare(df, con, statement: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    fetched = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    described = {row[0]: row[1] for row in con.execute(f"describe {statement}").fetchall()}
    wrong = [
        f"{c}: {t} against {described[c]}" for c, t in df.dtypes if TYPES[t] != described[c]
    ]
    if wrong:
        return "types " + "; ".join(wrong)
    order = sorted(names)
    at = [names.index(c) for c in order]

    def key(row):
        return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)

    expected = sorted((tuple(row[i] for i in at) for row in fetched), key=key)
    got = sorted((tuple(row) for row in df.select(*order).collect()), key=key)
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected, strict=True) if g != e]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {order}: {bad[0][0]} against {bad[0][1]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from firstdue import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(
        "oracle", "local[8]", 8,
        {"spark.ui.enabled": "false", "spark.driver.memory": "8g",
         "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            problem = compare(df, con, oracle[name]) if name in oracle else None
            rows = df.count() if name not in oracle else ""
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        state = "ok" if problem is None else "FAIL"
        if name not in oracle and problem is None:
            state = f"rows only ({rows})"
        print(f"{state:5} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
