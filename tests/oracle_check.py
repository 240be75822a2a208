"""Compare registered queries with their SQL in DuckDB on the given tables.

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r),
    )


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    wanted = rows_of(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} / {sorted(names)}"
    if len(got) != len(wanted):
        return f"{len(got)} rows, expected {len(wanted)}"
    for ours, theirs in zip(got, wanted, strict=True):
        if ours != theirs:
            return f"{sorted(names)}: {ours} / {theirs}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from emberwatch.session import local_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        sql = oracle_sql().get(name)
        try:
            if sql is None:
                problem = None
                note = f"rows only: {query(spark, sf_dir).count()}"
            else:
                problem = compare(spark, con, name, query, sql, sf_dir)
                note = "equal"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"CHECK {name} {time.time() - began:.1f}s {problem or note}", flush=True)
    print(f"CHECK failed={failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
