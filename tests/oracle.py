"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/oracle.py [name-prefix ...]    (SF_DIR selects the tables)
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(df, con, text) -> list[str]:
    """Empty when both sides agree on column names, row count and every value."""
    mine = _rows(df.columns, [tuple(row) for row in df.collect()])
    result = con.execute(text)
    names = [c[0] for c in result.description]
    theirs = _rows(names, result.fetchall())
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} != {theirs[0]}"]
    if len(mine[1]) != len(theirs[1]):
        return [f"rows {len(mine[1])} != {len(theirs[1])}"] + [f"{a} != {b}" for a, b in zip(mine[1][:2], theirs[1][:2])]
    bad = [f"{a} != {b}" for a, b in zip(mine[1], theirs[1]) if a != b]
    return [f"{len(bad)} of {len(mine[1])} rows differ, columns {mine[0]}", *bad[:3]] if bad else []


def main() -> int:
    import __spark_entry__ as entry
    from entitywatch.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed, wanted = connect(sf_dir), 0, sys.argv[1:]
    texts = entry.oracle_sql()
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in texts:
                problems = differences(df, con, texts[name])
            else:
                count = df.count()
                problems = [] if count else ["no rows"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        kind = "sql" if name in texts else "rows"
        print(f"{'ok  ' if not problems else 'FAIL'} {kind:4} {name} {time.time() - start:.1f}s", flush=True)
        for problem in problems:
            print("     ", problem[:700], flush=True)
        failed += bool(problems)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
