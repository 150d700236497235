"""Run registered queries next to their SQL and report differences.

    python -m tests.compare [name ...]      # SF=0.01 by default
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

DATA = os.environ.get("COHORT_DATA", "/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, int):
        return (3, str(value))
    return (4, str(value))


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in data)


def difference(con, df, sql: str) -> str | None:
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(wrong)} of {len(got)} rows differ, e.g. {wrong[0]}" if wrong else None


def main(names: list[str]) -> int:
    from cohortlens.plans import registry
    from cohortlens.session import local_session

    sf_dir = f"{DATA}/sf{os.environ.get('SF', '0.01')}"
    spark = local_session(os.environ.get("CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if names and name not in names:
            continue
        start = time.monotonic()
        try:
            if name in registry.ORACLES:
                problem = difference(con, fn(spark, sf_dir), registry.ORACLES[name])
                kind = "sql "
            else:
                problem = None if fn(spark, sf_dir).collect() else "no rows"
                kind = "rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {error!s:.600}"
            kind = "err "
        bad += problem is not None
        print(f"{kind} {time.monotonic() - start:6.1f}s {name}: {problem or 'ok'}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
