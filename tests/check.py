"""Compare every named query with its SQL counterpart on one scale folder."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, sql: str) -> str:
    """Empty when both agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    if ours != theirs:
        at = next(i for i, (a, b) in enumerate(zip(ours, theirs)) if a != b)
        return f"row {at}: {str(ours[at])[:300]} / {str(theirs[at])[:300]}"
    return ""


def main() -> None:
    from tests.conftest import make_session

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    spark, con = make_session(), open_tables(sf_dir)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, con, sf_dir, name, oracles[name]) or "ok"
            else:
                verdict = f"rows only: {len(run(spark, sf_dir).collect())}"
        except Exception as e:  # report and go on with the next query
            verdict = f"ERROR {type(e).__name__}: {str(e)[:400]}"
        print(f"{name:24s} {time.time() - start:6.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
