"""Compare registered queries with their SQL: ``python tests/check_oracle.py [sf folder] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return str(value) if hasattr(value, "isoformat") else value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    got_cols = df.columns
    got = table_of(got_cols, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_cols = [d[0] for d in cursor.description]
    want = table_of(want_cols, cursor.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"row {a} != {b}"
    return None


def main() -> int:
    from streamjobs.catalog import ORACLE, QUERIES
    from streamjobs.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                problem = compare(df, con, ORACLE[name])
                state = "ok" if problem is None else "DIFF " + problem[:600]
            else:
                state = f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001
            state = "ERROR " + str(error)[:700]
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:36s} {time.time() - start:6.1f}s {state}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
