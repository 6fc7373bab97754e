"""Side-by-side run of registered queries on Spark and their SQL on DuckDB.

    python tests/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def difference(spark, con, entry, sf_dir) -> tuple[str, int]:
    """An empty message when both sides agree, else what differs; and the row count."""
    df = entry.run(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if entry.oracle is None:
        return ("" if got else "no rows"), len(got)
    cursor = con.execute(entry.oracle)
    names = [c[0] for c in cursor.description]
    want = canonical(cursor.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ; spark {bad[0][0]} duckdb {bad[0][1]}", len(got)
    return "", len(got)


def main() -> int:
    from innings.plans.registry import entries
    from innings.session import local_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark, con = local_session(), connect(opts.sf)
    failed = 0
    for name, e in entries().items():
        if opts.names and not any(name.startswith(n) for n in opts.names):
            continue
        start = time.time()
        try:
            message, rows = difference(spark, con, e, opts.sf)
        except Exception as error:  # report and go on with the next query
            message, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        failed += bool(message)
        kind = "exact" if e.oracle else "rows"
        print(f"{'FAIL' if message else 'ok':4} {name:28} {kind:5} rows={rows:<7} {time.time() - start:6.2f}s {message[:900]}",
              flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
