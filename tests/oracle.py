"""Run registered queries against their SQL twins and compare whole results.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def compare(df, db, sql: str) -> str | None:
    """None when rows and column names agree, else what differs."""
    names = sorted(df.columns)
    ours = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    at = [columns.index(n) for n in names]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in result.fetchall())
    if ours == theirs:
        return None
    more, less = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {more}; only SQL {less}"


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db = make_session(), connect(sf)
    chosen = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in chosen:
        begin = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            problem = compare(df, db, entry.oracle_sql()[name]) if name in entry.oracle_sql() else "no SQL"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - begin:.1f}s {problem or ''}"[:900], flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
