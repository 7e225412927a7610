"""Compare registered queries with their SQL, the way the checking side does."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, (int, bool)):
            return float(v)
        return str(v)

    return sorted((tuple(cell(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    from tessera.catalog import ORACLES, QUERIES, expand

    start = time.time()
    got_frame = QUERIES[name](spark, folder).toPandas()
    took = time.time() - start
    note = f"{len(got_frame)} rows, {took:.1f}s"
    if name not in ORACLES:
        return True, note + " (no sql)"
    start = time.time()
    want_frame = con.execute(expand(ORACLES[name])).df()
    note += f", sql {time.time() - start:.1f}s"
    if sorted(got_frame.columns) != sorted(want_frame.columns):
        return False, f"columns {sorted(got_frame.columns)} vs {sorted(want_frame.columns)}"
    got, want = normal(got_frame), normal(want_frame)
    if got == want:
        return len(got) > 0, note
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return False, f"{len(got)} vs {len(want)} rows\n   spark only {str(extra)[:600]}\n   sql only   {str(missing)[:600]}"


if __name__ == "__main__":
    from tessera.catalog import QUERIES
    from tessera.session import local_session

    folder = f"/root/testdata/sf{os.environ.get('SF', '0.01')}"
    spark, con = local_session(8), connect(folder)
    names = sys.argv[1:] or list(QUERIES)
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as e:  # report every query
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok", bad)
