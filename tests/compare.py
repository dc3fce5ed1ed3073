"""Runs registered queries beside their SQL: python tests/compare.py SF [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def one(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        return repr(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as e

    from skein.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(folder).iterdir():
        glob = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{glob}')")
    qs, sql = e.queries(), e.oracle_sql()
    bad = 0
    for name in [n for n in qs if not names or any(n.startswith(x) for x in names)]:
        t = time.time()
        try:
            df = qs[name](spark, folder)
            got = canon([tuple(r) for r in df.collect()], df.columns)
        except Exception as err:  # noqa: BLE001
            print(f"{name}: FAILED {str(err)[:1500]}")
            bad += 1
            continue
        took = time.time() - t
        if name not in sql:
            print(f"{name}: {len(got)} rows, no SQL, {took:.1f} s  {df.columns}")
            continue
        try:
            cur = con.execute(sql[name])
            cols = [c[0] for c in cur.description]
            want = canon(cur.fetchall(), cols)
        except Exception as err:  # noqa: BLE001
            print(f"{name}: SQL FAILED {str(err)[:800]}")
            bad += 1
            continue
        ok = got == want and sorted(cols) == sorted(df.columns)
        bad += not ok
        print(f"{name}: {'ok' if ok else 'DIFFERS'} {len(got)} / {len(want)} rows, {took:.1f} s", "" if sorted(cols) == sorted(df.columns) else (sorted(cols), sorted(df.columns)))
        if not ok:
            a, b = set(got), set(want)
            print("   only Spark:", list(a - b)[:4], "\n   only SQL:  ", list(b - a)[:4])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
