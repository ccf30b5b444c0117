"""Run registered queries and their SQL twins on one folder and compare the rows.

usage: python tools/check.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from wayline.catalog import ORACLES, QUERIES  # noqa: E402
from wayline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def kind(value) -> str:
    return "num" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    begin = time.time()
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - begin
    if name not in ORACLES:
        return bool(got), f"{len(got)} rows, no SQL, {spent:.1f}s"
    begin = time.time()
    cur = con.execute(ORACLES[name])
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    cols, a = rows_of(df.columns, got)
    wcols, b = rows_of(want_cols, cur.fetchall())
    note = f"{len(a)} rows, spark {spent:.1f}s, sql {time.time() - begin:.1f}s"
    if cols != wcols:
        return False, f"columns {cols} != {wcols}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "int": "INTEGER", "date": "DATE"}
    odd = [f"{c}:{types[c]}/{want_types[c]}" for c in cols if same.get(types[c]) != want_types[c]]
    if odd:
        note += f" TYPES {odd}"
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        return False, (
            f"{note} {len(b)} expected; only spark {len(left)}, only sql {len(right)}\n"
            f"      {cols}\n      spark {sorted(left, key=repr)[:2]}\n      sql   {sorted(right, key=repr)[:2]}"
        )
    if not a:
        note += " EMPTY"
    return True, note


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in QUERIES:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as err:  # report and go on with the next query
            ok, note = False, f"{type(err).__name__}: {str(err)[:900]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}" if bad else "all equal")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
