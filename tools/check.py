"""Compare every registered query with its oracle SQL: names, types, rows, values."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(_cell(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _cell(v)) for k, v in value.items())
    if value is None or (isinstance(value, float) and value != value):
        return None
    if type(value).__name__ in ("bool", "bool_"):
        return bool(value)
    if type(value).__name__.startswith(("int", "uint")):
        return int(value)
    if type(value).__name__.startswith("float"):
        return float(value)
    return value


DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "tinyint": "TINYINT", "date": "DATE",
}


def duck_type(simple: str) -> str:
    if simple.startswith("array<"):
        return duck_type(simple[6:-1]) + "[]"
    return DUCK_TYPES.get(simple, simple)


def compare(frame, con, sql: str) -> str:
    got = frame.toArrow()
    con.execute(sql)
    names = [d[0] for d in con.description]
    kinds = dict(zip(names, (str(d[1]) for d in con.description)))
    rows = con.fetchall()
    left = sorted(frame.columns)
    if left != sorted(names):
        return f"columns differ {left} / {sorted(names)}"
    types = [
        (n, t, kinds[n]) for n, t in frame.dtypes if duck_type(t) != kinds[n] and "DECIMAL" not in kinds[n] and "STRUCT" not in kinds[n]
    ] + [(n, t, kinds[n]) for n, t in frame.dtypes if "DECIMAL" in kinds[n]]
    a = sorted(map(repr, zip(*[map(_cell, got.column(n).to_pylist()) for n in left])))
    order = [names.index(n) for n in left]
    b = sorted(repr(tuple(_cell(r[i]) for i in order)) for r in rows)
    note = f" types {types}" if types else ""
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}{note}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ{note}; columns {left}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return f"ok {len(a)}" if not types else f"TYPES {len(a)}{note}"


def main() -> int:
    from trajekt.plans import load_all
    from trajekt.session import build_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    queries, oracles = load_all()
    names = [n for n in queries if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    spark = build_session(8)
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in oracles:
                result = compare(frame, con, oracles[name])
            else:
                result = f"ok rows-only {frame.toArrow().num_rows}"
        except Exception as error:  # noqa: BLE001
            result = "ERROR " + str(error).split("JVM stacktrace")[0][:900]
        failed += not result.startswith("ok")
        print(f"{name:48s} {time.time() - start:6.2f}s  {result}", flush=True)
    print(f"{len(names)} queries, {failed} not ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
