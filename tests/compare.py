"""Run every registered query next to its SQL and report differences.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tabweave.queries.roles import TABLES  # noqa: E402


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value.is_integer() and abs(value) < 1e15 else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


KINDS = {"bigint": "int", "int": "int", "integer": "int", "smallint": "int", "hugeint": "huge", "double": "float",
         "varchar": "str", "string": "str", "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ts", "date": "date"}


def kind(t):
    t = t.lower()
    return KINDS.get(t, "dec" if t.startswith("decimal") else t)


def check(spark, con, name, fn, sql, sf_dir):
    """'' when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    spark_types = {c: kind(t) for c, t in df.dtypes}
    odd = {c: (spark_types[c], types[c]) for c in columns if spark_types[c] != types[c]}
    want = rows_of(columns, cur.fetchall())
    if got != want:
        have, need = set(got), set(want)
        extra = [r for r in got if r not in need][:3]
        lost = [r for r in want if r not in have][:3]
        return f"{len(got)} rows vs {len(want)}; only spark {extra}; only sql {lost}; columns {sorted(columns)}"
    if not got:
        return "no rows"
    return f"types {odd}" if odd else ""


def main():
    from tabweave.session import build_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    bad = 0
    for name in names:
        t = time.time()
        try:
            result = check(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            result = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += bool(result)
        print(f"{'ok ' if not result else 'BAD'} {name:24s} {time.time() - t:6.1f}s {'S' if name in sql else 'R'} {result[:1500]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
