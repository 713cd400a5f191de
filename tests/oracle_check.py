"""Run registered queries beside their SQL in DuckDB and compare the rows.

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows),
        key=lambda r: tuple("" if c is None else str(c) for c in r),
    )


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
}


def compare(spark, con, sf_dir, fn, sql):
    """None if equal, else a short text on the first difference."""
    df = fn(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows", len(mine)
    rel = con.sql(sql)
    other = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}", len(mine)
    types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema:
        want = _TYPES.get(f.dataType.simpleString())
        if want != types[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} vs {types[f.name]}", len(mine)
    if len(mine) != len(other):
        return f"rows {len(mine)} != {len(other)}", len(mine)
    bad = [(a, b) for a, b in zip(mine, other) if a != b]
    if bad:
        return f"{len(bad)} rows differ, e.g. {str(bad[0][0])[:300]} | {str(bad[0][1])[:300]}", len(mine)
    return None, len(mine)


def main():
    import __spark_entry__ as entry
    from tallyloom.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    keys = [a for a in args if "/" not in a]
    spark = local_session()
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    extra = set(sqls) - set(queries)
    if extra:
        print("SQL without query:", extra)
    failed = []
    for name in keys or queries:
        start = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, queries[name], sqls.get(name))
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        took = time.time() - start
        kind = "sql" if name in sqls else "rows-only"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {kind} rows={n} {took:.1f}s"
              + (f"\n     {problem}" if problem else ""), flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
