"""Compare every query with its SQL: python -m tests.check_oracles FOLDER [NAME ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    return (1, repr(v)) if not isinstance(v, bool) else (1, repr(int(v)))


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_result(df):
    t = df.toArrow()
    names = t.schema.names
    cols = [c.to_pylist() for c in t.columns]
    types = {f.name: str(f.type) for f in t.schema}
    return names, list(zip(*cols)) if cols and len(cols[0]) else [], types


def sql_result(con, sql):
    rel = con.sql(sql)
    names, types = rel.columns, [str(t) for t in rel.types]
    arrow = {"VARCHAR": "string", "BIGINT": "int64", "DOUBLE": "double", "INTEGER": "int32", "BOOLEAN": "bool"}
    return names, rel.fetchall(), {c: arrow.get(t, t.strip('"')) for c, t in zip(names, types, strict=True)}


def compare(con, df, sql) -> str | None:
    """None when equal, else a description of the first difference."""
    an, ar, at = spark_result(df)
    bn, br, bt = sql_result(con, sql)
    ca, ra = canonical(an, ar)
    cb, rb = canonical(bn, br)
    if ca != cb:
        return f"columns {ca} / {cb}"
    typed = {"string": "str", "large_string": "str", "int64": "int", "double": "float", "null": "any", "NULL": "any"}
    off = [(c, at[c], bt[c]) for c in ca if "any" not in (x := (typed.get(at[c], at[c]), typed.get(bt[c], bt[c]))) and x[0] != x[1]]
    if off:
        return f"types {off}"
    if len(ra) != len(rb):
        return f"rows {len(ra)} / {len(rb)}"
    for x, y in zip(ra, rb, strict=True):
        if x != y:
            bad = [(c, p[1], q[1]) for c, p, q in zip(ca, x, y, strict=True) if p != q]
            n = sum(a != b for a, b in zip(ra, rb, strict=True))
            return f"{n}/{len(ra)} rows differ, first {bad} in {dict(zip(ca, [c[1] for c in x]))}"[:600]
    return None if ra else "no rows"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from seriesloom.session import build_session

    folder, names = argv[0], argv[1:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    q, o = queries(), oracle_sql()
    failed = []
    for name in names or q:
        start = time.time()
        try:
            if name in o:
                problem = compare(con, q[name](spark, folder), o[name])
            else:
                rows = q[name](spark, folder).toArrow().num_rows
                problem = None if rows else "no rows"
        except Exception as e:  # report and go on with the other queries
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        spark.catalog.clearCache()
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}{'' if name in o else ' (rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
