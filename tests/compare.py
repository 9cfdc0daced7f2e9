"""Compare registered queries with their SQL twins: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb


def norm(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(norm(v) for v in value) + "]"
    return str(value)


def connection(folder: str):
    from kerbline.sources.tables import RAW

    con = duckdb.connect()
    for name in RAW:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def oracle_rows(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall(), {d[0]: str(d[1]) for d in cur.description}


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, queries, oracles):
    df = queries[name](spark, folder)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if name not in oracles:
        return "rows-only", len(rows), ""
    ocols, orows, otypes = oracle_rows(con, oracles[name])
    if sorted(cols) != sorted(ocols):
        return "COLUMNS", len(rows), f"{sorted(cols)} vs {sorted(ocols)}"
    kinds = {"bigint": {"BIGINT", "NUMBER"}, "double": {"DOUBLE"}, "int": {"INTEGER"}, "string": {"VARCHAR"}}
    odd = [f"{c}:{t}/{otypes[c]}" for c, t in df.dtypes
           if t in kinds and otypes[c].upper() not in kinds[t]]
    a, b = table(cols, rows), table(ocols, orows)
    note = ("types " + ",".join(odd)) if odd else ""
    if a == b:
        return "ok" if not odd else "TYPES", len(rows), note
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return "DIFF", len(rows), f"{note} {sorted(cols)} spark={len(a)} oracle={len(b)} only-spark={only_a} only-oracle={only_b}"


def main(argv):
    from kerbline.catalog import registry
    from kerbline.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = registry.queries(), registry.oracles()
    names = argv[1:] or list(queries)
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            state, n, note = compare(spark, con, folder, name, queries, oracles)
        except Exception as exc:  # noqa: BLE001
            state, n, note = "ERROR", 0, str(exc)[:700].replace("\n", " ")
        if state not in ("ok", "rows-only"):
            bad += 1
        print(f"{state:10s} {time.time() - start:6.2f}s {n:8d} {name} {note}", flush=True)
    print(f"checked {len(names)}, not matching {bad}")


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv[1:])
