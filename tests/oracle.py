"""Run registered queries next to their SQL on DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a description of the difference."""
    got = fn(spark, sf_dir)
    mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} vs {sorted(names)}"
    kinds = {n: str(t) for n, t in zip(names, result.description and [d[1] for d in result.description])}
    bad = [n for n, t in kinds.items() if t.startswith(("HUGEINT", "DECIMAL"))]
    if bad:
        return f"oracle types need a cast: {[(n, kinds[n]) for n in bad]}"
    for f in got.schema.fields:
        spark_kind, duck = f.dataType.simpleString(), kinds[f.name]
        pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
        if pairs.get(spark_kind, duck) != duck:
            return f"type of {f.name}: {spark_kind} vs {duck}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    differing = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if differing:
        return f"{len(differing)} rows differ, e.g. {differing[0]}"
    return None if mine else "both sides empty"


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from flowtide.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                   "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, fn, sqls[name], sf_dir)
            else:
                problem = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {'' if name in sqls else '(rows only) '}"
              f"{time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
