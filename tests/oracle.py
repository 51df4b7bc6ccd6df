"""Run queries beside their SQL twins and compare rows. Usage: python tests/oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("checks")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _norm(v: object) -> str:
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v != 0 else "0"
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return str(v.replace(tzinfo=None))
    return str(v)


def _rows(names: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare_rows(df, con, sql: str) -> str:
    """Empty if the frame and the statement give the same rows, else how they differ."""
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = _rows([d[0] for d in cur.description], cur.fetchall())
    return "" if left == right and left[1] else f"{len(left[1])} rows against {len(right[1])}, {left[0]} against {right[0]}"


def compare(spark: SparkSession, con, name: str, sf: str) -> str:
    from panelcraft.plans import catalog

    t0 = time.time()
    df = catalog.QUERIES[name](spark, sf)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if name not in catalog.ORACLE:
        return f"rows-only {len(left[1])} rows {t1 - t0:.1f}s"
    cur = con.execute(catalog.ORACLE[name])
    right = _rows([d[0] for d in cur.description], cur.fetchall())
    took = f"{len(left[1])} rows, spark {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s"
    if left[0] != right[0]:
        return f"COLUMNS {left[0]} vs {right[0]}"
    if left[1] != right[1]:
        a, b = set(left[1]) - set(right[1]), set(right[1]) - set(left[1])
        return f"MISMATCH {took} ({len(left[1])} vs {len(right[1])}) cols {left[0]}\n   spark {sorted(a)[:3]}\n   sql   {sorted(b)[:3]}"
    if not left[1]:
        return f"EMPTY {took}"
    return f"ok {took}"


def main() -> None:
    from panelcraft.plans import catalog

    args = sys.argv[1:]
    sf = f"{DATA}/sf{args.pop(0)}" if args and args[0][0].isdigit() else f"{DATA}/sf0.01"
    names = [n for n in catalog.QUERIES if not args or any(n.startswith(a) for a in args)]
    spark, con = session(), database(sf)
    bad = 0
    for n in names:
        try:
            text = compare(spark, con, n, sf)
        except Exception as exc:  # keep going: the report lists every failure
            text = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        bad += not text.startswith(("ok", "rows-only"))
        print(f"{n}: {text}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
