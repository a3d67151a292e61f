"""Compare registered queries with their SQL twins; run as a script or from pytest."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from brinefield.registry.projections import TABLES  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        def cell(value):
            if isinstance(value, (list, np.ndarray)):
                return str([cell(v) for v in value])
            if value is None or value is pd.NaT or (isinstance(value, float) and np.isnan(value)) or value is pd.NA:
                return "~"
            if isinstance(value, (bool, np.bool_)):
                return str(bool(value))
            if isinstance(value, (int, float, np.integer, np.floating)):
                value = float(value)
                return repr(value + 0.0)
            return str(value)
        frame[name] = [cell(v) for v in frame[name]]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(spark_frame: pd.DataFrame, oracle_frame: pd.DataFrame) -> str:
    a, b = canonical(spark_frame), canonical(oracle_frame)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} != {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = (a != b).any(axis=1)
    if bad.any():
        return f"{int(bad.sum())} of {len(a)} rows differ\n{a[bad].head(4).to_string()}\n{b[bad].head(4).to_string()}"
    return ""


def session(cores="8"):
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master(f"local[{cores}]").appName("parity").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def main(argv):
    from brinefield import registry
    sf, wanted = argv[0], argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failures, total = 0, time.time()
    for name, run in registry.queries().items():
        if wanted and not any(name.startswith(w) if not w.endswith("=") else name == w[:-1] for w in wanted):
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            sql = registry.oracle_sql().get(name)
            note = compare(got, con.execute(sql).df()) if sql else "(no twin)"
            sqltook = time.time() - start
        except Exception as error:  # noqa: BLE001
            note, took, sqltook, got = f"ERROR {type(error).__name__}: {str(error)[:700]}", time.time() - start, 0, []
        ok = note in ("", "(no twin)")
        failures += not ok
        flag = "ok " if ok else "BAD"
        empty = " EMPTY" if ok and not len(got) else ""
        print(f"{flag} {name:34s} rows={len(got):7d} spark={took:6.2f}s sql={sqltook:6.2f}s {note}{empty}", flush=True)
    print(f"failures={failures} in {time.time() - total:.0f}s")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
