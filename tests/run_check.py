"""Command line: python -m tests.run_check SF_DIR [name ...] — prints one line per query."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.check import compare, connect


def main(argv: list[str]) -> int:
    sf, names = argv[0], [a for a in argv[1:] if "=" not in a]
    settings = dict(a.split("=", 1) for a in argv[1:] if "=" in a)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for key, value in settings.items():
        spark.conf.set(key, value)
    con = connect(sf)
    oracle = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(run(spark, sf), con, oracle[name])
                kind = "sql"
            else:
                problem = None if len(run(spark, sf).toPandas()) > 0 else "no rows"
                kind = "rows"
        except Exception as exc:  # noqa: BLE001
            problem, kind = f"{type(exc).__name__}: {str(exc)[:600]}", "error"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:5s} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
