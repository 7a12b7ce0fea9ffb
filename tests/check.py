"""Compare a Spark result with its SQL twin: names, row count, values as a multiset."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
                cells.append("NULL")
            elif isinstance(v, bool):
                cells.append(str(v))
            elif hasattr(v, "item") and not hasattr(v, "__len__"):
                cells.append(repr(v.item()))
            else:
                cells.append(repr(v))
        rows.append(tuple(cells))
    return sorted(rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    want = con.execute(sql).df()
    got = spark_df.toPandas()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds_g = {c: got[c].dtype.kind for c in got.columns}
    kinds_w = {c: want[c].dtype.kind for c in want.columns}
    odd = {c: (str(got[c].dtype), str(want[c].dtype)) for c in kinds_g if kinds_g[c] != kinds_w[c]}
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"{len(bad)} differing rows; spark-only {only_a}; sql-only {only_b}; kinds {odd}"
    return f"kinds {odd}" if odd else None
