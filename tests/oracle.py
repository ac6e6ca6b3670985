"""Run a query and its SQL side by side and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return str(x)
        try:
            f = float(x)
        except (TypeError, ValueError):
            return str(x)
        return "nan" if math.isnan(f) else repr(f + 0.0)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs = rows_of(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        only = sorted(set(ours) - set(theirs))[:2], sorted(set(theirs) - set(ours))[:2]
        return f"{len(ours)} and {len(theirs)} rows; only ours {only[0]}; only theirs {only[1]}"
    return ""
