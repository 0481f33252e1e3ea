"""Runs a query and its DuckDB twin and compares all values."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(0.0 if isinstance(r[i], float) and r[i] == 0 else r[i] for i in at) for r in rows), key=lambda r: tuple(map(str, r)))


def differing(spark, sf_dir, con, query, sql):
    df = query(spark, sf_dir)
    twin = con.sql(sql)
    if sorted(df.columns) != sorted(twin.columns):
        return f"columns {sorted(df.columns)} and {sorted(twin.columns)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(twin.columns, twin.fetchall())
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; first differing {next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)}"
