"""Rows of a query against DuckDB's, whatever their order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame) -> list:
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else str(x)
    return sorted((tuple(clean(x) for x in row) for row in frame.itertuples(index=False)), key=str)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()
