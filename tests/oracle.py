"""A query's rows beside those of its SQL in DuckDB."""

from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows):
    fix = lambda x: round(x, 9) if isinstance(x, float) else int(x) if isinstance(x, bool) else x
    return sorted((tuple(fix(x) for x in r) for r in rows), key=repr)


def same(df, con, sql: str) -> None:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
