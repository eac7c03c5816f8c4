"""A query's rows beside those of its SQL in DuckDB."""

import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else round(value, 6) if isinstance(value, float) else value


def compare(spark, con, f, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    want_rel = con.sql(sql)
    if sorted(want_rel.columns) != names:
        return f"columns {names} and {sorted(want_rel.columns)}"
    want = sorted((tuple(plain(v) for v in r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()), key=repr)
    if got == want:
        return ""
    odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
    return f"{len(got)} and {len(want)} rows; {str(odd)[:600]}"
