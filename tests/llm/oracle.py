from __future__ import annotations

import duckdb


def duck(sql: str, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return con.sql(sql).fetchall()
