"""Comparison of a query with its SQL on the same parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb

DATA = "/root/testdata"


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def expected(sf_dir: str, sql: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    r = c.execute(sql)
    return sorted(d[0] for d in r.description), [d[0] for d in r.description], r.fetchall()


def compare(df, sf_dir: str, sql: str) -> None:
    names, order, want = expected(sf_dir, sql)
    assert sorted(df.columns) == names
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    want = sorted((tuple(_plain(v) for _, v in sorted(zip(order, row))) for row in want), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:2]
