"""Order-free comparison of a Spark result with DuckDB's."""

import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return db


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        kind = str(frame[c].dtype)
        if frame[c].dtype.kind in "iufb" or kind.startswith(("Int", "Float")):
            frame[c] = frame[c].astype(float).round(6)
        else:
            frame[c] = frame[c].map(lambda v: None if v is None or v != v else v if isinstance(v, str) else float(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def assert_same(got, want):
    a, b = plain(got), plain(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert ((a == b) | (a.isna() & b.isna())).all().all()
