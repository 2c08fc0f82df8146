"""Side-by-side comparison of a query and its SQL, as multisets of normalised rows."""

import glob
import math
import os
from collections import Counter

import duckdb


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return round(float(v), 6)
    return str(v)


def connect(data_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    ours = Counter(tuple(normal(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(normal(r[i]) for i in order) for r in cur.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
