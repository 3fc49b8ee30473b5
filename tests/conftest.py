from __future__ import annotations

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def spark():
    from roadloom.session import local_session

    return local_session(8, 4)


def _duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same():
    """Compares a query's rows with its SQL's, order aside."""

    def plain(v):
        if isinstance(v, float):
            return round(v, 9)
        if v is None or v != v:
            return None
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v

    def check(query, sql, spark, sf_dir):
        df = query(spark, sf_dir)
        cols = sorted(df.columns)
        got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
        rel = _duck(sf_dir).execute(sql)
        names = [d[0] for d in rel.description]
        want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in rel.fetchall()]
        assert sorted(names) == cols
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(got, key=key) == sorted(want, key=key)
        return len(got)

    return check
