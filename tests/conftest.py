from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from evidloom.session import local_session, ship

    s = local_session(4, spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    if not os.path.isdir(SMALL):
        pytest.skip("no test data here")
    return SMALL


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def normal(df):
    """Rows in order, columns by name, numbers to nine digits."""
    df = df[sorted(df.columns)].copy()

    def show(v):
        if v is None or (isinstance(v, float) and v != v) or str(v) == "NaT":
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return ",".join(map(str, v)) if hasattr(v, "__iter__") and not isinstance(v, str) else str(v)

    for c in df:
        df[c] = df[c].map(show)
    return df.sort_values(list(df.columns)).reset_index(drop=True)
