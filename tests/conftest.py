from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "null" if x != x else repr(round(x, 6) + 0.0)
    if hasattr(x, "tolist"):
        return _plain(x.tolist())
    if isinstance(x, (list, tuple)):
        return str([_plain(y) for y in x])
    return "null" if x is None or str(x) in ("<NA>", "NaT") else repr(x)


def rows(frame):
    """Rows of a pandas frame, whatever their order: columns by name, floats to six places."""
    cols = sorted(frame.columns)
    return sorted(tuple(_plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def agree(spark, sf, duck):
    """Does a query return what its SQL returns, under the same column names?"""

    def check(query, sql):
        got, want = query(spark, sf).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
