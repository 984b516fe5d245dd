import math
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    import os

    os.environ["PYTHONPATH"] = ROOT
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="session")
def same(spark):
    """Whether a query and its SQL give the same rows."""
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")

    def check(query, sql):
        df = query(spark, DATA)
        names = sorted(df.columns)
        got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
        r = c.execute(sql)
        columns = [x[0] for x in r.description]
        want = sorted(repr([plain(dict(zip(columns, x))[n]) for n in names]) for x in r.fetchall())
        assert names == sorted(columns)
        assert got == want

    return check
