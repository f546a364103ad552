import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(df):
    """A pandas frame as sorted rows of comparable values, columns by name."""
    df = df[sorted(df.columns)]
    rows = [tuple(round(float(x), 6) if isinstance(x, float) else None if x is None else x if isinstance(x, (bool, int, str)) else x.item() if hasattr(x, "item") else str(x) for x in r) for r in df.itertuples(index=False)]
    return sorted(df.columns), sorted(rows, key=repr)


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        (names, rows), (other, expected) = plain(a), plain(b)
        assert names == other
        assert len(rows) == len(expected)
        assert rows == expected

    return check
