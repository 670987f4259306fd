import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(frame):
    """Rows as sorted strings, columns by name; numbers alike whatever their type."""
    cols = sorted(frame.columns)
    show = lambda v: "NULL" if v is None or v != v else str(v) if isinstance(v, (str, bool)) else repr(float(v) + 0.0)
    return cols, sorted(tuple(map(show, r)) for r in frame[cols].itertuples(index=False))
