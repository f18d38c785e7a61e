import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compared(spark, sf_dir, run, sql):
    """Rows of a query and of its SQL, as sorted lists of comparable tuples."""
    import math

    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        con.sql(f"create view {name} as select * from '{sf_dir}/{f}'")

    def rows(frame, columns):
        def text(v):
            if v is None or (isinstance(v, float) and math.isnan(v)):
                return ""
            return repr(float(v)) if isinstance(v, float) else str(v)

        return sorted(tuple(text(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))

    ours, theirs = run(spark, sf_dir).toPandas(), con.sql(sql).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    return rows(ours, columns), rows(theirs, columns)
