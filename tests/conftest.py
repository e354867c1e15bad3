import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the driver's small tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def comparable(frame):
    """Rows of a pandas frame as sorted tuples, missing values as None and floats rounded."""
    import pandas as pd

    def one(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) if isinstance(v, float) else v

    names = sorted(frame.columns)
    return names, sorted((tuple(one(v) for v in row) for row in frame[names].astype(object).itertuples(index=False)), key=repr)
