import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("cairn-tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def canonical(frame):
    """Rows as sorted tuples of text, columns by name, doubles to nine digits."""
    import pandas as pd

    def text(x):
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return "NULL"
        if hasattr(x, "year"):
            return str(pd.Timestamp(x))
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(float(x)) if not isinstance(x, (str, bool)) and str(type(x).__name__).startswith("float") else str(x)

    frame = frame[sorted(frame.columns)]
    norm = [[f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else text(v) for v in row] for row in frame.itertuples(index=False)]
    return list(frame.columns), sorted(norm)
