import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
FIXTURES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    session = builder.config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the fixture tables."""
    import duckdb

    con = duckdb.connect()
    for p in Path(FIXTURES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def agree(duck):
    """Assert that a DataFrame and a SQL text give the same rows."""

    def check(df, sql):
        cols = sorted(df.columns)
        key = lambda r: tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r)
        mine = sorted(key(r) for r in df.select(*cols).collect())
        theirs = sorted(key(r) for r in duck.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({sql})").fetchall())
        assert len(mine) == len(theirs)
        assert mine == theirs

    return check
