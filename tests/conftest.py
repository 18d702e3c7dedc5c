import sys
from pathlib import Path

import duckdb
import pytest
from common import SF, TABLES
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def agree(spark):
    """Compares a query with its SQL over the smallest tables, as sets of rows with all columns."""
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def run(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(map(repr, r)) for r in df.select(columns).collect())
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted(tuple(repr(row[names.index(c)]) for c in columns) for row in result.fetchall())
        assert got == want

    return run
