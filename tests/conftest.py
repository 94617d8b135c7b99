import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    settings = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "3g", "spark.sql.adaptive.enabled": "true",
    }
    session = SparkSession.builder.master("local[4]").config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(SF)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Whether a query and its SQL give the same rows, in any order."""

    def plain(v):
        return repr(round(v, 6)) if isinstance(v, float) else repr(v)

    def check(make, sql):
        found = make(spark, sf_dir)
        relation = duck.sql(sql)
        columns = sorted(found.columns)
        assert columns == sorted(relation.columns)
        ours = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
        theirs = sorted(tuple(map(plain, r)) for r in relation.select(*(f'"{c}"' for c in columns)).fetchall())
        assert ours == theirs

    return check
