import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # executors' Python


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with the rows of a SQL query, columns by name."""

    def norm(v):
        if isinstance(v, float) or type(v).__name__ == "Decimal":
            return round(float(v), 6)
        return v

    def check(df, relation):
        cols = sorted(df.columns)
        assert sorted(relation.columns) == cols
        at = [relation.columns.index(c) for c in cols]
        ours = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
        theirs = sorted((tuple(norm(r[i]) for i in at) for r in relation.fetchall()), key=repr)
        assert ours == theirs

    return check
