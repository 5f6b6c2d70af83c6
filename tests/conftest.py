import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def same_rows(spark_df, relation):
    """Rows of both, columns by name, as sorted text."""
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)

    def norm(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, bool):
            return str(v)
        return str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    ours = sorted(tuple(norm(r[c]) for c in columns) for r in spark_df.collect())
    at = {c: i for i, c in enumerate(relation.columns)}
    theirs = sorted(tuple(norm(r[at[c]]) for c in columns) for r in relation.fetchall())
    assert ours == theirs
