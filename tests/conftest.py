import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same(rows, wanted, places=6):
    """Rows as multisets; numbers to so many places."""

    def norm(v):
        if isinstance(v, float):
            return "nan" if v != v else round(v, places) + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return v

    key = lambda r: repr([norm(v) for v in r])
    a, b = sorted(map(key, rows)), sorted(map(key, wanted))
    assert a == b, [(x, y) for x, y in zip(a, b) if x != y][:3] or (len(a), len(b))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(f"{DATA}/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def against_oracle(spark, duck, run, sql, sf="sf0.001"):
    df = run(spark, f"{DATA}/{sf}")
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    same([tuple(r[n] for n in order) for r in df.collect()], [tuple(r[names.index(n)] for n in order) for r in found.fetchall()])
