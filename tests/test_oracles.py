"""Every registered query of the engine against its SQL."""

import pytest
from conftest import DATA, against_oracle

from brindle.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, duck):
    against_oracle(spark, duck, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(name, spark):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_sketches_are_close(spark):
    d = f"{DATA}/sf0.01"
    exact, sketch = (QUERIES[f"m_cardinality_{k}"](spark, d).first()["n"] for k in ("exact", "sketch"))
    assert abs(exact - sketch) <= 0.05 * exact
    p = QUERIES["m_percentiles_sketch"](spark, d).first()
    e = QUERIES["m_percentiles_exact"](spark, d).first()
    assert abs(p["p.50.0"] - e["p50"]) <= 0.03 * (p["p.99.0"] - p["p.1.0"])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
