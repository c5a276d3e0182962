import pytest

from effortlens.plans import registry
from tests.compare import SF, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_agrees_with_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck_rows(registry.ORACLE[name])


def test_identity_health_by_hand(spark):
    rows = {r["health"]: (r["resolved"], r["unresolved"]) for r in registry.QUERIES["identity_health"](spark, SF).collect()}
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert sum(a + b for a, b in rows.values()) == suppliers
    assert rows.get("healthy", (0, 0))[1] == 0 and rows.get("unresolved", (0, 0))[0] == 0
