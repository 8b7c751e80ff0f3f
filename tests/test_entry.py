"""The driver's contract."""

import __spark_entry__


def test_entry(spark):
    rows = {r["tier"]: r["n"] for r in __spark_entry__.entry(spark).collect()}
    assert set(rows) == {"gold", "base"} and sum(rows.values()) == 6000


def test_names():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) >= 130
    assert all(callable(q) for q in names.values())
