import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len([n for n in q if not n.startswith("op") and n != "pipeline"]) >= 35
    assert entry.entry(spark).count() == 10
