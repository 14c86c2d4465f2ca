import __spark_entry__


def test_keys_and_entry(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 30
    assert __spark_entry__.entry(spark).limit(1).count() == 1
