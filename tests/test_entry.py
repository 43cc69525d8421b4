import __spark_entry__ as E


def test_catalog():
    q, s = E.queries(), E.oracle_sql()
    assert len(q) > 80 and set(s) <= set(q)


def test_flagship(spark):
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        df = E.entry(spark)
        assert df.columns == ["query_id", "doc", "score"] and df.count() > 0
