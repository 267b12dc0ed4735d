import __spark_entry__ as E


def test_registry_and_oracles_align():
    q, o = E.queries(), E.oracle_sql()
    assert q and set(o) <= set(q)
    assert "hybrid_topk" in q


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.limit(50).collect()
    assert df.columns[:3] == ["request_id", "rank", "product_id"]
    assert len(rows) > 0
