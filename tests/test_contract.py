import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_flagship(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and {"t", "n_obs", "n_reduce"} <= set(df.columns)
    assert all(r.n_increase + r.n_hold + r.n_reduce == r.n_obs for r in rows)
