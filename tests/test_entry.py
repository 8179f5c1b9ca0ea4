"""Driver contract: entry smoke and registry consistency."""

import __spark_entry__ as se


def test_entry_smoke(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["feature", "fold", "gini"]


def test_every_oracle_has_a_query():
    qs, orc = se.queries(), se.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 80
