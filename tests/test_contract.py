"""Driver contract: every registered query has oracle SQL, and entry() runs."""
import __spark_entry__ as E


def test_every_query_has_oracle_sql():
    from outcry.plans.queries import QUERIES
    q, o = E.queries(), E.oracle_sql()
    assert set(QUERIES) <= set(q) and set(QUERIES) <= set(o) and set(o) <= set(q)
    assert len(QUERIES) >= 80
    assert all(callable(f) for f in q.values())
    assert all(isinstance(s, str) and "SELECT" in s.upper() for s in o.values())


def test_entry_flagship_schema(spark):
    df = E.entry(spark)
    cols = df.columns
    assert cols[:2] == ["entity_id", "display_name"]
    assert {"score", "status", "z_score", "tier"} <= set(cols)
    assert df.count() == 5
