import __spark_entry__
from fabula.plans import queries


def test_every_sql_belongs_to_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
