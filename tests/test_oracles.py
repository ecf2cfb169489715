import pytest

from folioflow.plans import catalogue
from tests.compare import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_what_its_sql_gives(spark, sf_dir, name):
    found = spark_rows(catalogue.QUERIES[name](spark, sf_dir))
    assert len(set(found[0])) == len(found[0])
    if name in catalogue.ORACLE_SQL:
        assert found == oracle(catalogue.ORACLE_SQL[name], sf_dir)
    else:
        assert found[1]


def test_entry_imports_and_names_all_queries():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
