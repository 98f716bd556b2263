import pytest
from oracle import SF_DIR, compare

from pagewright.plans.queries import ORACLE_SQL, QUERIES

#: Queries whose last column is a verdict: fixtures must give both.
VERDICTS = ("md13_captions", "md14_list_items", "md16_code_like", "md25_page_number_lines", "tab17_numbers", "tab18_table_data", "tab20_footnotes", "lay6_chaos")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    rows = compare(spark, QUERIES[name], ORACLE_SQL[name])
    assert rows
    if name in VERDICTS:
        assert {v for r in rows for v in r if isinstance(v, bool)} == {True, False}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
