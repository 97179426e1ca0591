"""Every query of the subpackage on the smallest tables; those with SQL against it."""

import pytest

from strandmill.llm import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
COLUMNS = {"p1_found": ["record_id_1", "record_id_2"], "p2_found": ["record_id_1", "record_id_2"], "p3_found": ["experiment", "record_id"], "p4_found": ["doc_id", "item_id"], "p5_found": ["record_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, same_as_sql):
    df = QUERIES[name](spark, small)
    assert df.count() > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in SQL:
        same_as_sql(df, SQL[name])
