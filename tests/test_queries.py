"""Each registered query of the engine against its SQL."""

import pytest

from conftest import duck, same_rows
from lodestone.plans import queries


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, small, con, name):
    assert same_rows(queries.QUERIES[name](spark, small), queries.SQL[name], con)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_retrieve_finds_the_section_asked_for(spark, small):
    rows = queries.QUERIES["engine_retrieve"](spark, small).collect()
    assert {r.query_id for r in rows} == set(range(25))
    found = {(r.query_id, r.section_key.split("_")[-1]) for r in rows}
    # one-digit numbers are no tokens, so only the others tell nations apart
    assert all((q, str(q)) in found for q in range(10, 25))
