"""The queries beside their SQL, on whole tables."""

import harness
import pytest

from changeset.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_and_sql_agree(spark, name):
    assert harness.compare(spark, harness.connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) is None
