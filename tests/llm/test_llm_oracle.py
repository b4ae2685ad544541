"""The queries of this subpackage that SQL can express, against DuckDB."""

import pytest
from oracle_check import compare

from tillroll.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, sf_dir, name):
    problems = compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name])
    assert not problems, problems
