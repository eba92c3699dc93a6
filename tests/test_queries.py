"""Every registered query of the evidence engine against its SQL oracle."""

import pytest
from conftest import plain

from claimweave.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    if name not in registry.ORACLE_SQL:  # held against cases worked by hand in test_case_chains
        assert name == "case_chains" and df.count() > 0
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    got = plain([r.asDict() for r in df.collect()], columns)
    assert got == plain([dict(zip(want.columns, r)) for r in want.fetchall()], columns)
