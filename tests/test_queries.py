"""Every query of the core against its SQL on the smallest tables."""

import pytest
from oracle import same

from echolith.plans import history_queries, queue_queries, search_queries

FOLDER = "/root/testdata/sf0.001"
MODULES = [history_queries, search_queries, queue_queries]
WITH_SQL = [(m, n) for m in MODULES for n in m.SQL]
WITHOUT = [(m, n) for m in MODULES for n in m.QUERIES if n not in m.SQL]


@pytest.mark.parametrize(("module", "name"), WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_equals_sql(spark, module, name):
    same(spark, FOLDER, module.QUERIES[name], module.SQL[name])


@pytest.mark.parametrize(("module", "name"), WITHOUT, ids=[n for _, n in WITHOUT])
def test_has_rows(spark, module, name):
    assert module.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
