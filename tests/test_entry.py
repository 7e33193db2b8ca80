import os

import pytest
import __spark_entry__ as entry
import check


def test_every_query_has_sql_or_is_known_without():
    own = {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"}
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


# The operators of the optional subpackage have tests of their own.
SF_DIR = "/root/testdata/sf0.01"
OWN = sorted(q for q in entry.queries() if not q.startswith("op") and q != "pipeline")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, name):
    out = check.compare(spark, check.database(SF_DIR), name, SF_DIR)
    assert out.startswith(("ok", "rows only")), out
