"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from plumbline import catalogue
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    if name in catalogue.ORACLE_SQL:
        assert not differences(df, con, catalogue.ORACLE_SQL[name])
    else:
        assert df.count() > 0 and len(df.columns) == len(set(df.columns))
