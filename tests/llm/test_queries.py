"""Every registered query of this subpackage against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from skein.llm import queries
from tests.test_queries import FOLDER, check, duck  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    check(spark, duck, name, {"p10_limits"})  # a hundred texts pile up nowhere
