import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tarnish.session import local_session  # noqa: E402
from tarnish.sources.silver import silver  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


@pytest.fixture(scope="session")
def features(spark):
    return silver(spark, SF).cache()


def rows(df, *order):
    """Rows as plain tuples in a stated order."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
