import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sedge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "sedge-tests", 4)


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
