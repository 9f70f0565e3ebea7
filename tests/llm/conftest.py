import pytest

from quorumlens.llm import common


@pytest.fixture(autouse=True)
def released():
    """No test keeps the tables of another in memory."""
    yield
    common.release()
