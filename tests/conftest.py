"""One local session for all tests."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from quadra.session import local_session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return local_session(4)
