import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from gleanframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("*", shuffle_partitions=8, name="gleanframe-tests")


@pytest.fixture
def spread(spark):
    """Keep every shuffle partition, so that multi-partition paths really run."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, old)
