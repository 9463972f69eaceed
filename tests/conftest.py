import math
import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


def spiral(wrap, theta, z, tilt=0.0, spacing=20.0, r0=100.0):
    """Radius on a spiral of the given wrap."""
    return r0 + spacing * (wrap + theta / (2 * math.pi)) + tilt * z
