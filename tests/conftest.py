import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from stayline.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture()
def many_ranges(spark):
    """Keep every shuffle partition, so small frames are spread over several ranges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def scored(spark):
    """Rows placed on the offer, band and filter boundaries."""
    rows = [
        (1, "Lost", 0.9, 1, 50000.0, "PROMO"), (2, "Lost", 0.6, 1, 50000.01, "SMALL"),
        (3, "At-Risk", 0.7, 1, 30000.0, "LARGE"), (4, "At-Risk", 0.7000001, 1, 30000.0, None),
        (5, "Loyal", 0.35, 0, 60000.0, "PROMO"), (6, "Champions", 0.1, 0, 90000.0, "PROMO"),
        (7, None, 0.65, 1, 10000.0, "SMALL"), (8, "Lost", 0.5, 0, 20000.0, "LARGE"),
        (9, "At-Risk", 0.500001, 1, 5000.0, "SMALL"),
    ]
    return spark.createDataFrame(
        rows, "CustomerID long, Segment string, ChurnProb double, ChurnPred int, PredCLV double,"
              " PreferredCategory string").cache()
