import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("VELDT_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("veldt-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", "/tmp/veldt-test-warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def graph(spark):
    from veldt import Graph

    def make(ids, edges, attributes=None):
        v = spark.createDataFrame([(i,) for i in ids], "id long")
        fields = "src long, dst long" + (f", {attributes}" if attributes else "")
        return Graph(v, spark.createDataFrame(edges, fields))

    return make


@pytest.fixture(scope="session")
def data():
    return SF
