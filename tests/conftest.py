import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("linkaudit-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def links_of(spark):
    """Canonical links from tuples (source, destination, anchor[, origin, path, link_type])."""

    def make(rows):
        padded = [(*r, *("",) * (6 - len(r))) for r in rows]
        return spark.createDataFrame(
            padded, "source string, destination string, anchor string, origin string, path string, link_type string"
        )

    return make
