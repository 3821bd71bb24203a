import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logsluice import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("logsluice-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def column(spark):
    """Values of an expression over a list of texts."""

    def run(texts, fn):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        from pyspark.sql import functions as F

        return [r.v for r in rows.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]

    return run
