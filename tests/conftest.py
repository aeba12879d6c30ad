import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from servicelens.session import SETTINGS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "4g")
               .config(map=SETTINGS).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows("a string, b int", ("x", 1), …) -> DataFrame"""
    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return make


def cells(df, *columns):
    """The rows as tuples, in order."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
