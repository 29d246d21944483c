import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailgrain.session import prepare  # noqa: E402
from tests.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = prepare(session())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield spark
    spark.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over literal inputs: one row, one value."""
    from pyspark.sql import functions as F

    def run(build, *values):
        columns = [v if not isinstance(v, (str, int, float, type(None))) else F.lit(v) for v in values]
        return spark.range(1).select(build(*columns).alias("v")).head()["v"]

    return run
