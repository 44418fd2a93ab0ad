import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from markbook.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "4", shuffle_partitions=4, shared=tmp_path_factory.mktemp("shared").as_uri())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Run a column function over texts and return the values in order."""
    from pyspark.sql import functions as F

    def run(function, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
        rows = df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
        return [r["y"] for r in rows]

    return run
