import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def find(spark):
    """Entities of several texts in one job: ``find(texts) -> list of lists``."""
    from inkveil.operators.detect import detect

    def run(texts, **options):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        done = sorted(detect(rows, **options).select("i", "entities").collect())
        return [[(e.entity_type, e.original_text, e.start, e.end, round(e.score, 4)) for e in r.entities] for r in done]

    return run
