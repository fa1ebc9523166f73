import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from sparksymbols.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate SQL or a column on a single row."""
    from pyspark.sql import functions as F

    def value(expr, **columns):
        row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()), F.lit(0).alias("_"))
        return row.select((F.expr(expr) if isinstance(expr, str) else expr).alias("x")).first()["x"]

    return value
