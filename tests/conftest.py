import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from foliant.session import build_session

    s = build_session("tests", **{
        "spark.master": "local[8]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
    })
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over one row of named string values."""
    from pyspark.sql import functions as F

    def run(column, **values):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
        return row.select(column.alias("out")).first()["out"]

    return run
