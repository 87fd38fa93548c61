import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import build_session

    spark = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.default.parallelism": "4"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
