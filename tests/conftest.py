"""One small local session for all tests."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    repo = str(Path(__file__).resolve().parent.parent)
    os.environ["PYTHONPATH"] = f"{repo}:{os.environ.get('PYTHONPATH', '')}"
    top = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(top / "warehouse"))
        .config("spark.checkpoint.dir", str(top / "shared"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(top, ignore_errors=True)
