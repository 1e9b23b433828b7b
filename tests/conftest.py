"""One local session for all tests; the repository's top is importable."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(TOP))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from vellum.runtime import ship

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    at = Path("/root/testdata/sf0.001")
    if not at.exists():
        pytest.skip("no test data")
    return str(at)
