from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from postroom.session import build_session, ship_package  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# Column expressions at module level need a running session.
_SPARK = build_session(
    "tests",
    "local[8]",
    **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"},
)
_SPARK.sparkContext.setLogLevel("ERROR")
ship_package(_SPARK)


@pytest.fixture(scope="session")
def spark():
    return _SPARK


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture
def column(spark):
    """Apply a column expression to a list of values, keeping their order."""

    def run(values, expression, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return run
