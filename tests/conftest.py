import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pairlab.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("pairlab-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def tiny_tasks(spark):
    """Treat any key above 5 rows as too large for a task."""
    spark.conf.set("spark.pairlab.hotKeyRows", "5")
    yield spark
    spark.conf.unset("spark.pairlab.hotKeyRows")
