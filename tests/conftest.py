import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tapewell.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_chunks(spark):
    """Chunks of a few rows, so that every carry and halo is exercised."""
    spark.conf.set("spark.tapewell.chunk.rows", "7")
    spark.conf.set("spark.tapewell.chain.rows", "5")
    yield
    spark.conf.unset("spark.tapewell.chunk.rows")
    spark.conf.unset("spark.tapewell.chain.rows")
