import signal
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))

from tallyglass.session import SETTINGS  # noqa: E402


#: Seconds that a test may take.
LIMIT = 300


@pytest.fixture(autouse=True)
def time_limit():
    """A test that does not end fails, and the others go on."""

    def late(*_):
        raise TimeoutError(f"the test took more than {LIMIT} seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(LIMIT)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
