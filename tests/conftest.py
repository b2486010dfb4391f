import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from feedloom import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


def start():
    session = build_session(
        "local[8]",
        "tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


# Test modules name columns while they are imported, so the session comes first.
SESSION = start()


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def evaluate(spark):
    """Values of a column expression of `c` for a list of inputs."""

    def run(expression, values, kind="STRING"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i INT, c {kind}")
        found = rows.select("i", expression.alias("out")).orderBy("i").collect()
        return [r["out"] for r in found]

    return run
