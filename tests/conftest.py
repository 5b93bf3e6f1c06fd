import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siftwell.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("8", "tests", **{"spark.checkpoint.dir": f"file://{shared}"})
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
