import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from plumbline.session import get_session

    session = get_session(
        "plumbline-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def read(spark):
    from plumbline.workload.registry import Tables

    return Tables(spark, SF_DIR)


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of plain tuples."""

    def collect(df, *names):
        chosen = df.select(*names) if names else df
        return sorted((tuple(r) for r in chosen.collect()), key=repr)

    return collect
