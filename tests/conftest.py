import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

FOLDER = f"/root/testdata/sf{os.environ.get('CORPUSFLOW_SF', '0.001')}"


@pytest.fixture(scope="session")
def spark():
    from corpusflow.session import build_session

    session = build_session("tests", 4, {
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="corpusflow-tests-"),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")
