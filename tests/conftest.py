import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": 8,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tmp_path_factory.mktemp("checkpoints"),
            "spark.sql.warehouse.dir": tmp_path_factory.mktemp("warehouse"),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def always_big(monkeypatch):
    """Take every path meant for inputs beyond one task."""
    import tidemark.session as session

    for name, module in list(sys.modules.items()):
        if name.startswith("tidemark") and hasattr(module, "fits_one_task"):
            monkeypatch.setattr(module, "fits_one_task", lambda *dfs: False)
    monkeypatch.setattr(session, "fits_one_task", lambda *dfs: False)
    from tidemark.operators import asof, skew

    monkeypatch.setattr(asof, "ONE_TASK_BYTES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 0)
