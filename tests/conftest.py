from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gaugeworks.contract import default_contract  # noqa: E402
from gaugeworks.session import build_session, shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        spark_master="local[4]",
        spark_sql_shuffle_partitions="2",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
        # A handful of rows per test: compiling code for them takes longer than interpreting.
        spark_sql_codegen_wholeStage="false",
        spark_sql_codegen_factoryMode="NO_CODEGEN",
    )
    session.sparkContext.setLogLevel("ERROR")
    shared_folder(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def contract():
    return default_contract()
