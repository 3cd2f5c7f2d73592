import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from bookflow.session import build_session

    session = build_session("tests", "local[8]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(monkeypatch):
    """Chunks so small that every ordered operator crosses many chunk borders."""
    from bookflow.operators import ordered

    monkeypatch.setattr(ordered, "CHUNK", 37)


@pytest.fixture(scope="session")
def tables(spark):
    from catalog.adapters import Tables

    return Tables(spark, SF)
