from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from portrisk.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="portrisk-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from portrisk.session import scratch_path
    return lambda name="t": scratch_path(spark, name)


def rows(df, *cols):
    """Collect selected columns as a sorted list of tuples (None-safe order)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()),
                  key=lambda t: tuple((x is None, 0 if x is None else x) for x in t))
