from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kbspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(params=[0, 5, 1_000_000], ids=["all-hot", "some-hot", "none-hot"])
def hot_rows(request, monkeypatch):
    """Thresholds that put every key, some keys and no key on the bucketed path."""
    from kbspark.operators import ordered

    monkeypatch.setattr(ordered, "HOT_ROWS", request.param)
    return request.param
