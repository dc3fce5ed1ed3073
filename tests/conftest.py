from __future__ import annotations

import functools
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@functools.cache
def _session():
    from skein.session import local_session

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture
def spark():
    return _session()
