from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]

from helpers import NOW, SECOND, log_row

from loomlog.schema import LOGS
from loomlog.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed_rows(spark):
    """Two rows of tenant a, one of tenant b, all of service ledger."""
    common = {"attrs": {"env": "lab"}, "resource": {"region": "north-3"}}
    rows = [
        log_row("a", NOW - SECOND, "ERROR", trace="5a" * 16, span="5a" * 8,
                body="posting 17 rejected: period closed", **common),
        log_row("a", NOW, "INFO", trace="c7" * 16, span="c7" * 8,
                body="posting 18 booked", **common),
        log_row("b", NOW, "ERROR", trace="9e" * 16, span="9e" * 8,
                body="posting 17 rejected: period closed", **common),
    ]
    return spark.createDataFrame(rows, LOGS)
