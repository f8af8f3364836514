from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Documents from texts or (id, text) pairs; other columns null unless given."""

    def make(*rows, source="s"):
        full = []
        for i, row in enumerate(rows):
            doc_id, text = row if isinstance(row, tuple) else (i, row)
            full.append((doc_id, text, None, source, None))
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture
def clashing(documents):
    """The same with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    def make(*rows):
        docs = documents(*rows)
        names = "digest keep_id group_size kept size bin place copies count key node class_id score base terms"
        return docs.withColumns({n: F.lit("x") for n in names.split()})

    return make
