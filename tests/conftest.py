from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hostlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4, app_name="hostlens-tests")
    yield s
    s.stop()


def lines_df(spark, text: str, source_file: str = "f.txt", collection_id: str = "c1"):
    """A lines frame from literal text (0-based line numbers, like the file reader)."""
    rows = [(collection_id, source_file, i, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "collection_id string, source_file string, line_no bigint, line string")


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("line_no").collect()]
