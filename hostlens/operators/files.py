"""File-metadata (bodyfile) selections: FIL-1..6 and FIL-9 as DataFrame filters.

All are ``where`` clauses on columns of the ``bodyfile`` table, so on Parquet
input they push down to the scan where the predicate allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import contains_any, glob_to_regex

def is_executable():
    return F.col("mode").contains("x")


def is_setuid():
    return F.lower(F.col("mode")).contains("s")


def is_directory():
    return F.col("mode").startswith("d")


def executables(bf: DataFrame) -> DataFrame:
    """Executable entries that are not directories."""
    return bf.where(is_executable() & ~is_directory())


def setuid_files(bf: DataFrame) -> DataFrame:
    """Mode contains 's' in any case (setuid, setgid, and socket types too)."""
    return bf.where(is_setuid())


def directories(bf: DataFrame) -> DataFrame:
    return bf.where(is_directory())


def files_with_hash(bf: DataFrame) -> DataFrame:
    return bf.where(~F.col("md5").isin("0", ""))


def filter_by_path(bf: DataFrame, pattern: str) -> DataFrame:
    """FIL-5: case-sensitive glob on the full path ('*' also crosses '/')."""
    return bf.where(F.col("name").rlike(glob_to_regex(pattern)))


def filter_by_timerange(bf: DataFrame, start=None, end=None, time_type: str = "mtime") -> DataFrame:
    """FIL-6: entries whose ``time_type`` lies in [start, end]; times <= 0 are dropped."""
    if time_type not in ("atime", "mtime", "ctime", "crtime"):
        raise ValueError(f"unknown time column {time_type}")
    t = F.col(time_type)
    cond = t > 0
    if start is not None:
        cond = cond & (F.timestamp_seconds(t) >= F.lit(start).cast("timestamp"))
    if end is not None:
        cond = cond & (F.timestamp_seconds(t) <= F.lit(end).cast("timestamp"))
    return bf.where(cond)


def suspicious_locations(bf: DataFrame) -> DataFrame:
    """FIL-9: paths under temp folders or with a hidden component."""
    return bf.where(contains_any("name", rules.SUSPICIOUS_LOCATION_MARKERS))
