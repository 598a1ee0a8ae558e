"""Helpers shared by the expression builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: str | Column) -> Column:
    """A column by name, or the column itself."""
    return F.col(value) if isinstance(value, str) else value
