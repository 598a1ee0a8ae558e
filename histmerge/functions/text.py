"""Text repair: stored text may hold bytes that are not valid UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from histmerge.functions.columns import as_col


def repair_text(text: str | Column) -> Column:
    """Text or bytes as a string, each malformed sequence as U+FFFD; NULL stays NULL."""
    return F.make_valid_utf8(as_col(text).cast("string"))


def repair_text_required(text: str | Column) -> Column:
    """As :func:`repair_text`, with NULL as the empty string."""
    return F.coalesce(repair_text(text), F.lit(""))
