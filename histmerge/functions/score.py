"""The decayed visit score and the scalar rules it is built from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from histmerge.functions.columns import as_col

# Fixed values of the score.
MICROS_PER_DAY = 86_400_000_000.0
VISIT_WEIGHT = 1000.0
NEVER_VISITED = -1


def whole_seconds(now_us: int) -> int:
    """``now`` in microseconds, cut to the second, as ages are measured."""
    return now_us // 1_000_000 * 1_000_000


def age_days(now_us: int, last_visit: str | Column = "last_visit_date") -> Column:
    """Days from a UTC microsecond time to ``now``, as a fraction."""
    return (F.lit(whole_seconds(now_us)) - as_col(last_visit)) / F.lit(MICROS_PER_DAY)


def decayed_score(
    now_us: int,
    visit_count: str | Column = "visit_count",
    last_visit: str | Column = "last_visit_date",
) -> Column:
    """Visits per age, cut toward zero; -1 where nothing was ever visited.

    A last visit exactly one day in the future leaves no defined score: NULL,
    which the table contract refuses when the row is published.
    """
    count, last = as_col(visit_count), as_col(last_visit)
    raw = F.try_divide(count * F.lit(VISIT_WEIGHT), age_days(now_us, last) + F.lit(1.0))
    return F.when(last.isNull() | (count == 0), F.lit(NEVER_VISITED).cast("bigint")).otherwise(
        raw.cast("bigint")
    )


def later_of(a: str | Column, b: str | Column) -> Column:
    """The later of two dates; a missing one gives way to the other."""
    return F.greatest(as_col(a), as_col(b))
