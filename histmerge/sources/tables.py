"""The three history tables (plus metadata) of one side, read from any source."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from histmerge.functions.keys import ORIGIN_KEY, PLACE_KEY, VISIT_KEY
from histmerge.sources.schema import META, ORIGINS, PLACES, TABLES, VISITS, conform, empty_table


class SameSideError(ValueError):
    """Source and destination are the same tables."""


@dataclass(frozen=True)
class History:
    """One side: lazily read tables of the declared schemas."""

    origins: DataFrame
    places: DataFrame
    visits: DataFrame
    meta: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"origins": self.origins, "places": self.places, "visits": self.visits}

    def mapped(self, change: Callable[[str, DataFrame], DataFrame]) -> History:
        """The same side with every table passed through ``change(name, table)``."""
        return History(*[change(name, getattr(self, name)) for name in TABLES])


def scan_origins(df: DataFrame) -> DataFrame:
    return conform(df, ORIGINS)


def scan_places(df: DataFrame) -> DataFrame:
    return conform(df, PLACES)


def scan_visits(df: DataFrame) -> DataFrame:
    return conform(df, VISITS)


def scan_meta(df: DataFrame) -> DataFrame:
    return conform(df, META)


def read_history(
    spark: SparkSession,
    root: str,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
    names: dict[str, str | None] | None = None,
) -> History:
    """Read one side from ``root/<table>`` with any Spark data source.

    ``names`` gives another folder or table name per table, or None for metadata
    that is not there. A ``jdbc`` source takes its table names from ``names``
    and the rest from ``options``.
    """
    names = {**{t: t for t in TABLES}, **(names or {})}
    reader = spark.read.format(fmt).options(**(options or {}))

    def load(table: str) -> DataFrame:
        if fmt == "jdbc":
            return reader.option("dbtable", names[table]).load()
        return reader.load(f"{root.rstrip('/')}/{names[table]}")

    meta = scan_meta(load("meta")) if names["meta"] else empty_table(spark, META)
    return History(
        scan_origins(load("origins")), scan_places(load("places")), scan_visits(load("visits")), meta
    )


def empty_history(spark: SparkSession) -> History:
    """A destination that does not exist yet."""
    return History(*[empty_table(spark, fields) for fields in TABLES.values()])


def seed_keys(dst: History) -> dict[str, DataFrame]:
    """The key columns and ids a merge compares against, and nothing more."""
    return {
        "origins": dst.origins.select(*ORIGIN_KEY, "id"),
        "places": dst.places.select(*PLACE_KEY, "id"),
        "visits": dst.visits.select(*VISIT_KEY),
    }


def _resolved(location: str) -> tuple[str, str, str]:
    parts = urlsplit(location)
    scheme = "" if parts.scheme == "file" else parts.scheme
    return scheme, parts.netloc, posixpath.normpath("/" + parts.path.lstrip("/"))


def refuse_same_side(src: str, dst: str) -> None:
    """Raise when two locations (paths or table names) are the same place."""
    if _resolved(src) == _resolved(dst):
        raise SameSideError(f"source and destination are both {src}")
