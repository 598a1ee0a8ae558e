"""One local session for all tests, and short ways to make small tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from histmerge.sources.schema import META, ORIGINS, PLACES, VISITS, empty_table  # noqa: E402
from histmerge.sources.tables import (  # noqa: E402
    History,
    scan_origins,
    scan_places,
    scan_visits,
)
from histmerge.workspace import Workspace  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def work(spark):
    return Workspace(spark)


FIELDS = {f.name: f.type for f in [*VISITS, *ORIGINS, *PLACES]}


@pytest.fixture
def table(spark):
    """``table("id url", (1, "a"), ...)``: a DataFrame with the declared types."""

    def make(columns: str, *rows: tuple) -> DataFrame:
        names = columns.split()
        schema = T.StructType([T.StructField(n, FIELDS.get(n, T.LongType())) for n in names])
        return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)

    return make


@pytest.fixture
def history(spark, table):
    """A side from rows: origins, places and visits with the columns that matter."""

    def make(
        origins: list[tuple] = (), places: list[tuple] = (), visits: list[tuple] = ()
    ) -> History:
        return History(
            scan_origins(table("id prefix host frecency", *origins)),
            scan_places(
                table(
                    "id url url_hash visit_count hidden typed foreign_count last_visit_date"
                    " origin_id recalc_frecency frecency title guid",
                    *places,
                )
            ),
            scan_visits(table("id place_id visit_date visit_type session", *visits)),
            empty_table(spark, META),
        )

    return make


def place(
    id, url, hash, count=0, hidden=False, typed=0, fc=0, last=None, origin=None, flag=0, score=-1,
    title=None, guid=None,
):
    return (id, url, hash, count, hidden, typed, fc, last, origin, flag, score, title, guid)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows as sorted plain tuples."""
    found = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in found.collect()), key=repr)
