"""Merged tables published under one folder, all of them by one Spark write.

The folder is one Parquet dataset, partitioned by table, by part and by run
(``published_table=places/published_part=3/published_run=0``). A run is published
by a single ``overwrite`` in Spark's dynamic partition mode: Spark stages all
files, and only partitions that the write holds rows for are exchanged, when all
tasks are done. A failed run leaves the folder as it was.

* Tables that change in place are cut by ranges of ids; a run writes the ranges
  it changed and no others (``published_run`` is 0).
* Tables that grow are cut by ranges of a date; a run adds partitions of its own
  number and neither reads nor writes older rows.
* ``state`` holds one row per table: row count, largest id and the number of the
  last run. It is written with the rest, so the next run asks it, not the tables.

One writer at a time: a run claims the folder before it reads anything, and
whoever finds another claim there gives way. Claims are named by their writers,
so of two that come at the same instant each sees the other's, and never do both
go on. A claim that a lost driver left is removed with ``release``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmerge.operators.measure import Asked, measure
from histmerge.sources.schema import TABLES, struct_type

TABLE, PART, RUN = "published_table", "published_part", "published_run"
TASK = "_task"
CLAIMS = "_claims"
STATE = "state"
STATE_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("largest_id", T.LongType()),
        T.StructField("last_run", T.LongType()),
    ]
)
DAY_US = 86_400_000_000
#: Rows that one task of a publication sorts and writes, more or less.
TASK_ROWS = 1_000_000


class BusyError(RuntimeError):
    """Another writer has the publication."""


@dataclass(frozen=True)
class Cut:
    """How a table is partitioned: ranges of ``size`` values of a column.

    ``grows`` marks a table whose rows never change, so that runs only add some.
    """

    column: str | None = None
    size: int = 1
    grows: bool = False


#: Rows of a range of ids, and days of a range of dates.
CUTS = {
    "origins": Cut("id", 1_000_000),
    "places": Cut("id", 1_000_000),
    "visits": Cut("visit_date", 30 * DAY_US, grows=True),
    "meta": Cut(),
}


@dataclass(frozen=True)
class TableState:
    """What is known of a published table without reading it."""

    rows: int = 0
    largest_id: int = 0


class Publication:
    """A folder of published tables."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schemas: Mapping[str, T.StructType] | None = None,
        cuts: Mapping[str, Cut] | None = None,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schemas = dict(schemas or {name: struct_type(f) for name, f in TABLES.items()})
        self.cuts = {**CUTS, **(cuts or {})}

    # Reading

    def _held(self, table: str, schema: T.StructType) -> DataFrame | None:
        """A table with its partition columns, None before anything of it is published."""
        parts = [T.StructField(PART, T.LongType()), T.StructField(RUN, T.LongType())]
        path, files = self._files(f"{TABLE}={table}")
        if not files.exists(path):
            return None
        return self.spark.read.schema(T.StructType([*schema.fields, *parts])).parquet(
            f"{self.root}/{TABLE}={table}"
        )

    def has(self, table: str) -> bool:
        """Whether any published run wrote the table."""
        return table in self.state()

    def read(self, table: str) -> DataFrame:
        """A published table, empty before its first run."""
        schema = self.schemas[table]
        held = self._held(table, schema)
        return self.spark.createDataFrame([], schema) if held is None else held.select(*schema.names)

    def read_parts(self, table: str, parts: list[int]) -> DataFrame:
        """Some parts of a published table; files of others are not opened."""
        schema = self.schemas[table]
        held = self._held(table, schema)
        if held is None:
            return self.spark.createDataFrame([], schema)
        return held.where(F.col(PART).isin(parts)).select(*schema.names)

    def read_between(self, table: str, low: int | None, high: int | None) -> DataFrame:
        """Rows by a range of the cut's column; files outside its parts are not opened."""
        cut, schema = self.cuts[table], self.schemas[table]
        held = self._held(table, schema)
        if held is None or low is None or high is None:
            return self.spark.createDataFrame([], schema)
        inside = F.col(PART).between(low // cut.size, high // cut.size)
        return held.where(inside & F.col(cut.column).between(low, high)).select(*schema.names)

    def state(self) -> dict[str, TableState]:
        """Rows and largest id of each published table."""
        held = self._held(STATE, STATE_SCHEMA)
        found = [] if held is None else held.collect()  # one row per table
        return {r["table_name"]: TableState(r["rows"], r["largest_id"]) for r in found}

    def current(self) -> int:
        """Number of the last published run, 0 before the first."""
        held = self._held(STATE, STATE_SCHEMA)
        return 0 if held is None else held.agg(F.coalesce(F.max("last_run"), F.lit(0))).first()[0]

    # Writing

    def _files(self, *steps: str):
        """A path below the root and its file system, whatever store that is."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *steps]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def claims(self) -> list[str]:
        """Names of the writers that have claimed the folder."""
        path, files = self._files(CLAIMS)
        if not files.exists(path):
            return []
        return sorted(status.getPath().getName() for status in files.listStatus(path))

    def release(self, writer: str) -> None:
        """Remove a claim: one's own, or that of a writer known to be gone."""
        path, files = self._files(CLAIMS, writer)
        files.delete(path, False)

    @contextmanager
    def claimed(self, writer: str) -> Iterator[str]:
        """Hold the folder while merging into it; raise if another writer does."""
        path, files = self._files(CLAIMS, writer)
        files.create(path, False).close()  # fails if this very name has a claim
        try:
            if others := [w for w in self.claims() if w != writer]:
                raise BusyError(f"{self.root} is claimed by {', '.join(others)}")
            yield writer
        finally:
            files.delete(path, False)

    def part_of(self, table: str):
        """The part a row belongs to, as an expression."""
        cut = self.cuts[table]
        if cut.column is None:
            return F.lit(0).cast("long")
        return F.expr(f"({cut.column} - pmod({cut.column}, {cut.size}L)) div {cut.size}L")

    def publish(
        self,
        tables: Mapping[str, DataFrame],
        state: Mapping[str, TableState] | None = None,
        writer: str | None = None,
    ) -> int:
        """Write rows of a run, with what is then known of its tables, all at once.

        ``tables`` has whole parts of the tables that change in place, and the new
        rows of those that grow. Give it written tables: their parts are counted, and
        their rows are moved once, so that each part becomes files of its own. Without ``state`` they are counted,
        and those that change in place are whole; without ``writer`` the folder is
        claimed for this write.
        """
        if writer is None:
            with self.claimed(uuid.uuid4().hex) as writer:
                return self.publish(tables, state, writer)
        if self.claims() != [writer]:
            raise BusyError(f"{self.root} is not claimed by {writer}")
        if state is None:
            found = measure({n: Asked(df) for n, df in tables.items() if "id" in df.columns})
            held = {n: s for n, s in self.state().items() if self.cuts[n].grows}
            state = {
                n: TableState(m.rows + s.rows, max(m.largest_id, s.largest_id))
                for n, m in found.items()
                for s in [held.get(n, TableState())]
            }
        run = self.current() + 1
        self._clear(run)
        placed = [
            df.select(
                F.lit(name).alias(TABLE),
                self.part_of(name).alias(PART),
                F.lit(run if self.cuts[name].grows else 0).cast("long").alias(RUN),
                *self.schemas[name].names,
            )
            for name, df in tables.items()
        ]
        known = [(n, s.rows, s.largest_id, run) for n, s in {**self.state(), **state}.items()]
        zero = F.lit(0).cast("long")
        noted = self.spark.createDataFrame(known, STATE_SCHEMA).select(
            F.lit(STATE).alias(TABLE), zero.alias(PART), zero.alias(RUN), *STATE_SCHEMA.names
        )
        rows = self._dealt(placed, noted).write.mode("overwrite")
        rows = rows.option("partitionOverwriteMode", "dynamic").partitionBy(TABLE, PART, RUN)
        rows.parquet(self.root)
        return run

    def _dealt(self, placed: list[DataFrame], noted: DataFrame) -> DataFrame:
        """All rows of a run in tasks of about ``TASK_ROWS`` rows, as a task sorts what it writes.

        The parts lie one after the other, each as long as it has rows, and every
        ``TASK_ROWS`` of that line are a task: small parts share one, a large one is
        cut into several files. A row's place within its part is drawn by its hash.
        """
        parts = reduce(DataFrame.unionAll, [df.select(TABLE, PART) for df in placed])
        counted = parts.groupBy(TABLE, PART).agg(F.count(F.lit(1)).alias("rows"))
        starts, total = [], 0
        for r in counted.collect():  # one row per part
            starts.append((r[TABLE], r[PART], total, r["rows"]))
            total += r["rows"]
        known = self.spark.createDataFrame(
            starts, "_table string, _part bigint, _start bigint, _rows bigint"
        )
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*placed, noted])
        drawn = F.shiftrightunsigned(F.xxhash64(*union.columns), 11) / F.lit(float(1 << 53))
        task = F.floor((F.col("_start") + drawn * F.col("_rows")) / F.lit(TASK_ROWS))
        same = F.expr(f"{TABLE} = _table AND {PART} <=> _part")
        # Rows of the state belong to no part that was counted; without a number they
        # go to the first task.
        rows = union.join(F.broadcast(known), same, "left").select(
            *union.columns, task.cast("int").alias(TASK)
        )
        tasks = max(1, -(-total // TASK_ROWS))
        return rows.repartitionById(tasks, TASK).drop(TASK)

    def _clear(self, run: int) -> None:
        """Remove what a driver lost while publishing left under a number never reached."""
        path, files = self._files(f"{TABLE}=*", f"{PART}=*", f"{RUN}={run}")
        for status in files.globStatus(path) or []:
            files.delete(status.getPath(), True)
