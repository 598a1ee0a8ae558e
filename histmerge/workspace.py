"""Intermediate tables of one run, written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (a test, a laptop) gets a
    temporary folder; on a cluster a machine-local folder would lose the tables
    with the machine, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="histmerge-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Workspace:
    """Names the written tables of one run.

    A written table cuts the lineage like a checkpoint does, survives the loss
    of executors, and keeps what a checkpoint loses: column pruning, row counts
    from file footers, and a known size, which decides about broadcasts.
    """

    def __init__(self, spark: SparkSession, run_id: str | None = None):
        self.spark = spark
        self.run_id = run_id or uuid.uuid4().hex
        self.root = f"{shared_folder(spark)}/histmerge/{self.run_id}"

    def keep_path(self, name: str) -> str:
        """A new folder for one step of this run.

        The short random suffix lets one run take the same step twice (two
        merges of two tables) without ever replacing an earlier table.
        """
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        path = self.keep_path(name)
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_observed(
        self, df: DataFrame, name: str, **metrics: Column
    ) -> tuple[DataFrame, dict[str, object]]:
        """Like ``keep``, with aggregates of ``df`` that the same write gathers."""
        seen = Observation(name)
        kept = self.keep(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), name)
        return kept, seen.get
