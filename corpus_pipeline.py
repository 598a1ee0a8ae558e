"""The corpus pipeline: quality, near duplicates, decontamination, mixture, token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``; the last returns what its files hold of
each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from histmerge.llm import jaccard, mix, quality, templates, tokens
from histmerge.llm.batches import table
from histmerge.llm.queries import token_digests, tokenizer_path
from histmerge.workspace import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, 80 percent."""
    return jaccard.keep_one(docs, Workspace(spark), words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"), Workspace(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them."""
    return mix.apply_mix(docs, Workspace(spark))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, and what they hold of each document."""
    found = tokens.write_and_read(docs, tokenizer_path(), Workspace(spark), most=100_000)
    return token_digests(found)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixture", mixture),
    ("token_files", token_files),
]

# Models, exact similarity groups and a tokenizer are beyond SQL; the tests hold
# the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written and read again."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
