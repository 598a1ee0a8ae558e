"""The registered queries of this package: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histmerge.llm import (
    html, jaccard, langid, mix, quality, repeats, shards, spelling, templates, tokens, toxicity, urls,
    whiten,
)
from histmerge.llm.batches import table, with_columns
from histmerge.workspace import Workspace

#: The rules of the url query, each with its verdict.
RULES = [
    ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"),
]


def tokenizer_path() -> str:
    """The byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(folds: int, held: int):
    """Whether a document's fold, by its id as text, is the one held out."""
    number = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(number == held, F.lit(False))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_sources(table(spark, sf_dir, "documents"), Workspace(spark)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_columns(
        table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string", "lang": "string"}
    )
    found = langid.identify(docs, docs.where(~fold(4, 2)).select("text", "lang"))
    return found.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = with_columns(table(spark, sf_dir, "labels"), {"doc_id": "long", "toxic": "int"})
    weights = toxicity.fit(docs, labels.where(~fold(3, 1)))
    found = toxicity.score(docs, weights)
    return found.select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), Workspace(spark))
    # A cut can fall inside a character; its remaining bytes are shown as U+FFFD.
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark)
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = tokens.write_and_read(docs, tokenizer_path(), Workspace(spark), most=2_000_000)
    return token_digests(found)


def token_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(
        table(spark, sf_dir, "documents"), Workspace(spark), words=3, percent=90
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), Workspace(spark))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"), Workspace(spark))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(
        table(spark, sf_dir, "documents"), Workspace(spark), shards.layout(16)
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_mix_sources, op2_language_id, op3_toxicity, op4_suffix_dedup, op5_decontaminate,
        op6_quality_rules, op7_token_files, op8_url_filters, op9_ngram_jaccard, op10_html_text,
        op11_spelling_variants, op12_embedding_whitening, op13_sharding,
    ]
    return {f.__name__: f for f in found}
