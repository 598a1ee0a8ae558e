"""Spelling variants: words one edit apart, found in a reduced alphabet.

Letters are hashed to a few symbols, which turns each word of the vocabulary
into a reduced word. Words one edit apart have reduced words at most one edit
apart, so for each word all reduced words within one edit are made (deletions,
replacements, insertions, itself), joined with the reduced vocabulary, and what
meets is compared as it was written. A word's form is its most frequent near
word if that is far more frequent; its root is where the forms end.

Reduced words are 64-bit hashes of their symbols, and an edit changes a hash by
a difference of two prefix sums, so the neighbourhood of a word is made without
making its strings. A bitmap of fixed size sifts it by the reduced vocabulary
before anything is exchanged; the join and the comparison decide, so neither a
collision nor a full bitmap changes a result.

Defined results: null and empty texts have no words; a null id counts as the
empty text in the hash that damages words; repeated rows count each time; an
empty table gives an empty result. Further columns are ignored. Words of any
length are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histmerge.llm.batches import BASE, INVERSE, distinct_by_row, map_batches, mix, with_columns
from histmerge.llm.marks import bitmap, marked
from histmerge.operators.lookup import lookup
from histmerge.workspace import Workspace

#: Symbols that letters are hashed to.
SYMBOLS = 8
#: The letters of a word once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Least code points of a word, least occurrences, how often every so many runs
#: lose a letter, and how many times more frequent than a word its form is.
LEAST_LETTERS, LEAST_COUNT, DAMAGED, RATIO = 7, 2, 31, 10
#: Hashes of neighbours that a task holds at once.
HELD = 1 << 20

_random = np.random.Generator(np.random.PCG64(20260311))
_VALUES = _random.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The symbol of each Latin-1 letter.
_SYMBOL_OF = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)) % np.uint64(SYMBOLS)


def damaged(doc_id: Column, run: Column) -> Column:
    """A run without one of its letters if the hash of it and its document says so."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h, at = F.crc32(key.cast("binary")), F.length(run)
    at = F.pmod(h, at).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % DAMAGED == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: words of enough letters that occur often enough."""
    plain = with_columns(docs, {"doc_id": "long", "text": "string"})
    lowered = F.translate("text", UPPER, UPPER.lower())
    # A run that is too short stays so without a letter.
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))
    found = plain.select("doc_id", F.explode(runs).alias("run"))
    words = found.select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.where(F.col("n") >= LEAST_COUNT)


class Reduced:
    """Words of one length as rows of symbols, with the prefix sums of their hashes."""

    def __init__(self, words: list[bytes]):
        self.rows, self.length = len(words), len(words[0])
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(self.rows, self.length)
        self.symbols = _SYMBOL_OF[letters].astype(np.int64)
        self.up = np.full(self.length + 2, BASE, np.uint64)
        self.up[0] = 1
        self.up = np.multiply.accumulate(self.up)
        self.sums = np.zeros((self.rows, self.length + 1), np.uint64)
        np.cumsum(_VALUES[self.symbols] * self.up[: self.length], axis=1, out=self.sums[:, 1:])

    def _done(self, sums: np.ndarray, length: int) -> np.ndarray:
        return mix(sums + np.uint64(length)).reshape(self.rows, -1)

    def hashes(self) -> np.ndarray:
        return self._done(self.sums[:, -1], self.length)[:, 0]

    def near(self) -> Iterator[np.ndarray]:
        """Hashes of all reduced words within one edit, some positions at a time."""
        yield self.hashes()[:, None]
        size, total = self.length, self.sums[:, -1:]
        step = max(1, HELD // (self.rows * (2 * SYMBOLS + 1)))
        for lo in range(0, size + 1, step):
            at = np.arange(lo, min(lo + step, size + 1))
            before, up = self.sums[:, at], self.up[at]
            added = before + (total - before) * np.uint64(BASE)
            yield self._done(added[:, :, None] + _VALUES * up[:, None], size + 1)
            at = at[at < size]
            if not len(at):
                continue
            before, up = before[:, : len(at)], up[: len(at)]
            after = total - self.sums[:, at + 1]
            yield self._done(before + after * np.uint64(INVERSE), size - 1)
            yield self._done((before + after)[:, :, None] + _VALUES * up[:, None], size)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Reduced]]:
    """A batch's rows by the length of their word, in groups that fit in memory."""
    words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        most = max(1, HELD // (int(size) + 2))
        for k in range(0, len(rows), most):
            yield rows[k : k + most], Reduced([words[r] for r in rows[k : k + most]])


def with_reduced(vocab: DataFrame) -> DataFrame:
    """``word, n, h``: the hash of each word's reduced word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.zeros(batch.num_rows, np.uint64)
            for rows, reduced in _by_length(batch):
                h[rows] = reduced.hashes()
            yield pa.record_batch([*batch.columns, pa.array(h.view(np.int64))], ["word", "n", "h"])

    return map_batches(vocab, work, "word string, n long, h long")


def neighbourhoods(vocab: DataFrame, marks: np.ndarray) -> DataFrame:
    """``word, n, h`` for each reduced word within one edit of the word's that a
    word of the vocabulary may have."""
    shared = vocab.sparkSession.sparkContext.broadcast(marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, reduced in _by_length(batch):
                at, found = [], []
                for h in reduced.near():
                    row, place = np.nonzero(marked(shared.value, h))
                    at.append(row)
                    found.append(h[row, place])
                row, h = distinct_by_row(np.concatenate(at), np.concatenate(found))
                held = batch.take(pa.array(rows[row]))
                yield pa.record_batch(
                    [held.column(0), held.column(1), pa.array(h.view(np.int64))], ["word", "n", "h"]
                )

    return map_batches(vocab.select("word", "n"), work, "word string, n long, h long")


def near_words(vocab: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for every two words exactly one edit apart, both ways.

    ``vocab`` is a written table of ``word, n, h``.
    """
    asked = neighbourhoods(vocab, bitmap(vocab))
    held = vocab.select("h", F.col("word").alias("near"), F.col("n").alias("near_n"))
    return asked.join(held, "h").where(F.levenshtein("word", "near", 1) == 1).drop("h")


def _roots(links: DataFrame, most: int, work: Workspace) -> DataFrame:
    """``word, root`` from ``word, root`` with the next word only.

    Each step multiplies the count by ``RATIO``, which bounds the steps; every
    round follows twice as many.
    """
    links = work.keep(links, "forms")
    steps = max(1, int(math.log(max(most, RATIO) / LEAST_COUNT, RATIO)) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        ends = links.select(F.col("word").alias("root"), F.col("root").alias("end"))
        moved = lookup(links, ends, ["root"], spread=["word"])
        links = work.keep(moved.select("word", F.coalesce("end", "root").alias("root")), "forms")
    return links


def spelling_variants(docs: DataFrame, work: Workspace) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    vocab = work.keep(with_reduced(vocabulary(docs)), "vocabulary")
    none = [F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")]
    every = near_words(vocab).unionByName(vocab.select("word", "n", *none))
    # A struct's smallest value: largest count, then smallest word.
    best = F.min(F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), "near")))
    grouped = every.groupBy("word").agg(
        F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best")
    )
    far = -F.col("best.col1") >= RATIO * F.col("n")
    found = work.keep(
        grouped.select(
            "word", "n", "n_near",
            F.when(far, F.col("best.near")).alias("form"),
            F.when(far, -F.col("best.col1")).alias("form_n"),
        ),
        "variants",
    )
    most = found.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    roots = _roots(links, most, work)
    return lookup(found, roots, ["word"]).select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
