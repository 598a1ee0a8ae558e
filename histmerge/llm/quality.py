"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed words and word pairs are counted: one over every
document labelled good (the trusted target), one over every
document (the raw corpus), which is also the first's prior: an n-gram that the
trusted documents lack tends to no weight, not to a low one. A document's score
is the sum of its n-grams' log ratios over their number. A document is kept if it
passes the base rules and its score reaches a threshold: a fixed one, or less if
trusted texts, each scored as if it and its copies were not trusted, fall below it,
as they do when there are few. Few texts tell little of the lowest good score, so
the threshold lies below theirs by a part of their spread that shrinks with their
number. Nothing is drawn at random, and the rule is one for all sizes.

Words are ``[^\\x20\\x09-\\x0D]+``. Words, lines and windows are compared by
64-bit hashes of their bytes, trusted texts by two of them.

Defined results: a null or empty text has no words and fails the base rules;
without two different trusted texts, one of which passes the base rules, no text can
be held out and every score is 0: only the base rules decide;
repeated rows are judged alike.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.llm.batches import (
    SPACES,
    Texts,
    binaries,
    map_batches,
    map_slices,
    mix,
    slices,
    with_columns,
)
from histmerge.llm.marks import bitmap, marked
from histmerge.workspace import Workspace

#: 2**BITS buckets of n-grams; each count takes 2**(BITS + 3) bytes.
BITS = 16
#: Least log ratio an n-gram (nats) of a kept document, and raw counts added to the trusted.
THRESHOLD, PRIOR = -0.18, 1_000.0
#: The share of the trusted texts that may fall below the threshold, each held out, and
#: how many standard deviations it lies lower for a single text, for n of them 1/n of that.
LOST, MARGIN = 0.005, 10.0
#: Ranges of values that are counted at once in search of a quantile.
RANGES = 4_096
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

#: Fixed values of the symbol rule.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WORD = ~SPACES
LINE = np.ones(256, bool)
LINE[0x0A] = False
#: The first byte of each character of a word.
CHARACTER = WORD.copy()
CHARACTER[0x80:0xC0] = False
BASE_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
)


def per_row(texts: Texts, mark: np.ndarray) -> np.ndarray:
    """Marked bytes of each row."""
    total = np.zeros(len(mark) + 1, np.int64)
    np.cumsum(mark, out=total[1:])
    return total[texts.offsets[1:]] - total[texts.offsets[:-1]]


def seen_twice(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which entries share row and value with another."""
    order = np.lexsort((values, rows))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (rows[order][1:] == rows[order][:-1]) & (values[order][1:] == values[order][:-1])
    out = np.zeros(len(order), bool)
    out[order] = same[1:] | same[:-1]
    return out


def base_counts(texts: Texts, starts, ends, rows, words) -> list[np.ndarray]:
    """The five columns of ``BASE_SCHEMA``."""
    n = len(texts)
    line_from, line_to, line_row = texts.spans(LINE)
    filled = np.concatenate([[0], np.cumsum(WORD[texts.data])])
    has_word = filled[line_to] > filled[line_from] if len(line_to) else np.empty(0, bool)
    line_from, line_to, line_row = line_from[has_word], line_to[has_word], line_row[has_word]
    lines = texts.hashes(line_from, line_to)
    n_lines = np.bincount(line_row, minlength=n)
    order = np.lexsort((lines, line_row))
    new = np.ones(len(order), bool)
    a, b = line_row[order], lines[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    dup_lines = n_lines - np.bincount(a[new], minlength=n)

    count = len(words) - WINDOW + 1
    covered = np.zeros(len(words) + 1, np.int64)
    if count > 0:
        inside = np.flatnonzero(rows[:count] == rows[WINDOW - 1 :])
        key = np.zeros(count, np.uint64)
        for k in range(WINDOW):
            key = mix(key + words[k : k + count])
        again = inside[seen_twice(rows[inside], key[inside])]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    data = texts.data
    return [
        np.bincount(rows, minlength=n),
        per_row(texts, CHARACTER[data]),
        per_row(texts, SYMBOL[data]),
        dup_lines,
        np.bincount(rows[repeated], minlength=n),
    ]


def ngram_buckets(words: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of all words and word pairs."""
    drop = np.uint64(64 - bits)
    same = rows[:-1] == rows[1:]
    pairs = mix(words[:-1] * np.uint64(3) + mix(words[1:]))[same]
    return (
        np.concatenate([rows, rows[:-1][same]]),
        np.concatenate([words >> drop, pairs >> drop]).astype(np.int64),
    )


def trusted_texts(docs: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """Written: each different ``text`` of the documents labelled good, and its ``copies``.

    Which texts these are is found by ids and hashes alone. A bitmap of them then sifts
    the documents, so that little else than one row of each text moves.
    """
    good = with_columns(labels, {"doc_id": "long", "quality": "int"}).where("quality = 1")
    key = ["doc_id", "h1", "h2"]
    rows = docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(6), "text")})
    found = rows.select(*key).join(good.select("doc_id").distinct(), "doc_id", "left_semi")
    held = work.keep(
        found.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")),
        "trusted-ids",
    )
    h = F.xxhash64(*key).alias("h")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(held.select(h)))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.asarray(batch.column(batch.schema.get_field_index("h"))).view(np.uint64)
            yield batch.filter(pa.array(marked(shared.value, seen)))

    rows = rows.select(*key, "text", h)
    sifted = map_batches(rows, sift, rows.schema).drop("h")
    texts = sifted.join(held, key).dropDuplicates(key)
    return work.keep(texts.select("text", "copies"), "trusted-texts")


def bucket_counts(texts: DataFrame, bits: int) -> np.ndarray | None:
    """How often each bucket occurs in the texts, each taken ``copies`` times if there
    is such a column; None without any word.

    Each task sums its documents into an array of 2**bits numbers and passes on
    that alone, in 16 parts that are added up in parallel.
    """
    parts = 16
    weighed = "copies" in texts.columns
    texts = texts.select("text", *["copies"] * weighed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part, texts in slices(batch):
                starts, ends, rows = texts.spans(WORD)
                words = texts.hashes(starts, ends)
                at, buckets = ngram_buckets(words, rows, bits)
                if weighed:
                    np.add.at(total, buckets, np.asarray(part.column(1))[at])
                else:
                    total += np.bincount(buckets, minlength=1 << bits)
        if total.any():
            cut = np.split(total, parts)
            yield pa.record_batch(
                [pa.array(range(parts), pa.int32()), binaries([zlib.compress(x.tobytes(), 1) for x in cut])],
                ["part", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.frombuffer(zlib.decompress(blob), np.int64)
                sums[part] = sums[part] + found if part in sums else found
        if sums:
            yield pa.record_batch(
                [pa.array(list(sums), pa.int32()), binaries([x.tobytes() for x in sums.values()])],
                ["part", "counts"],
            )

    schema = "part int, counts binary"
    counted = map_batches(texts, count, schema).repartition(parts, "part")
    found = sorted(map_batches(counted, add, schema).collect())
    if not found:
        return None
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in found])


def value_at(values: DataFrame, column: str, share: float) -> float | None:
    """The least value that ``share`` of the rows don't exceed, exactly; None without rows.

    Rows are counted by ranges between the least and the largest value, then within
    the range that holds it, so nothing is sorted or gathered in one place.
    """
    x = F.col(column)
    n, low, high = values.agg(F.count(x), F.min(x), F.max(x)).first()
    wanted = max(1, math.ceil(share * n))
    while n and low < high:
        part = F.least(F.floor((x - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        counted = values.where(x.between(low, high)).groupBy(part.alias("part")).agg(
            F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")
        )
        for r in sorted(counted.collect()):  # RANGES rows at most
            low, high = r["low"], r["high"]
            if wanted <= r["n"]:
                break
            wanted -= r["n"]
    return low


def log_ratios(raw: np.ndarray, trusted: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of each bucket; 0 where no document has one."""
    share = raw / raw.sum()
    seen = share > 0
    out = np.zeros(len(raw))
    out[seen] = np.log((trusted[seen] + prior * share[seen]) / (trusted.sum() + prior) / share[seen])
    return out


def fit(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS
) -> tuple[np.ndarray | None, float]:
    """The log ratio of each bucket, and the least score of a kept document."""
    work = Workspace(docs.sparkSession)
    plain = with_columns(docs, {"doc_id": "long", "text": "string"})
    # Copies of a text are held out together.
    texts = trusted_texts(plain, labels, work)
    trusted = bucket_counts(texts, bits)
    if trusted is None:
        return None, threshold
    raw = bucket_counts(plain, bits)
    shared = docs.sparkSession.sparkContext.broadcast((raw, trusted))

    def held_out(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        starts, ends, rows = texts.spans(WORD)
        words = texts.hashes(starts, ends)
        failed = base_failed(base_counts(texts, starts, ends, rows, words))
        copies = np.asarray(part.column(part.schema.get_field_index("copies")))
        scores = held_out_scores(words, rows, copies, *shared.value, bits)
        return pa.record_batch([pa.array(scores[~failed & ~np.isnan(scores)])], ["score"])

    scores = work.keep(map_slices(texts, held_out, "score double"), "held-out-scores")
    shared.unpersist()
    n, spread = scores.agg(F.count("score"), F.coalesce(F.stddev_pop("score"), F.lit(0.0))).first()
    if not n:
        return None, threshold
    low = value_at(scores, "score", LOST)
    return log_ratios(raw, trusted), min(threshold, low - MARGIN * spread / n)


def held_out_scores(
    words: np.ndarray, rows: np.ndarray, copies: np.ndarray, raw: np.ndarray, trusted: np.ndarray, bits: int
) -> np.ndarray:
    """The score that each trusted text has if it and its copies were not trusted;
    NaN without another trusted one. The prior weighs against the rest as it does
    against the whole."""
    at, buckets = ngram_buckets(words, rows, bits)
    at, buckets, own = counted_by_row(at, buckets)
    n, mine = len(copies), own * copies[at]
    size = np.bincount(at, own, n)
    rest = trusted.sum() - size * copies
    prior = PRIOR * rest / trusted.sum()
    share = raw[buckets] / raw.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log((trusted[buckets] - mine + prior[at] * share) / (rest + prior)[at] / share)
        scores = np.bincount(at, own * ratio, n) / size
    return np.where((rest > 0) & (size > 0), scores, np.nan)


def counted_by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row and how often each occurs there."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    first = np.flatnonzero(new)
    return rows[first], values[first], np.diff(np.append(first, len(rows)))


def score_of(words: np.ndarray, rows: np.ndarray, n: int, table: np.ndarray, bits: int) -> np.ndarray:
    at, buckets = ngram_buckets(words, rows, bits)
    return np.bincount(at, table[buckets], n) / np.maximum(np.bincount(at, minlength=n), 1)


def base_failed(base: list[np.ndarray]) -> np.ndarray:
    return (base[0] < LEAST_WORDS) | (100 * base[4] > MOST_REPEATED * base[0])


def verdict(texts: Texts, table: np.ndarray | None, threshold: float, bits: int) -> tuple:
    """The base counts, whether they fail, the score, and whether the text is kept."""
    starts, ends, rows = texts.spans(WORD)
    words, score = texts.hashes(starts, ends), np.zeros(len(texts))
    base = base_counts(texts, starts, ends, rows, words)
    if table is not None:
        score = score_of(words, rows, len(texts), table, bits)
    failed = base_failed(base)
    return base, failed, score, ~failed & (score >= threshold)


def judge(
    docs: DataFrame, ratios: np.ndarray | None, threshold: float = THRESHOLD, bits: int = BITS
) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``score`` and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in docs.columns if c != "text"]

    def work(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        base, failed, score, kept = verdict(texts, shared.value, threshold, bits)
        return pa.record_batch(
            [
                *(part.column(part.schema.get_field_index(c)) for c in keep),
                *(pa.array(x.astype(np.int64)) for x in base),
                pa.array(failed), pa.array(score), pa.array(kept),
            ],
            [*keep, *names, "base_failed", "score", "kept"],
        )

    schema = docs.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_slices(
        docs, work, f"{fields}, {BASE_SCHEMA}, base_failed boolean, score double, kept boolean"
    )


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The verdict on every document of ``docs`` (``doc_id, text``)."""
    plain = with_columns(docs, {"doc_id": "long", "text": "string"})
    return judge(plain, *fit(docs, labels, threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, in the same columns."""
    ratios, least = fit(docs, labels, threshold, bits)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def work(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        return part.filter(pa.array(verdict(texts, shared.value, least, bits)[3]))

    return map_slices(docs, work, docs.schema)
