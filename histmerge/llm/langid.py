"""Language identification with a string kernel.

The kernel of two texts is the mean, over n-gram lengths 1 to 3, of the cosine
of their n-gram presence sets (a blended spectrum kernel on presence). A bounded
sample of labelled texts is drawn for each language; some of it are landmarks.
The Nyström map sends a text to its kernel values with the landmarks, whitened
by the landmarks' own kernel; kernel ridge regression in that space gives one
scorer for each language against the rest. As presence says nothing of how often
an n-gram occurs, a text is scored in pieces of ``PIECE`` bytes, all of them, and
its score is their mean by length: a quotation in another language weighs what it
is long. A batch of pieces is scored by one matrix product of their presence with
the landmarks' presence, to which the scorers were applied beforehand.

The n-grams are taken over a 64-symbol folding of the UTF-8 bytes (letters
without case, one symbol for other ASCII, 32 for bytes beyond ASCII), so that a
three-gram is 18 bits and finds its column by one table lookup. Only n-grams
that occur in a landmark are counted on either side of the kernel.

Defined results: a null text or one without a letter is ``und`` with score 0;
without any labelled text every prediction is ``und``. Ties go to the language
first by code point. Repeated rows are predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.llm.batches import Texts, map_slices, with_columns

#: Rows of the fitting sample and landmarks, for each language.
SAMPLE, LANDMARKS, RIDGE = 250, 40, 1e-3
#: Of a text with more bytes the sample takes a part of at most so many, from a place
#: that its hash tells.
SAMPLE_BYTES = 50_000
#: Bytes of a piece, and pieces scored at once.
PIECE, PIECES_AT_ONCE = 1024, 256
UNKNOWN = "und"

SYMBOLS = np.zeros(256, np.int32)
SYMBOLS[97:123] = SYMBOLS[65:91] = np.arange(1, 27)
SYMBOLS[128:] = 32 + np.arange(128) % 32
GRAMS = 64 + 64**2 + 64**3


def gram_codes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes of all one-, two- and three-grams, not crossing rows."""
    s = SYMBOLS[texts.data]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(texts.offsets))
    two = (s[:-1] << 6) | s[1:]
    three = (two[:-1] << 6) | s[2:]
    in_two, in_three = row[:-1] == row[1:], row[:-2] == row[2:]
    return (
        np.concatenate([row, row[:-1][in_two], row[:-2][in_three]]),
        np.concatenate([s, 64 + two[in_two], 64 + 64**2 + three[in_three]]),
    )


@dataclass
class Vocabulary:
    """The landmarks' n-grams; ``column`` has their count for any other."""

    column: np.ndarray
    bounds: list[int]

    @classmethod
    def of(cls, codes: np.ndarray) -> Vocabulary:
        known = np.unique(codes)
        column = np.full(GRAMS, len(known), np.int32)
        column[known] = np.arange(len(known))
        return cls(column, [0, *np.searchsorted(known, [64, 64 + 64**2, GRAMS]).tolist()])

    def presence(self, texts: Texts) -> np.ndarray:
        """A row for each text whose product with another is their kernel."""
        rows, codes = gram_codes(texts)
        seen = np.zeros((len(texts), self.bounds[-1] + 1), bool)
        seen[rows, self.column[codes]] = True
        out = seen[:, :-1].astype(np.float32)
        for lo, hi in zip(self.bounds, self.bounds[1:], strict=False):
            norm = np.sqrt(np.maximum(out[:, lo:hi].sum(1, keepdims=True), 1) * 3)
            out[:, lo:hi] /= norm
        return out


def pieces(texts: Texts, size: int = PIECE) -> tuple[Texts, np.ndarray]:
    """The texts cut into equal parts of ``size`` bytes at most; the row of each part."""
    length = np.diff(texts.offsets)
    count = np.maximum(1, -(-length // size))
    row = np.repeat(np.arange(len(texts)), count)
    turn = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    start = texts.offsets[row] + turn * length[row] // count[row]
    return Texts(texts.data, np.append(start, len(texts.data))), row


@dataclass
class Model:
    """``projection`` is the landmarks' presence times the scorers, ``bias`` theirs."""

    languages: list[str]
    vocabulary: Vocabulary
    projection: np.ndarray
    bias: np.ndarray

    def scores(self, texts: Texts) -> np.ndarray:
        """A score for each text (row) and language (column)."""
        parts, row = pieces(texts)
        out = np.zeros((len(texts), len(self.languages)))
        length = np.diff(parts.offsets)
        for lo in range(0, len(parts), PIECES_AT_ONCE):
            hi = min(lo + PIECES_AT_ONCE, len(parts))
            a, b = parts.offsets[lo], parts.offsets[hi]
            some = Texts(parts.data[a:b], parts.offsets[lo : hi + 1] - a)
            found = self.vocabulary.presence(some) @ self.projection + self.bias
            np.add.at(out, row[lo:hi], found * length[lo:hi, None])
        return out / np.maximum(np.diff(texts.offsets), 1)[:, None]


def texts_of(values: list[str]) -> Texts:
    blobs = [v.encode() for v in values]
    return Texts(
        np.frombuffer(b"".join(blobs), np.uint8),
        np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64),
    )


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from labelled texts; the first of each language are landmarks."""
    if not texts:
        return None
    names = sorted(set(languages), key=lambda x: x.encode())
    label = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(names))])
    marks = texts_of([texts[i] for i in chosen])
    vocabulary = Vocabulary.of(gram_codes(marks)[1])
    basis = vocabulary.presence(marks)
    parts, row = pieces(texts_of(texts))
    label = label[row]
    kernel = []
    for lo in range(0, len(parts), PIECES_AT_ONCE):
        a, b = parts.offsets[[lo, min(lo + PIECES_AT_ONCE, len(parts))]]
        some = Texts(parts.data[a:b], parts.offsets[lo : lo + PIECES_AT_ONCE + 1] - a)
        kernel.append(vocabulary.presence(some) @ basis.T)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    usable = values > 1e-6 * max(values.max(), 1e-12)
    whiten = vectors[:, usable] / np.sqrt(values[usable])
    mapped = np.concatenate(kernel).astype(np.float64) @ whiten
    # Each language weighs the same, however often it was drawn; a bias column.
    mapped = np.hstack([mapped, np.ones((len(mapped), 1))])
    weight = (1 / np.bincount(label, minlength=len(names)))[label][:, None]
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    square = mapped.T @ (weight * mapped) + ridge * np.eye(mapped.shape[1])
    solved = np.linalg.solve(square, mapped.T @ (weight * target))
    scorers = whiten @ solved[:-1]
    return Model(names, vocabulary, (basis.T @ scorers).astype(np.float32), solved[-1])


def labelled_sample(docs: DataFrame, size: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``size`` distinct texts of each language, chosen by a hash of the text;
    of a text longer than ``most_bytes`` a part.

    ``docs`` has ``text`` and ``lang``. Distinct texts are counted before they are
    thinned, so copies of one text leave no language without a sample. Only hashes
    are ranked, first within each task's share, so no language is ever gathered in
    one task.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("h")
    )
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    near = counts.select("lang", (F.lit(4.0 * size + 40) / F.col("n")).alias("part"))
    thinned = usable.join(F.broadcast(near), "lang").where(
        F.pmod("h", F.lit(1 << 30)) < F.col("part") * (1 << 30)
    )
    # A character has four bytes at most.
    chars = most_bytes // 4
    room = F.greatest(F.char_length("text") - chars, F.lit(0)) + 1
    part = F.substr("text", (F.pmod("h", room) + 1).cast("int"), F.lit(chars))
    bounded = F.when(F.octet_length("text") <= most_bytes, F.col("text")).otherwise(part)
    pairs = thinned.groupBy("lang", "h").agg(F.any_value(bounded).alias("text"))
    best = pairs.groupBy("lang").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("h", "text"))), 1, size).alias("drawn")
    )
    return best.select("lang", F.inline("drawn")).select("lang", "h", "text")


def identify(
    docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS
) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``lang_pred`` and ``score``.

    ``labelled`` has ``text, lang``; a sample of ``sample`` texts of each
    language is fitted on the driver. The model that the tasks get has as many
    columns as the landmarks have n-grams, 266,304 at most.
    """
    drawn = sorted(labelled_sample(labelled, sample).collect(), key=lambda r: (r["lang"], r["h"]))
    model = fit([r["text"] for r in drawn], [r["lang"] for r in drawn], landmarks)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        model, n = shared.value, len(texts)
        names, score = [UNKNOWN] * n, np.zeros(n)
        if model is not None:
            letters = has_letter(texts)
            found = model.scores(texts)
            best = found.argmax(1)
            certain = np.clip((found[np.arange(n), best] + 1) / 2, 0, 1)
            for k in np.flatnonzero(letters):
                names[k], score[k] = model.languages[best[k]], certain[k]
        ids = part.column(part.schema.get_field_index("doc_id"))
        return pa.record_batch(
            [ids, pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
        )

    plain = with_columns(docs, {"doc_id": "long", "text": "string"})
    return map_slices(plain, work, "doc_id long, lang_pred string, score double")


def has_letter(texts: Texts) -> np.ndarray:
    """Which texts have a letter of any script; only the ones without an ASCII
    letter are looked at as characters."""
    ascii_letter = (texts.data | 32) - 97 < 26
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = total[texts.offsets[1:]] > total[texts.offsets[:-1]]
    for k in np.flatnonzero(~found):
        found[k] = any(map(str.isalpha, texts.text(k).decode("utf-8", "replace")))
    return found
